import random
import re
import string

from typelore.llm import queries
from typelore.llm import secret_scan as S

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def _check(frame):
    rows = S.scan(frame).select("doc_id", "text", S.listed(S.F.col("base")).alias("got")).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert r.got == brute(r.text), r.doc_id


def test_base_spans_against_brute_force(spark, docs):
    rng = random.Random(2)
    parts = ["password", "Token", "apiKey", "api_key", "secret", "=", ":", '"', " ", "abc", "Z9", "AKIA", "0123456789abcdef",
             "ABCDEFGH12345678", "é", "漢", "\n", "-", "😀", "ſecret"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(250)]
    rows += [(900, None), (901, ""), (902, "token=secret=abcdefgh"), (903, 'secret: "a.b_c-d"'), (904, "w " * 60_000)]
    rows += [(905, "token = " + "a1b2c3d4e5f6" * 4 + " and AKIA" + "Q7" * 9), (906, "token=abcdef " * 400)]
    _check(docs(rows))


def test_given_documents(spark, sf_dir):
    _check(queries.table(spark, sf_dir, "documents").select("doc_id", "text"))


def test_random_stretches_are_added_and_long_words_are_not(spark, docs):
    rng, letters = random.Random(4), string.ascii_letters + string.digits
    prose = "some ordinary sentence with words that people really write down every single day in letters "
    key = lambda: "".join(rng.choices(letters, k=40))
    rows = [(i, f"{prose}{key()} {prose}") for i in range(60)]
    rows += [(100 + i, f"{prose} {'internationalization' + 'ofeverything'[: i % 12]} {prose}") for i in range(60)]
    found = {r.doc_id: r.n for r in S.scan(docs(rows)).select("doc_id", S.kinds_count(S.F.col("spans"), "random").alias("n")).collect()}
    assert sum(found[i] for i in range(60)) >= 50
    assert sum(found[100 + i] for i in range(60)) == 0


def test_every_class_has_usable_decoys(spark, sf_dir):
    key = {"decimal": "7", "hex": "c", "hex_upper": "C", "letters": "q", "base32": "Q", "base36_upper": "Q8", "base64": "q_Q8"}
    texts = queries.table(spark, sf_dir, "documents").select("text").filter("length(text) > 600")
    for name, *_ in S.ENCODINGS:
        stretch = (key[name] * 22)[:22]
        frame = texts.select(S.F.concat("text", S.F.lit(f" {stretch} "), "text").alias("t"))
        marked = S.F.explode(S._tested(S.F.col("t"), S.F.array().cast(f"array<{S._SPAN}>")))
        own = frame.select(marked.alias("s")).filter(S.F.col("s.class") == f"{name}:4").select("s.decoys")
        decoys = [d for (ds,) in own.collect() for d in ds]
        assert decoys and None not in decoys, name
        assert min(decoys) <= S.MOST_DEVIATION, name


def test_ids_in_clean_documents_stay(spark, docs, sf_dir):
    rng = random.Random(5)
    texts = [t for (t,) in queries.table(spark, sf_dir, "documents").select("text").collect() if t and len(t) > 600]
    prose = lambda: rng.choice(texts)[rng.randrange(50) :][:550] + " "
    stamp = lambda: f"2024{rng.randint(1, 12):02}{rng.randint(1, 28):02}{rng.randint(0, 23):02}{rng.randint(0, 59):02}"
    rows = [(i, f"{prose()}{stamp()}{rng.randint(10**9, 10**10 - 1)} {prose()}") for i in range(60)]
    rows += [(100 + i, f"{prose()}{stamp()}A{rng.randint(10**8, 10**9 - 1)}F {prose()}") for i in range(60)]
    frame, ids = docs(rows), ("decimal:4", "hex_upper:4")
    assert not [r for r in S.limits(frame).collect() if r["class"] in ids]


def test_one_random_stretch_of_a_class_is_enough(spark, docs):
    text = "the following line was copied by hand and then put back where it had been found on that morning "
    rng = random.Random(11)
    keys = {e[0]: "".join(rng.choices(e[2], k=48)) for e in S.ENCODINGS if e[0] in ("hex_upper", "base32", "base36_upper", "base64")}
    # this sentence spread over sixteen symbols looks random itself, so it says nothing on hex
    rows = [(i, key if i % 2 else f"{text * 20}{key} {text}") for i, (name, key) in enumerate(keys.items()) if name != "hex_upper"]
    rows += [(100, f"{text * 20}internationalizationofeverything {text}"), (101, "antidisestablishmentarianism")]
    found = S.scan(docs(rows)).select("doc_id", S.kinds_count(S.F.col("spans"), "random").alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == {i: int(i < 100) for i, _ in rows}


def test_redaction(spark, docs):
    rows = [(1, "é token=abcdef123 end"), (2, None), (3, ""), (4, "clean"), (4, "clean"), (None, "AKIA" + "A" * 16)]
    rows += [(5, "token = " + "a1b2c3d4" * 4 + "g")]
    got = sorted((r.doc_id or 0, r.text) for r in S.redact(docs(rows)).collect() if r.text is not None)
    assert got == [(0, "[access]"), (1, "é [assign] end"), (3, ""), (4, "clean"), (4, "clean"), (5, "[assign]")]
    frame = docs(rows)
    assert S.redact(frame).columns == frame.columns
    assert S.redact(frame.limit(0)).count() == 0


def test_native_plan(spark, sf_dir):
    plan = queries.secret_spans(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
