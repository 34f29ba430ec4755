"""Spans of secrets: three patterns, and a battery of randomness tests for what the patterns do not name.

Stretches of 20 and more characters of an encoding are tested for being random: alphabet uniformity (chi-squared), runs
above and below the middle of the alphabet, and serial correlation, each as a standardised deviation. The sum of their
squares is small for random characters. How small it must be is set per encoding and length class from the whole
table: each stretch has decoys of the same length and alphabet, made of the letters of the text around it, and a limit
is the largest at which decoys below it, per decoy that a stretch has, are at most a fixed share of the stretches below
it. A stretch has as many decoys as it takes to decide on it alone. In alphabets that hold all
digits but few letters or none, decoys are made of letters and digits, and the letters are spread over the alphabet.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.llm.expressions import let


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The patterns in the order of kinds. A match of ``AKIA[A-Z0-9]+`` or ``[0-9a-f]+`` runs as far as its characters go,
#: so asking for the least length within the pattern finds the same spans.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
LEAST_VALUE = 6
STRETCH = "[A-Za-z0-9+/_=-]{20,}"

#: Share of false discoveries, and the squared deviation beyond which nothing counts as random (0.1 % of random ones).
FALSE_SHARE, MOST_DEVIATION = 0.05, 16.27
BUCKETS = 2  # per unit of squared deviation

_D, _L, _U = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encodings in the order in which they are tried: name, pattern of a whole stretch, alphabet.
ENCODINGS = (
    ("decimal", "^[0-9]+$", _D),
    ("hex", "^[0-9a-f]+$", _D + _L[:6]),
    ("hex_upper", "^[0-9A-F]+$", _D + _U[:6]),
    ("letters", "^[A-Za-z]?[a-z]+$", _L),
    ("base32", "^[A-Z2-7]+=*$", _U + "234567"),
    ("base36_upper", "^[0-9A-Z]+$", _D + _U),
    ("base64", "", _U + _L + _D + "+/"),
)

#: Continues texts that are too short for the decoys of a stretch.
PROSE = (
    "When the ferry came in late that evening nobody was left on the quay except two porters and a girl with a bicycle. "
    "She had been told to wait for an uncle whom she knew only from a photograph, and she looked at every face twice. "
    "Die Leute gingen langsam vorbei, denn es hatte geregnet und das Pflaster war glatt; einige trugen schwere Koffer. "
    "Un vieux monsieur demanda le chemin de la gare, puis il repartit sans attendre la réponse de personne. "
    "By 1987 the harbour had 14 cranes, 250 boats and a market on Fridays, but most of that is gone now. "
    "What remains is a low building of brick where they sell maps, rope, lamp oil and quite good coffee. "
    "El dueño vive arriba con su familia y abre la puerta a las ocho, aunque haga frío o llueva mucho. "
    "Just before dark the last of the gulls settle along the jetty, and you can hear the fixed buoys knocking outside. "
    "Quando o vento muda, os pescadores voltam cedo e contam histórias que ninguém acredita, nem mesmo eles. "
    "Every visitor signs a book, gives the number of nights, and is asked whether the window may be kept open. "
)

#: Encodings whose decoys are made of digits too, and the letters that the other letters of a text become there.
SPREAD = {
    "decimal": (_L, (_D * 3)[: len(_L)]),
    "hex": (_L[6:], _D * 2),
    "hex_upper": (_U[6:], _D * 2),
}

_SPAN = "struct<start:int,end:int,rank:int,kind:string>"


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches, leftmost first; positions count code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,value:string>>"
    none = F.array().cast(kind)

    def placed(values: Column) -> Column:
        def add(state: Column, i: Column, gaps: Column) -> Column:
            start = state["upto"] + F.char_length(F.get(gaps, i))
            end = start + F.char_length(F.get(values, i))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(values, i).alias("value"))
            return F.struct(end.alias("upto"), F.concat(state["spans"], F.array(span)).cast(kind).alias("spans"))

        first = F.struct(F.lit(0).alias("upto"), none.alias("spans"))
        walked = let(
            F.split(text, pattern, -1),
            lambda gaps: F.aggregate(
                F.sequence(F.lit(0), F.size(values) - 1), first, lambda s, i: add(s, i, gaps), lambda s: s["spans"]
            ),
        )
        return F.when(F.size(values) == 0, none).otherwise(walked)

    return let(matches, placed)


def _span(start: Column, end: Column, rank: int, kind: str) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))


def _of_kind(spans: Column, rank: int, kind: str) -> Column:
    placed = F.transform(spans, lambda x: _span(x["start"], x["end"], rank, kind))
    return placed.cast(f"array<{_SPAN}>")


def _base(text: Column) -> Column:
    """Spans of the three patterns, in order of start and then kind."""
    parts = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = _found(text, pattern)
        if kind == "assign":
            spans = let(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(_with_value(text, s)))
        parts.append(_of_kind(spans, rank, kind))
    return F.array_sort(F.concat(*parts))


def _with_value(text: Column, spans: Column) -> Column:
    """Assignments whose value is long enough; a short one has used up its characters all the same."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return let(values, lambda v: F.filter(spans, lambda x, i: F.char_length(F.get(v, i)) >= LEAST_VALUE))


def _symbols(value: Column, encoding: Column) -> Column:
    """Places in the alphabet; characters outside it (padding) are left out."""
    plain = F.when(encoding == "letters", F.lower(value)).otherwise(F.translate(value, "-_", "+/"))
    places = let(
        _by_encoding(encoding, lambda e: F.lit(e[2])),
        lambda alphabet: F.transform(F.split(plain, ""), lambda c: F.when(c == "", -1).otherwise(F.instr(alphabet, c) - 1)),
    )
    return F.filter(places, lambda x: x >= 0)


def _by_encoding(encoding: Column, value) -> Column:
    return F.coalesce(*[F.when(encoding == e[0], value(e)) for e in ENCODINGS])


def encoding_of(value: Column) -> Column:
    named = [F.when(value.rlike(pattern), F.lit(name)) for name, pattern, _ in ENCODINGS if pattern]
    return F.coalesce(*named, F.lit(ENCODINGS[-1][0]))


def deviation(symbols: Column, size: Column) -> Column:
    """Sum of the squared deviations of the three tests from what random characters give; null below two symbols."""

    def tests(x: Column) -> Column:
        n = F.size(x).cast("double")
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        squares = total(
            F.transform(
                F.array_distinct(x), lambda s: F.pow(F.size(F.filter(x, lambda y: y == s)).cast("double"), 2)
            )
        )
        uniform = F.greatest((size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1)), F.lit(0.0))
        high = total(F.transform(x, lambda y: (2 * y >= size).cast("double")))
        changes = total(
            F.transform(x, lambda y, i: F.coalesce(((2 * y >= size) != (2 * F.get(x, i + 1) >= size)).cast("double"), F.lit(0.0)))
        )
        expected = 2 * high * (n - high) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(spread > 0, (changes + 1 - expected) / F.sqrt(spread)).otherwise(F.sqrt(n))
        mean = total(F.transform(x, lambda y: y.cast("double"))) / n
        own = total(F.transform(x, lambda y: F.pow(y - mean, 2)))
        next_ = total(F.transform(x, lambda y, i: F.coalesce((y - mean) * (F.get(x, i + 1) - mean), F.lit(0.0))))
        serial = F.when(own > 0, next_ / own * F.sqrt(n)).otherwise(F.sqrt(n))
        return F.pow(uniform, 2) + F.pow(runs, 2) + F.pow(serial, 2)

    return let(symbols, lambda x: F.when(F.size(x) >= 2, tests(x)))


def _folded(around: Column, encoding: Column) -> Column:
    """Characters of a text as they are used for decoys: all of them are in the alphabet of the encoding."""
    letters = F.regexp_replace(around, "[^A-Za-z]", "")
    both = F.regexp_replace(around, "[^A-Za-z0-9]", "")
    spread = [
        F.when(encoding == name, F.translate((F.upper if name == "hex_upper" else F.lower)(both), *pair))
        for name, pair in SPREAD.items()
    ]
    return F.coalesce(*spread, F.when(encoding.isin("base32", "base36_upper"), F.upper(letters)), letters)


def _tested(text: Column, base: Column, decoys: int = 1) -> Column:
    """Stretches outside the base spans with their class, deviation, and the deviations of their decoys."""

    plain = sum(c.isascii() and c.isalpha() for c in PROSE)

    def judge(s: Column) -> Column:
        encoding = encoding_of(s["value"])
        size = _by_encoding(encoding, lambda e: F.lit(float(len(e[2]))))

        def entry(symbols: Column) -> Column:
            n = F.size(symbols)
            before = F.greatest(s["start"] - 20 * n, F.lit(0))
            around = F.concat(
                F.substring(text, s["end"] + 1, 20 * n), F.substring(text, before + 1, s["start"] - before)
            )
            missing = decoys * n - F.char_length(F.regexp_replace(around, "[^A-Za-z]", ""))
            whole = F.when(missing > 0, F.concat(around, F.repeat(F.lit(PROSE), F.ceil(missing / plain).cast("int")))).otherwise(around)

            def of(characters: Column) -> Column:
                part = lambda i: _symbols(F.substring(characters, i * n + 1, n), encoding)
                return F.transform(F.sequence(F.lit(0), F.lit(decoys - 1)), lambda i: deviation(part(i), size))

            return F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.concat_ws(":", encoding, F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("string")).alias("class"),
                deviation(symbols, size).alias("deviation"),
                *([let(_folded(whole, encoding), of).alias("decoys")] if decoys else []),
            )

        return let(_symbols(s["value"], encoding), entry)

    outside = let(
        _found(text, STRETCH),
        lambda found: F.when(F.size(found) == 0, found).otherwise(
            let(base, lambda b: F.filter(found, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))
        ),
    )
    return F.transform(outside, judge)


def limits(df: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """Per class (encoding and power of two of the length) the largest deviation that counts as random.

    The best of a stretch and its ``m`` decoys is the stretch with a chance of 1 / (m + 1) if it is like them; so of the
    stretches below a limit, (decoys + 1) / m are false at most, and with m * false_share >= 1 one stretch is enough.

    Deviations are counted in buckets of stretches and decoys over all rows: a few thousand counters, whatever the input.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    near = df.select(whole.alias("t")).filter(F.col("t").rlike(STRETCH))
    each = math.ceil(1 / false_share)
    tested = near.select(F.explode(_tested(F.col("t"), _base(F.col("t")), each)).alias("s"))
    most = int(MOST_DEVIATION * BUCKETS)

    def entry(c: Column, real: int) -> Column:
        bucket = F.least(F.floor(c * BUCKETS), F.lit(most + 1))
        return F.struct(bucket.alias("bucket"), F.lit(real).alias("real"), F.lit(1 - real).alias("decoy"))

    both = F.concat(F.array(entry(F.col("s.deviation"), 1)), F.transform("s.decoys", lambda c: entry(c, 0)))
    counted = (
        tested.select(F.col("s.class").alias("class"), F.explode(F.filter(both, lambda b: b["bucket"] <= most)).alias("b"))
        .groupBy("class", F.col("b.bucket").alias("bucket"))
        .agg(F.sum("b.real").alias("real"), F.sum("b.decoy").alias("decoy"))
    )
    # at most a few dozen buckets per class: a running sum within one array each
    arrays = counted.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("bucket", "real", "decoy"))).alias("b"))

    def fits(b: Column, x: Column) -> Column:
        upto = F.filter(b, lambda y: y["bucket"] <= x["bucket"])
        total = lambda field: F.aggregate(upto, F.lit(0).cast("long"), lambda a, y: a + y[field])
        return total("decoy") + 1 <= false_share * each * total("real")

    good = let(F.col("b"), lambda b: F.transform(F.filter(b, lambda x: fits(b, x)), lambda x: x["bucket"]))
    return arrays.select("class", F.array_max(good).alias("bucket")).filter(F.col("bucket").isNotNull())


def scan(df: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, end, rank, kind), in code points, the end exclusive.

    ``spans`` holds the base spans and those of kind ``random`` that the tests add outside them. Whole texts are read;
    null counts as empty. No row is moved: the limits come from one aggregation with bounded counters and enter as a
    single value, so repeated rows, null keys and any number of other columns do no harm.
    """
    clash = {"base", "spans"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already exist: {sorted(clash)}")
    known = limits(df, text, false_share).agg(
        F.map_from_entries(F.collect_list(F.struct("class", "bucket"))).alias("limits")
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    based = df.withColumn("base", _base(whole))
    limit = known.scalar()

    def added(tested: Column) -> Column:
        chosen = F.filter(tested, lambda s: F.floor(s["deviation"] * BUCKETS) <= F.col("_limits")[s["class"]])
        return _of_kind(chosen, len(PATTERNS), "random")

    extra = F.when(whole.rlike(STRETCH), added(_tested(whole, F.col("base"), 0))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    with_limits = based.withColumn("_limits", limit)
    return with_limits.withColumn("spans", F.array_sort(F.concat("base", extra))).drop("_limits")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """``df`` with each span of ``scan`` replaced by its kind in brackets; overlapping spans become one. Null stays null."""
    found = scan(df, text, false_share)
    first = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))

    def put(state: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), state["upto"] + 1, s["start"] - state["upto"])
        fresh = F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.greatest(state["upto"], s["end"]).alias("upto"),
            F.when(s["start"] >= state["upto"], fresh).otherwise(state["out"]).alias("out"),
        )

    rest = lambda s: F.concat(s["out"], F.expr(f"substring(`{text}`, 1)").substr(s["upto"] + 1, F.char_length(F.col(text))))
    cleaned = F.aggregate("spans", first, put, rest)
    replaced = F.when(F.size("spans") > 0, cleaned).otherwise(F.col(text))
    return found.withColumn(text, replaced).select(*df.columns)


def kinds_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(df: DataFrame) -> list[Column]:
    """Columns that sum up ``scan``: counts of the base kinds, the hash of the base list, and all spans as a text."""
    counts = [kinds_count(F.col("base"), kind).alias(f"n_{kind}") for kind in PATTERNS]
    return [*counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")]
