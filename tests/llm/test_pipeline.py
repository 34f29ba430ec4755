import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from typelore.llm import bpe, queries

from .test_minhash import brute as groups
from .test_secret_scan import brute as spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, out = queries.table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((docs.collect(), result.collect(), docs.columns, result.columns))
        docs = result
    return out


def test_columns_stay_until_the_last(stages):
    for _, _, before, after in stages[:-1]:
        assert before == after


def test_quality_keeps_good_documents(spark, stages):
    before, after, *_ = stages[0]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in bad]) < 0.3


def test_one_document_of_each_group_stays(stages):
    before, after, *_ = stages[1]
    want = groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, _, kept) in want.items() if kept)


def test_secrets_are_gone(stages):
    before, after, *_ = stages[2]
    texts = {r.doc_id: r.text for r in after}
    assert len(texts) == len(before)
    hit = [r.doc_id for r in before if spans(r.text)]
    assert hit and not any(spans(texts[i]) for i in hit)
    same = [r for r in before if texts[r.doc_id] == r.text]
    assert len(same) >= len(before) - len(hit) - 20
    assert all(r.n_chars == len(r.text) for r in after)


def test_every_document_is_mixed(stages):
    before, after, *_ = stages[3]
    assert {r.doc_id for r in before} == {r.doc_id for r in after} and len(after) < 2 * len(before) + 2000


def test_tokens_are_those_of_the_library(stages):
    before, after, *_ = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "w " * 50_000), (4, "some text that is fine"), (4, "some text that is fine"), (None, "x")]
    frame = docs(rows)
    for _, stage in P.STAGES:
        assert stage(spark, frame.limit(0), SF).count() == 0
        assert stage(spark, frame, SF).count() <= 3 * len(rows)
