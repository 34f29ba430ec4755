import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from typelore.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
ALPHABET = "abcdeeeettt  \n\n\t.,--==__AAAaz09éüñ漢😀\x1c\x85́"


def _ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_every_block_of_code_points():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for start in range(0, 0x30000, 64):
        text = "".join(chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert _ids(encoder.encode(text)) == REFERENCE.encode_ordinary(text)


def test_random_texts_and_long_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 500)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 200)
    monkeypatch.setattr(bpe, "MAX_PIECES", 50)
    encoder, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(1500)]
    for text in [*texts, "a" * 3000, "ab" * 2000, "-" * 1000, " " * 999, "é" * 500]:
        assert _ids(encoder.encode(text)) == REFERENCE.encode_ordinary(text)


def test_stream_decoder_returns_whole_characters():
    text = "naïve 漢字 😀 end"
    ids, decoder = REFERENCE.encode_ordinary(text), bpe.StreamDecoder({r: t for t, r in RANKS.items()})
    parts = [decoder.feed([i]) for i in ids]
    assert "".join(parts) == text and decoder.state == bpe.START and "�" not in "".join(parts)
    with pytest.raises(ValueError):
        decoder.feed([RANKS[b"\xff"]])


def test_broken_utf8_is_seen():
    decoder = bpe.Decoder(RANKS)
    packed = np.array([RANKS[b"a"], RANKS[b"\xc3"]], "<u4").tobytes()
    assert decoder.decode(packed) == (b"a\xc3", False)
    assert decoder.decode(packed + np.array([RANKS[b"\xa9"]], "<u4").tobytes()) == ("aé".encode(), True)


def test_null_empty_long_and_repeated_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "word " * 40_000), (4, "x"), (4, "x"), (None, "y")]
    frame = docs(rows)
    out = bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "decoded", "is_utf8"]
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in out.collect())
    want = sorted((i or 0, len(REFERENCE.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert got == want
    both = bpe.round_trip(frame, RANKS, public_tokenizers.PATTERN, memory=0.1)
    assert both.columns == out.columns and sorted(map(repr, both.collect())) == sorted(map(repr, out.collect()))
    assert bpe.encode(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(frame.withColumn("ids", frame.doc_id), RANKS, public_tokenizers.PATTERN)


def test_query_agrees_with_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.bpe_round_trip(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = REFERENCE.encode_ordinary(texts[row.doc_id])
        packed = np.array(ids, "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
