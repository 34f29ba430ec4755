"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A token sequence is the BPE encoding of its bytes exactly if each two neighbouring tokens are the encoding of their own
joined bytes. So the encodings form a regular relation: a nondeterministic machine keeps (last token, bytes read since)
and may close a token wherever the pair of tokens is allowed. ``Transducer`` determinises it while it reads: a state
is the set of live (pending tokens, last token, open bytes), and what all members agree on is emitted. The open bytes
are a proper prefix of some token, so the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a worker remembers; when full it is emptied and built again, results stay the same.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 200_000, 300_000, 400_000

_BYTES = [bytes([b]) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class _State:
    __slots__ = ("members", "next", "final")

    def __init__(self, members: tuple):
        self.members = members
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        #: Tokens still to be written if the input ends here; the member without open bytes is the last.
        self.final = members[-1][0]


class Transducer:
    """Token ids of one piece of bytes. States and transitions are built when first needed."""

    def __init__(self, ranks: dict[bytes, int], memory: float = 1.0):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.openings = {o: o for o in {token[:n] for token in ranks for n in range(1, len(token))}}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most_states, self.most_pairs = int(MAX_STATES * memory), int(MAX_PAIRS * memory)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state((((), -1, b""),))

    def _state(self, members: tuple) -> _State:
        if members not in self.states:
            self.states[members] = _State(members)
        return self.states[members]

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging of a short piece: always the pair of lowest rank, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, last: int, token: int) -> bool:
        key = (last, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            right = self.tokens[token]
            want = [right] if last < 0 else [self.tokens[last], right]
            known = self.pairs[key] = self._merged(b"".join(want)) == want
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        members, closed, added = [], None, _BYTES[byte]
        openings, ranks = self.openings, self.ranks
        for pending, last, opened in state.members:
            opened += added
            if opened in openings:
                members.append((pending, last, openings[opened]))
            if closed is None and (token := ranks.get(opened)) is not None and self._follows(last, token):
                closed = ((*pending, token), token, b"")
        members.append(closed)  # exactly one member can be closed, as every input has one encoding
        n, shared = 0, members[0][0]
        while n < len(shared) and all(len(m[0]) > n and m[0][n] == shared[n] for m in members):
            n += 1
        if n:
            members = [(pending[n:], last, opened) for pending, last, opened in members]
        state.next[byte] = step = self._state(tuple(members)), shared[:n]
        return step

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self._reset()
        state, out = self.start, []
        for byte in piece:
            state, emitted = state.next.get(byte) or self._step(state, byte)
            if emitted:
                out.extend(emitted)
        out.extend(state.final)
        return out


class _Pieces(dict):
    """Packed ids by piece, encoded when first asked for."""

    def __init__(self, transducer: Transducer, memory: float = 1.0):
        super().__init__()
        self.transducer, self.most = transducer, int(MAX_PIECES * memory)

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Packed ids (little-endian, 32 bits each) of whole texts, cut into pieces by a pattern first.

    ``memory`` scales what is remembered; about 300 MB at 1.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: float = 1.0):
        self.find = regex.compile(pattern).findall
        self.pieces = _Pieces(Transducer(ranks, memory), memory)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))


@lru_cache(2)
def _encoder(key: str, pattern: str, memory: float = 1.0) -> Encoder:
    return Encoder(_VOCABULARIES[key], pattern, memory)


@lru_cache(2)
def _decoder(key: str) -> Decoder:
    return Decoder(_VOCABULARIES[key])


#: Vocabularies of this worker by fingerprint, so that tasks that follow each other share what was built.
_VOCABULARIES: dict[str, dict[bytes, int]] = {}


def _remember(key: str, shared: Broadcast) -> None:
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = shared.value


# ---- UTF-8 state machine -----------------------------------------------------------------------------------------------

#: Per state and byte range, the next state; 0 accepts, others wait for continuation bytes. Fixed by the UTF-8 standard.
START, ONE, TWO, THREE, E0, ED, F0, F4, BAD = range(9)
TRANSITIONS = (
    (START, 0x00, 0x7F, START), (START, 0xC2, 0xDF, ONE), (START, 0xE0, 0xE0, E0), (START, 0xE1, 0xEC, TWO),
    (START, 0xED, 0xED, ED), (START, 0xEE, 0xEF, TWO), (START, 0xF0, 0xF0, F0), (START, 0xF1, 0xF3, THREE),
    (START, 0xF4, 0xF4, F4), (ONE, 0x80, 0xBF, START), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO),
    (E0, 0xA0, 0xBF, ONE), (ED, 0x80, 0x9F, ONE), (F0, 0x90, 0xBF, TWO), (F4, 0x80, 0x8F, TWO),
)


@lru_cache(1)
def _utf8() -> list[list[int]]:
    table = [[BAD] * 256 for _ in range(9)]
    for state, first, last, to in TRANSITIONS:
        table[state][first : last + 1] = [to] * (last - first + 1)
    return table


def utf8_state(data: bytes, state: int = START) -> int:
    table = _utf8()
    for byte in data:
        state = table[state][byte]
    return state


class StreamDecoder:
    """Text of ids that arrive in parts: each call returns the characters that are complete by then."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.state, self.held = tokens, START, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        end, state, table = 0, START, _utf8()
        for i, byte in enumerate(data):
            state = table[state][byte]
            if state == BAD:
                raise ValueError("the ids are no UTF-8 text")
            if state == START:
                end = i + 1
        self.held, self.state = data[end:], state
        return data[:end].decode()


class Decoder:
    """Bytes of packed ids, and whether they are UTF-8; the machine only looks at tokens that cut a character."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.whole = np.array([bool(t) and utf8_state(t) == START for t in self.tokens])

    def decode(self, packed: bytes) -> tuple[bytes, bool]:
        ids = np.frombuffer(packed, "<u4")
        data = b"".join(map(self.tokens.__getitem__, ids.tolist()))
        state, upto = START, 0
        for at in np.flatnonzero(~self.whole[ids]).tolist():
            if at < upto:
                continue
            state, upto = utf8_state(self.tokens[ids[at]], START), at + 1
            while state not in (START, BAD) and upto < len(ids):
                state = utf8_state(self.tokens[ids[upto]], state)
                upto += 1
            if state != START:
                return data, False
        return data, True


# ---- operators ---------------------------------------------------------------------------------------------------------


def _per_task(df: DataFrame, ranks: dict[bytes, int], build, more: list[T.StructField], drop: str | None) -> DataFrame:
    """Adds columns to the batches of a task; the vocabulary is broadcast, as its size is fixed by its file."""
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in df.schema.fields if f.name != drop]

    def batches(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _remember(key, shared)
        add = build(key)
        for batch in arrow:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, *add(part)], [f.name for f in [*kept, *more]])

    return df.mapInArrow(batches, T.StructType([*kept, *more]))


def encode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", n: str = "n_tokens"
) -> DataFrame:
    """Adds ``ids`` (binary: ids as little-endian unsigned 32-bit integers) and ``n`` (long), and drops ``text``.

    A null text counts as empty and gets no ids. Bytes that are no UTF-8 are read as U+FFFD. Texts are encoded whole,
    rows stay where they are: no shuffle, nothing depends on other rows, so repeated rows give repeated results.
    Other columns are kept; one that has the name of a new column is an error.
    """
    _new(df, text, ids, n)

    def build(key: str):
        encoder = _encoder(key, pattern)

        def add(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index("_bytes")).to_pylist()
            packed = [encoder.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

        return add

    as_bytes = df.withColumn("_bytes", F.col(text).cast("binary")).drop(text)
    more = [T.StructField(ids, T.BinaryType()), T.StructField(n, T.LongType())]
    return _per_task(as_bytes, ranks, build, more, "_bytes")


def decode(
    df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded", valid: str = "is_utf8"
) -> DataFrame:
    """Adds ``decoded`` (binary) and ``valid`` (boolean) for packed ids; null ids give no bytes. No shuffle."""
    _new(df, None, decoded, valid)

    def build(key: str):
        decoder = _decoder(key)

        def add(batch: pa.RecordBatch) -> list[pa.Array]:
            packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            pairs = [decoder.decode(p or b"") for p in packed]
            return [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.bool_())]

        return add

    more = [T.StructField(decoded, T.BinaryType()), T.StructField(valid, T.BooleanType())]
    return _per_task(df, ranks, build, more, None)


def round_trip(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", memory: float = 1.0
) -> DataFrame:
    """``decode`` of ``encode`` in one pass, so that a task needs one Python worker with one vocabulary.

    Adds ``ids``, ``n_tokens``, ``decoded`` and ``is_utf8`` and drops ``text``; nulls and other columns as in ``encode``.
    ``memory`` as in ``Encoder``.
    """
    _new(df, text, "ids", "n_tokens", "decoded", "is_utf8")

    def build(key: str):
        encoder, decoder = _encoder(key, pattern, memory), _decoder(key)

        def add(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index("_bytes")).to_pylist()
            packed = [encoder.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            pairs = [decoder.decode(p) for p in packed]
            return [
                pa.array(packed, pa.binary()),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([p[0] for p in pairs], pa.binary()),
                pa.array([p[1] for p in pairs], pa.bool_()),
            ]

        return add

    as_bytes = df.withColumn("_bytes", F.col(text).cast("binary")).drop(text)
    more = [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.BinaryType()),
        T.StructField("is_utf8", T.BooleanType()),
    ]
    return _per_task(as_bytes, ranks, build, more, "_bytes")


def _new(df: DataFrame, replaced: str | None, *names: str) -> None:
    clash = {c for c in df.columns if c != replaced} & {*names, "_bytes"}
    if clash:
        raise ValueError(f"columns already exist: {sorted(clash)}")
