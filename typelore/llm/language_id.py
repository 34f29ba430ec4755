"""Language identification by cross-parsing: the language whose text explains a document in the fewest phrases wins.

For each language a suffix automaton is built over a bounded sample of its labelled text. A document is parsed greedily
against each automaton: a phrase grows while the text read so far still occurs in that language's sample, and a new
phrase starts where it no longer does. Phrases per character is a cross-entropy estimate; the smallest wins.

The samples are chosen in Spark by a hash of id and text, at most ``SAMPLE_CHARS`` characters per language (a documented
bound), built into automata on the driver and sent with the tasks as compact arrays; each Python worker builds from them
one hash table of (state, character) keys for all languages. Every document is scored whole, in Arrow batches, cut into segments of ``SEGMENT`` characters: all segments of a batch advance one
character per step, so each step is one vectorised lookup in one hash table that holds all languages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Characters of labelled text per language that its automaton is built on, at most.
SAMPLE_CHARS = 150_000
#: Cells (documents times characters of the longest) that one batch of documents holds in memory at most.
CELLS = 4_000_000
#: Key of a transition: state * SHIFT + code point.
SHIFT = 1 << 21
#: Texts are parsed in segments of this many characters, side by side; a phrase never runs across two segments.
SEGMENT = 4096


@dataclass(frozen=True)
class Automaton:
    """Transitions of a suffix automaton: (state, code point, target) arrays; state 0 is the start."""

    states: np.ndarray
    codes: np.ndarray
    targets: np.ndarray
    size: int


def normalise(text: str) -> str:
    """The form both samples and documents are parsed in: lower case."""
    return text.lower()


def suffix_automaton(text: str) -> Automaton:
    """The suffix automaton of ``text``: its states recognise exactly the substrings of ``text``."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for ch in text:
        c = ord(ch)
        here = len(length)
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = here
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = clone
                link[here] = clone
        last = here
    states = np.fromiter((s for s, m in enumerate(moves) for _ in m), dtype=np.int32)
    codes = np.fromiter((c for m in moves for c in m), dtype=np.int32)
    targets = np.fromiter((t for m in moves for t in m.values()), dtype=np.int32)
    return Automaton(states, codes, targets, len(moves))


def _slot(keys: np.ndarray, mask: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(29)) & np.uint64(mask)).astype(np.int64)


@dataclass(frozen=True)
class Table:
    """All languages' automata in one open-addressing hash table of (global state * SHIFT + code point) keys.

    Each language's states are numbered from its own offset. ``root`` gives the start transitions of code points below
    65,536 directly (-1: none), one row per language.
    """

    keys: np.ndarray
    values: np.ndarray
    offsets: np.ndarray
    root: np.ndarray

    @staticmethod
    def of(automata: list[Automaton]) -> Table:
        offsets = np.cumsum([0] + [a.size for a in automata])[:-1].astype(np.int64)
        keys = np.concatenate([(a.states.astype(np.int64) + o) * SHIFT + a.codes for a, o in zip(automata, offsets)] or [np.zeros(0, np.int64)])
        values = np.concatenate([a.targets.astype(np.int64) + o for a, o in zip(automata, offsets)] or [np.zeros(0, np.int64)])
        bits = max(4, int(np.ceil(np.log2(max(2 * len(keys), 2)))))
        mask = (1 << bits) - 1
        table_keys, table_values = np.full(mask + 1, -1, dtype=np.int64), np.zeros(mask + 1, dtype=np.int64)
        slot, pending = _slot(keys, mask), np.arange(len(keys))
        while len(pending):
            free = table_keys[slot[pending]] == -1
            chosen = pending[free]
            _, first = np.unique(slot[chosen], return_index=True)
            won = chosen[first]
            table_keys[slot[won]], table_values[slot[won]] = keys[won], values[won]
            placed = np.zeros(len(keys), dtype=bool)
            placed[won] = True
            pending = pending[~placed[pending]]
            slot[pending] = (slot[pending] + 1) & mask
        root = np.full((len(automata), 65536), -1, dtype=np.int64)
        for row, (a, o) in enumerate(zip(automata, offsets)):
            starts = (a.states == 0) & (a.codes < 65536)
            root[row, a.codes[starts]] = a.targets[starts] + o
        return Table(table_keys, table_values, offsets, root)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Target of each key, -1 where there is none."""
        mask = len(self.keys) - 1
        found, slot, active = np.full(len(keys), -1, dtype=np.int64), _slot(keys, mask), np.arange(len(keys))
        while len(active):
            here = self.keys[slot[active]]
            hit = here == keys[active]
            found[active[hit]] = self.values[slot[active[hit]]]
            active = active[~hit & (here != -1)]
            slot[active] = (slot[active] + 1) & mask
        return found


def phrases(table: Table, codes: np.ndarray) -> np.ndarray:
    """Greedy phrase counts of the rows of ``codes`` (code points, -1 past a row's end), one column per language.

    A phrase is extended by the next character while the phrase so far followed by it occurs in the sample; otherwise
    that character starts a new phrase, of one character if the sample never holds it. Rows are worked on longest
    first, so that the rows still being read at a step are always the first ones.
    """
    rows, width = codes.shape
    langs = len(table.offsets)
    lengths = (codes >= 0).sum(axis=1)
    order = np.argsort(-lengths, kind="stable")
    codes, lengths = codes[order], lengths[order]
    state = np.full(rows * langs, -1, dtype=np.int64)
    count = np.zeros(rows * langs, dtype=np.int64)
    lang_of = np.tile(np.arange(langs), rows)
    roots = np.tile(table.offsets, rows)
    live_rows = np.searchsorted(-lengths, -np.arange(width), side="left")
    for t in range(width):
        n = int(live_rows[t]) * langs if t < len(live_rows) else 0
        if n == 0:
            break
        now = state[:n]
        c = np.repeat(codes[: n // langs, t], langs)
        step = np.full(n, -1, dtype=np.int64)
        going = np.flatnonzero(now >= 0)
        if len(going):
            step[going] = table.find(now[going] * SHIFT + c[going])
        fresh = step < 0
        count[:n] += fresh
        restart = table.root[lang_of[:n], np.minimum(c, 65535)]
        wide = np.flatnonzero(fresh & (c >= 65536))
        if len(wide):
            restart[wide] = table.find(roots[wide] * SHIFT + c[wide])
        state[:n] = np.where(fresh, restart, step)
    out = np.empty((rows, langs), dtype=np.int64)
    out[order] = count.reshape(rows, langs)
    return out


#: Tables built in this Python worker, by the token of the fit they come from.
_BUILT: dict[str, Table] = {}


def _scorer(langs: list[str], automata: list[Automaton], column: str):
    # only the compact automata travel with the tasks (some 12 bytes a transition); each worker builds the table once
    token = uuid.uuid4().hex

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = Table.of(automata)
        table = _BUILT[token]
        for batch in batches:
            texts = [normalise(t) if isinstance(t, str) else "" for t in batch[column]]
            lang, conf = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if not langs:
                yield batch.assign(lang_pred=lang, score=conf)
                continue
            owner, pieces = [], []
            for j, t in enumerate(texts):
                for at in range(0, len(t), SEGMENT):
                    owner.append(j)
                    pieces.append(t[at : at + SEGMENT])
            counts = np.zeros((len(texts), len(langs)), dtype=np.int64)
            order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
            rows = max(1, CELLS // SEGMENT)
            for at in range(0, len(order), rows):
                take = order[at : at + rows]
                width = len(pieces[take[0]])
                grid = np.full((len(take), width), -1, dtype=np.int64)
                for row, i in enumerate(take):
                    code = np.frombuffer(pieces[i].encode("utf-32-le"), dtype=np.uint32)
                    grid[row, : len(code)] = code
                np.add.at(counts, np.asarray(owner)[take], phrases(table, grid))
            for j, t in enumerate(texts):
                if not any(ch.isalpha() for ch in t):
                    continue
                rate = counts[j] / len(t)
                best = sorted(range(len(langs)), key=lambda k: (rate[k], langs[k]))
                lang[j] = langs[best[0]]
                conf[j] = 1.0 if len(best) == 1 else 1.0 - rate[best[0]] / rate[best[1]]
            yield batch.assign(lang_pred=lang, score=conf)

    return score


def sample(labelled: DataFrame, budget: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): at most ``budget`` characters of each language, in the order of a hash of id and text.

    A share of each language is chosen by hash first, a plain filter before any shuffle, so that the window that counts
    characters holds only about 1.5 budgets per language; the last document taken is cut to what the budget leaves.
    """
    hashed = labelled.withColumn("_h", F.xxhash64("doc_id", "text")).withColumn("_n", F.length("text"))
    # one row per language: the languages are the automata that the driver builds anyway
    totals = {r.lang: r.total for r in hashed.groupBy("lang").agg(F.sum("_n").alias("total")).collect()}
    if not totals:
        return labelled.select("lang", "text").limit(0)
    shares = F.create_map(*[v for lang, total in totals.items() for v in (F.lit(lang), F.lit(min(1.0, 1.5 * budget / total)))])
    # xxhash64 is spread evenly over the longs, so the share of hashes below a cut is the share of rows
    cut = F.lit(-(2.0**63)) + F.element_at(shares, F.col("lang")) * F.lit(2.0**64)
    chosen = hashed.filter(F.col("_h").cast("double") <= cut)
    by_hash = Window.partitionBy("lang").orderBy("_h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(by_hash), F.lit(0))
    kept = chosen.withColumn("_before", before).filter(F.col("_before") < budget)
    return kept.select("lang", F.substring("text", 1, (F.lit(budget) - F.col("_before")).cast("int")).alias("text"))


def fit(labelled: DataFrame, budget: int = SAMPLE_CHARS) -> tuple[list[str], list[Automaton]]:
    """Languages (sorted) and their automata, from (doc_id, text, lang) rows with a language and a text."""
    rows = sample(labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0"), budget).collect()
    joined: dict[str, list[str]] = {}
    for r in rows:
        joined.setdefault(r.lang, []).append(normalise(r.text))
    langs = sorted(joined)
    # documents are separated by NUL, which text seldom holds, so that phrases seldom run across two of them
    return langs, [suffix_automaton("\x00".join(joined[lang])) for lang in langs]


def learning_rows(docs: DataFrame, fold: Column) -> DataFrame:
    return docs.filter(fold).select("doc_id", "text", "lang")


def predict(docs: DataFrame, langs: list[str], automata: list[Automaton], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` (a learned language, or ``und`` where the text is null or holds no letter) and ``score``.

    ``score`` is 1 - r1 / r2 for the smallest and second smallest phrase rates r1, r2 (1 with one language, 0 for
    ``und``); ties between languages go to the smaller name. Every row is scored whole; repeated rows get equal results;
    other columns pass through the same task unchanged, and the two outputs replace columns of those names.
    """
    carried = docs.drop("lang_pred", "score")
    schema = StructType(carried.schema.fields + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return carried.mapInPandas(_scorer(langs, automata, text), schema)


def held_out(doc_id: Column, folds: int = 4, rest: int = 2) -> Column:
    """True where crc32 of the id as text leaves ``rest`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == rest, F.lit(False))


def identify(docs: DataFrame, budget: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs`` (doc_id, text, lang).

    Learns from rows that are not held out, have a non-null id, language and text. A null text, an empty one or one
    without a letter is ``und`` with score 0. Long texts are scored whole. With no labelled row every text is ``und``.
    """
    fold = held_out(F.col("doc_id"))
    learn = docs.filter(~fold & F.col("doc_id").isNotNull())
    langs, automata = fit(learning_rows(learn, F.lit(True)), budget)
    base = docs.select("doc_id", "text", fold.alias("held_out"))
    return predict(base, langs, automata).select("doc_id", "held_out", "lang_pred", "score")
