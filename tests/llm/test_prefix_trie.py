import pytest

from typelore.llm import prefix_trie as P
from typelore.llm import queries

from .trie_brute import trie as brute

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 8])
def test_given_conversations_against_brute_force(spark, block):
    df = queries.table(spark, "/root/testdata/sf0.01", "conversations")
    assert as_rows(P.trie(df, block=block)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def cases():
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "bye")]
    rows += [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "other"), (1, 3, None, None)]
    rows += [(2, None, "user", "first"), (2, 5, "user", "x"), (2, 5, "user", "x"), (2, 5, "assistant", "x")]
    rows += [(3, 0, "user", ""), (4, 0, None, "ünïcode ✓"), (None, 0, "user", "lost"), (7, 0, "user", "hi")]
    rows += [(12, i, "user" if i % 2 else "assistant", f"long {i % 3}") for i in range(60)]
    rows += [(10, i, "user", "same") for i in range(20)] + [(11, i, "user", "same") for i in range(20)]
    rows += [(25, 0, "user", "alone")]  # its base, 25, is itself; 26 to 29 are absent
    rows += [(27, 0, "user", "base absent for none")]
    return [(c, t, r, x, "clash") for c, t, r, x in rows]


@pytest.mark.parametrize("block", [1, 2, 3, 8])
def test_cases_against_brute_force(spark, block):
    rows = cases()
    assert as_rows(P.trie(spark.createDataFrame(rows, SCHEMA), block=block)) == brute([r[:4] for r in rows])


def test_empty_table(spark):
    assert P.trie(spark.createDataFrame([], SCHEMA)).count() == 0
