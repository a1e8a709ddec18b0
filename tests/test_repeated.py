"""k-mers of repeated roots by read: a table of bits against the join of all occurrences."""

import numpy as np
import pytest

from strandlake.operators import prune, runs

from test_by_read import SCHEMA, reads


def test_gaps_are_whole():
    for values in ([0], [0, 0, 254, 255, 256, 256, 1 << 20], [255], [510, 510], list(range(0, 5000, 7))):
        assert runs._of_gaps(runs._gaps(np.array(values, np.uint32))).tolist() == values


@pytest.mark.parametrize("k", [4, 5, 6, 9])
@pytest.mark.parametrize("shared", [False, True])
def test_repeated_roots_of_reads_equal_the_join(rows, monkeypatch, shared, k):
    """Before, all occurrences were shuffled by root: F9 prune_semi_join."""
    df = rows([*reads(shared), ("k", None, "ACGTACGTTTGACA", None), (None, None, "ACGTACGGTTGACA", None)], SCHEMA)
    monkeypatch.setattr(runs, "SORTED", 100)
    monkeypatch.setattr(runs, "BLOCK_BITS", 5)
    got = prune.of_reads(df, k)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert shared or "Exchange" not in plan
    monkeypatch.setattr(runs, "DENSE_BITS", 0)
    joined = prune.of_reads(df, k)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, joined.collect())) and not joined.isEmpty()
