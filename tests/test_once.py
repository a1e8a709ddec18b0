"""Indexes that are read once: nothing is kept, and no place is shuffled."""

import pytest
from pyspark import StorageLevel

from strandlake.operators import filter as index, group
from strandlake.plans import queries

from test_by_read import CFG, SCHEMA, found, reads, rows_of

KEEP = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and not a.isEmpty()


@pytest.mark.parametrize("shared", [False, True])
def test_rows_that_are_not_kept_give_the_same_indexes(rows, shared):
    df = rows(reads(shared), SCHEMA)
    once, kept = (index.indexes(df, found(df).drop("part"), CFG, keep=KEEP, once=x) for x in (True, False))
    assert rows_of(once) == rows_of(kept)
    assert same(group.leads(once, CFG), group.leads(kept, CFG))
    assert same(group.leads_by_window(once, CFG), group.leads(kept, CFG).select("id", "dir"))


def test_indexes_read_once_are_neither_kept_nor_shuffled(rows):
    """Before, the rows of all reads were kept: F5 index_k2i, F17 group_leads."""
    df = rows(reads(False), SCHEMA)
    ix = index.indexes(df, found(df).drop("part"), CFG, keep=KEEP, once=True)
    for made in (ix.k2i, ix.i2p, group.leads(ix, CFG)):
        assert "InMemoryTableScan" not in plan_of(made) and "Exchange" not in plan_of(made)


def test_the_window_over_places_needs_no_shuffle(rows):
    """Before, all places were shuffled by id: F18 group_leads_window."""
    df = rows(reads(False), SCHEMA)
    ix = index.indexes(df, found(df).drop("part"), CFG, keep=KEEP, once=True)
    made = group.leads_by_window(ix, CFG)
    assert "InMemoryTableScan" not in plan_of(made) and "Exchange" not in plan_of(made)


def test_bitmaps_are_made_in_their_row(spark):
    """Before, words of places were shuffled twice: F21 i2p_positions."""
    made = queries.i2p_positions(spark, "/root/testdata/sf0.001")
    plan = plan_of(made)
    assert "Exchange hashpartitioning(id" not in plan and "InMemoryTableScan" not in plan
    assert made.count() == made.select("id", "dir").distinct().count()
