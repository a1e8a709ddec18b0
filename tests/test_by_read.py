"""Indexes from one row a read against those of joined occurrences, and what they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.config import Config
from strandlake.operators import count, filter as index, group, merge

SCHEMA = "id string, kind int, seq string, qual string"
CFG = Config(k=6, min_tumor_a=2, max_normal_a=9, min_tumor_b=0, max_normal_b=9, window_min=3, window_len=8)


def reads(shared):
    """Reads of one sequence; some ids name several, some of which meet nothing."""
    rng = random.Random(7)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    out = [("none", 0, "", None), ("null", 0, None, None), ("n", 1, "N" * 20, None)]
    for i in range(60):
        at, size = rng.randrange(90), rng.randrange(1, 50)
        s = "".join("N" if rng.random() < 0.02 else c for c in base[at : at + size])
        out.append((f"r{i}", rng.randrange(2), s, None))
    if shared:
        out += [("r1", kind, base[a:b], None) for kind in (0, 1) for a, b in ((0, 30), (20, 60), (90, 120))]
        out += [("r2", 1, "A" * 7, None), ("r2", 1, "AAC", None), (None, 1, base[:40], None), (None, 1, base[5:50], None)]
    return out


def rows_of(ix):
    return [sorted(map(repr, df.select(sorted(df.columns)).distinct().collect())) for df in (ix.seq, ix.k2i, ix.i2p)]


def found(df):
    return count.candidates_of(df, CFG).select("root", "kmer").withColumn("part", merge.partition_of("root", 3))


@pytest.mark.parametrize("shared, tags", [(False, ()), (True, ()), (True, ("part",))])
def test_indexes_of_reads_equal_those_of_the_join(rows, monkeypatch, shared, tags):
    df = rows(reads(shared), SCHEMA)
    of_reads = index.indexes(df, found(df), CFG, tags)
    assert of_reads.by_read.groupBy("kind", "id", *tags).count().filter("count > 1").isEmpty()
    if tags:
        united, over = merge.merged_reads(of_reads, CFG)
        whole = index.indexes(df, found(df), CFG)
        assert rows_of(index.of_reads(united, CFG)) == rows_of(whole) and over.isEmpty()
    got = rows_of(of_reads)
    monkeypatch.setattr(index, "FEW_KNOWN", 0)
    joined = index.indexes(df, found(df), CFG, tags)
    assert joined.by_read is None and got == rows_of(joined) and len(got[1]) > 100


def test_groups_of_reads_equal_those_of_the_join(rows, monkeypatch):
    df, both = rows(reads(False), SCHEMA), []
    for most in (index.FEW_KNOWN, 0):
        monkeypatch.setattr(index, "FEW_KNOWN", most)
        ix = index.indexes(df, found(df), CFG)
        made = group.leads(ix, CFG), group.leads_by_window(ix, CFG), group.kmer_table(ix, CFG), group.read_table(ix, CFG), group.selection_stats(ix, CFG)
        both.append([sorted(map(repr, x.select(sorted(x.columns)).collect())) for x in made])
    assert both[0] == both[1] and all(both[0])


def test_leaders_are_found_without_a_shuffle(rows):
    """Before, places and sequences were shuffled by id."""
    df = rows(reads(False), SCHEMA)
    ix = index.indexes(df, found(df), CFG)
    for made in (group.leads(ix, CFG), ix.seq, ix.k2i, ix.i2p):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert group.leads_by_window(ix, CFG)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_a_read_s_partitions_are_united_before_the_shuffle(rows):
    """Before, each partition's row of a read was shuffled, with its sequence."""
    df = rows(reads(False), SCHEMA)
    united, _ = merge.merged_reads(index.indexes(df, found(df), CFG, ("part",)), CFG)
    plan = united._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow unite" in plan[plan.index("Exchange hashpartitioning") :]
