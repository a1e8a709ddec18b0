"""Annotation by runs that go to their bins and back, against the join of all occurrences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.config import Config
from strandlake.operators import count, runs
from strandlake.sources import tables

from test_by_read import reads


def test_values_are_whole():
    rng = np.random.default_rng(3)
    n, t = (rng.choice([0, 1, 5, 13, 14, 17, 18, 255, 256, 65535], 500) for _ in "nt")
    known = rng.random(500) < 0.8
    got = runs._of_values(np.frombuffer(runs._values(known, n, t), np.uint8), 500)
    assert (got[0] == known).all() and (got[1][known] == n[known]).all() and (got[2][known] == t[known]).all()


def test_texts_are_the_bases():
    keys = np.array([0, 1, 27, (1 << 62) - 1, 0x1234567812345678 & ((1 << 62) - 1)], np.uint64)
    for k in (4, 6, 9, 16, 31):
        some = keys & np.uint64((1 << 2 * k) - 1)
        assert runs.texts(some, k).to_pylist() == ["".join("ACGT"[(int(x) >> 2 * (k - 1 - i)) & 3] for i in range(k)) for x in some]


def kept(rows):
    """Reads, a third of which are not counted; some are long, some ids are shared, some kinds are null."""
    data = [(*x[:3], i % 3 > 0) for i, x in enumerate(reads(True))]
    long_ = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(700))
    data += [("long", 1, long_, True), ("poly", 0, "A" * 300, True), ("k", None, "ACGTACGTTTGACA" * 3, True), ("u", 1, long_[100:300], None), ("x", 0, "ACGTTGCATTGACCAGTTAACG", False)]
    return rows(data, "id string, kind int, seq string, counted boolean")


@pytest.mark.parametrize("k, cache, whole", [(4, True, 0), (6, True, 2_000), (6, False, 0), (6, False, 2_000), (16, True, 0), (16, True, 2_000), (31, True, 2_000)])
def test_annotation_by_runs_equals_the_join(rows, monkeypatch, k, cache, whole):
    """Before, all occurrences were shuffled by root: F11 annotate_kmers, F12 annotation_lines."""
    cfg, df = Config(k=k, enable_cache=cache), kept(rows)
    monkeypatch.setattr(runs, "BASES", 300)
    monkeypatch.setattr(runs, "RUN_BYTES", 100)
    monkeypatch.setattr(runs, "OUT_ROWS", 50)
    monkeypatch.setattr(runs, "WHOLE", whole)
    table = count.root_table(df.filter("counted"), cfg)
    want = count.annotated(df, table, cfg)
    got = count.annotated_reads(df, cfg)
    assert got.dtypes == want.dtypes and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and not want.isEmpty()
    lines = tables.annotation_text(df, cfg)
    maps = tables.annotation(df, lambda x, keep: count.annotated(x, table, cfg, keep)).filter("id is not null")
    of = lambda m: " ".join(f"{a}:{v[0]}:{v[1]}" for a, v in sorted((int(a), v) for a, v in m.items()))
    assert sorted((r.id, r.seq or "", r.kmers) for r in lines.filter(F.col("id").isNotNull()).collect()) == sorted((r.id, r.seq or "", of(r.kmers)) for r in maps.collect())
