"""Runs of k-mers against row-wise cutting, and what is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.config import Config
from strandlake.operators import count, filter as index, kmers, runs

SCHEMA = "id string, kind int, seq string, qual string"


def reads(seed, n=80):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    out = [("long", 1, "A" * 400 + base, None), ("none", 0, "", None), ("null", 0, None, None), ("n", 1, "N" * 40, None), ("edge", 0, "N" + base[:40] + "N", None)]
    for i in range(n):
        at, size = rng.randrange(250), rng.randrange(1, 120)
        s = "".join("N" if rng.random() < 0.02 else c for c in base[at : at + size])
        out.append((f"r{i}", rng.randrange(2), s, None))
    return out


@pytest.mark.parametrize("k", [3, 4, 8, 15, 16, 17, 30, 31])
def test_pairs_of_runs_are_those_of_rows(rows, k):
    df, cfg = rows(reads(k), SCHEMA), Config(k=k)
    plain = count._saturated(count.pair_counts(df, cfg), cfg, sum((F.col(c) for c in runs.COUNTERS), F.lit(0)).alias("total"))
    plain = plain.withColumn("total", F.sum("total").over(count._of_root()))
    got = count.root_table(df, cfg, once=True).select(plain.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_bins_counted_in_pieces(rows, monkeypatch):
    whole = runs._counted
    heads, bases = [], []
    import numpy as np

    codes = runs._CODE[np.frombuffer(("ACGTTGCAACGGT" * 400).encode(), np.uint8)]
    batch = runs._runs(codes, np.array([0, len(codes)]), np.array([1], np.int32), 16)
    bin_ = runs._Bin(16)
    monkeypatch.setattr(runs, "RUN_BYTES", 50)
    for i in range(len(batch)):
        h, b = (np.frombuffer(batch.column(c)[i].as_py(), np.uint8) for c in (1, 2))
        heads.append(h), bases.append(b)
        for _ in range(3):
            bin_.add(h, b)
    keys, counters = bin_.result()
    once = whole(np.concatenate(heads), np.concatenate(bases), 16)
    assert (keys == once[0]).all() and (counters == 3 * once[1]).all()


def test_repeats_and_long_runs_saturate(rows):
    got = count.root_table(rows([("a", 1, "A" * 70_020, None)], SCHEMA), Config(k=16)).collect()
    assert [(r.a_t, r.total) for r in got] == [(65535, 70_005)]


def test_lookup_where_reads_are_cut_equals_the_join(rows, monkeypatch):
    df = rows(reads(5), SCHEMA)
    cfg = Config(k=6, min_tumor_a=2, max_normal_a=9, min_tumor_b=0, max_normal_b=9)
    found = count.candidates_of(df, cfg).select("root", "kmer").withColumn("part", F.length("kmer"))
    both = []
    for most in (index.FEW_KNOWN, 0):
        monkeypatch.setattr(index, "FEW_KNOWN", most)
        both.append(sorted(map(repr, index.hits(df, found, cfg, ("part",)).collect())))
    assert both[0] == both[1] and len(both[0]) > 100


def test_counting_shuffles_few_bytes_a_kmer(rows):
    """A row for each k-mer took more than 8 bytes of each; runs take under 3."""
    rng, k = random.Random(1), 30
    data = [(f"r{i}", 1, "".join(rng.choice("ACGT") for _ in range(100)), None) for i in range(3000)]
    df = rows(data, SCHEMA).coalesce(1)
    plan = runs.pair_table(df, k, 65535)
    shuffled = plan._jdf.queryExecution().executedPlan().toString()
    assert "heads" in shuffled and shuffled.count("Exchange hashpartitioning") == 1
    import numpy as np

    codes = runs._CODE[np.frombuffer("".join(r[2] for r in data).encode(), np.uint8)]
    batch = runs._runs(codes, np.arange(0, len(codes) + 1, 100), np.ones(3000, np.int32), k)
    assert batch.nbytes < 3 * 3000 * 71


def test_text_is_cut_as_it_was(spark, tmp_path):
    from strandlake.sources import derived

    text = "Ä a-B_c9 Zzİ " * 40
    spark.createDataFrame([(5, text), (6, text), (7, None), (8, "-- é"), (-3, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r for r in derived.reads(spark, str(tmp_path)).collect()}
    s = "".join(c for c in text if c.isascii() and c.isalnum()).lower()
    want = s.translate(str.maketrans(derived.SYMBOLS, derived.BASES))
    assert got["d5.0"].seq == want[:100] and len(got) == 2 * ((len(s) + 99) // 100) + 1
    back = want.translate(str.maketrans("ACGT", "TGCA"))
    assert got["d6.1"].seq == back[100:200][::-1] and got["d6.1"].kind == 0 and got["d-3.0"].seq == "ACG"
    assert kmers.quality_filtered(derived.reads(spark, str(tmp_path))).count() <= len(got)
