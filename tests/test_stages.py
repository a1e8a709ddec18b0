"""Stages against a plain-Python version on random reads, and the invariants of their reports."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.config import Config
from strandlake.operators import count, filter as index, group, kmers, merge, prune
from strandlake.plans import report

SCHEMA = "id string, kind int, seq string, qual string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def random_reads(seed, n=60, k=6):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    out = []
    for i in range(n):
        kind = rng.randrange(2)
        a = rng.randrange(0, 40)
        s = list(base[a : a + rng.randrange(k, 24)])
        if kind and rng.random() < 0.7 and len(s) > 4:
            s[len(s) // 2] = "A"
        if rng.random() < 0.2:
            s[rng.randrange(len(s))] = "N"
        s = "".join(s)
        out.append((f"r{i}", kind, rc(s) if rng.random() < 0.5 else s, "I" * len(s)))
    return out


def plain(reads, cfg):
    """Counts, candidates, k2i and i2p, read by read."""
    k = cfg.k
    occ = [(i, kind, j, s[j : j + k], s) for i, kind, s, _ in reads for j in range(len(s) - k + 1) if "N" not in s[j : j + k]]
    stem = lambda m: m[1:-1]
    root = lambda m: min(stem(m), rc(stem(m)))
    c = defaultdict(lambda: [0, 0])
    total = Counter()
    for _, kind, _, m, _ in occ:
        c[m][kind] += 1
        total[root(m)] += 1
    if cfg.enable_cache:
        c = {m: v for m, v in c.items() if total[root(m)] >= 2}
    cand = {}
    for m, (n, t) in c.items():
        n2, t2 = c.get(rc(m), (0, 0)) if stem(m) != rc(stem(m)) else (0, 0)
        if t >= cfg.min_tumor_a and n <= cfg.max_normal_a and t2 >= cfg.min_tumor_b and n2 <= cfg.max_normal_b:
            cand[m] = (n, t, n2, t2)
    by_root = defaultdict(set)
    for m in cand:
        by_root[root(m)].add(m)
    k2i = {("nn" if kind == 0 else "tn", m, i) for i, kind, _, x, _ in occ for m in by_root[root(x)]}
    i2p = set()
    for i, kind, j, x, s in occ:
        if kind:
            rel = j - (s.rfind("N", 0, j) + 1)
            if x in cand:
                i2p.add((i, "a", rel))
            if rc(x) in cand and stem(x) != rc(stem(x)):
                i2p.add((i, "b", len(s) - k - rel))
    return {m: tuple(v) for m, v in c.items()}, cand, k2i, i2p


@pytest.mark.parametrize("seed, k, b, cache", [(1, 6, 1, True), (2, 7, 0, True), (3, 6, 0, False), (4, 8, 1, False)])
def test_indexes_read_by_read(spark, rows, seed, k, b, cache):
    cfg = Config(k=k, max_normal_a=2, min_tumor_a=2, max_normal_b=3, min_tumor_b=b, enable_cache=cache)
    data = random_reads(seed, k=k)
    reads = kmers.quality_filtered(rows(data, SCHEMA)).persist()
    counts, cand, k2i, i2p = plain(data, cfg)
    table = count.root_table(reads, cfg).persist()
    assert {r.kmer: (r.n, r.t) for r in count.kmer_counts(table, cfg).collect()} == counts
    found = count.candidates(table, cfg).persist()
    assert {r.kmer: (r.n, r.t, r.n_rc, r.t_rc) for r in found.collect()} == cand
    ix = index.indexes(reads, found, cfg)
    assert {(r["set"], r.kmer, r.id) for r in ix.k2i.collect()} == k2i
    assert {(r.id, r.dir, r.pos) for r in ix.i2p.collect()} == i2p
    sizes = {(r["index"], r["set"]): r.n for r in index.sizes(ix).collect()}
    tm, tn = {r.id for r in ix.seq.filter("set = 'tm'").collect()}, {r.id for r in ix.seq.filter("set = 'tn'").collect()}
    assert tm <= tn and sizes.get(("seq", "tm"), 0) == sizes.get(("i2p", "tm"), 0) == len({i for i, _, _ in i2p})
    # Prefiltering changes neither candidates nor hits.
    pre = count.prefiltered(table, cfg)
    assert {r.kmer for r in count.candidates(pre, cfg).collect()} == set(cand)
    hits = lambda t, c: [count.stats(t, cfg, c).first()[f"hits_{x}"] for x in ("roots", "stems", "kmers")]
    assert hits(table, True) == hits(pre, True) and hits(table, False)[2] == len(cand)
    # Parts of the candidates, merged, are the whole.
    parts = [index.indexes(reads, found.filter(merge.partition_of("root", 3) == p), cfg) for p in range(3)]
    whole = merge.merged(parts, cfg)
    assert {(r["set"], r.kmer, r.id) for r in whole.k2i.collect()} == k2i and {(r.id, r.dir, r.pos) for r in whole.i2p.collect()} == i2p
    assert whole.seq.count() == ix.seq.count()


def test_cache_and_prune_only_drop_roots_seen_once(spark, rows):
    cfg = Config(k=6, min_tumor_a=2, min_tumor_b=1)
    reads = kmers.quality_filtered(rows(random_reads(9), SCHEMA))
    with_, without = count.root_table(reads, cfg), count.root_table(reads, cfg, once=True)
    a, b = count.stats(with_, cfg).first(), count.stats(without, cfg).first()
    gone = [b[x] - a[x] for x in ("roots", "stems", "once", "kmers", "sum")]
    assert len(set(gone)) == 1 and gone[0] == without.filter("total = 1").count() > 0
    assert prune.pruned(without, prune.repeated_roots(reads, 6)).select("root").distinct().count() == a.roots
    h = lambda t: sum(r.stems for r in count.histograms(t, cfg).collect())
    assert h(without) - h(with_) == gone[0]
    f = prune.bloom(prune.repeated_roots(reads, 6).select("root"), 1000, 0.05)
    assert all(f.mightContainLong(r.root) for r in with_.select("root").collect())


def test_saturation_comes_after_the_total(spark):
    reads = spark.range(70000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("kind"), F.lit("ACGTAC").alias("seq"), F.lit(None).cast("string").alias("qual"))
    table = count.root_table(reads, Config(k=6))
    assert table.first().total == 70000 and [(r.kmer, r.n, r.t) for r in count.kmer_counts(table, Config(k=6)).collect()] == [("ACGTAC", 0, 65535)]


def test_export_and_annotation(spark, rows):
    cfg = Config(k=4, export_min=2, export_max=4)
    reads = rows([(f"r{i}", 1, "ACGTT", None) for i in range(3)] + [("n1", 0, "AACGTA", None), ("n2", 0, "GGGG", None)], SCHEMA)
    table = count.root_table(reads, cfg)
    assert {(r.kmer, r.n, r.t) for r in count.export_range(table, cfg).collect()} == {("ACGT", 1, 3), ("CGTT", 0, 3)}
    asked = rows([("q", 0, "CCGTGGGG", None)], SCHEMA)
    got = sorted((r.at, r.kmer, r.n, r.t) for r in count.annotated(asked, table, cfg).collect())
    # CCGT has the stem CG, known; it was never seen itself.  GGGG's root occurs once only.
    assert (0, "CCGT", 0, 0) in got and all(x[1] != "GGGG" for x in got)


def hand_made(spark, rows, reads_per_kmer=3):
    """One leader ahead and one behind, with k = 4."""
    seq = "ACGGTCATTGACCTAGGATC"
    seqs = [("tm", "L1", seq), ("tm", "L2", rc(seq)), ("tm", "L3", seq.replace("T", "N", 1)), ("tn", "L1", seq), ("tn", "L2", rc(seq))]
    seqs += [("tn", f"t{i}", seq) for i in range(reads_per_kmer)] + [("nn", "n0", seq)]
    places = [("L1", "a", p) for p in range(7)] + [("L2", "b", p) for p in range(7)] + [("L3", "a", p) for p in range(7)] + [("L1", "b", 3)]
    kms = {seq[p : p + 4] for p in range(7)}
    k2i = [("tn", m, f"t{i}") for m in kms for i in range(reads_per_kmer)] + [("nn", m, "n0") for m in list(sorted(kms))[:2]]
    return index.Indexes(rows(seqs, "set string, id string, seq string"), rows(k2i, "set string, kmer string, id string"), rows(places, "id string, dir string, pos int")), kms


def test_groups(spark, rows):
    ix, kms = hand_made(spark, rows)
    cfg = Config(k=4, max_group_reads=3)
    assert {(r.id, r.dir) for r in group.leads(ix, cfg).collect()} == {("L1", "a"), ("L2", "b")} == {(r.id, r.dir) for r in group.leads_by_window(ix, cfg).collect()}
    g = {r.lead.id: r for r in group.groups(ix, cfg).collect()}
    assert set(g) == {"L1", "L2"} and g["L1"].pos_b == [] and g["L2"].pos_a == [] and g["L1"].pos_a == list(range(7))
    assert {x.kmer for x in g["L2"].kmers_b} == kms and [x.id for x in g["L1"].reads_t] == ["t0", "t1", "t2"] and [x.id for x in g["L1"].reads_n] == ["n0"]
    assert sum(x.kept_n for x in g["L1"].kmers_a) == 2 and all((x.kept_t, x.dropped_t) == (3, 0) for x in g["L1"].kmers_a)
    assert {r.lead: (r.n, r.ids) for r in group.sets(ix, cfg).collect()}["L2"] == (4, ["n0", "t0", "t1", "t2"])
    s = group.selection_stats(ix, cfg).first()
    assert (s.iterated, s.existing, s.mapped, s.match_a, s.match_b) == (3, 3, 2, 1, 1)
    assert group.group_count(ix, cfg).first().groups == 2
    assert report.group_lines(2) == ["Groups 0: 2", "Number of groups: 2"]


def test_caps(spark, rows):
    ix, kms = hand_made(spark, rows, 4)
    cfg = Config(k=4, max_group_reads=3)
    g = {r.lead.id: r for r in group.groups(ix, cfg).collect()}
    assert g["L1"].reads_t == [] and all((x.kept_t, x.dropped_t) == (0, 4) for x in g["L1"].kmers_a)
    assert index.capped(ix.k2i, 4).filter("set = 'tn'").count() == len(kms) and index.capped(ix.k2i, 3).filter("set = 'tn'").count() == 0
    assert index.capped_rows(ix.k2i, 3).filter("set = 'tn'").count() == 0


def test_places_beyond_50_and_repeated_kmers(spark, rows):
    seq = "A" * 80
    places = [("L", "a", p) for p in (44, 45, 46, 47, 48, 50, 51, 52)]
    ix = index.Indexes(rows([("tm", "L", seq), ("tn", "t", seq)], "set string, id string, seq string"), rows([("tn", "AAAA", "t")], "set string, kmer string, id string"), rows(places, "id string, dir string, pos int"))
    cfg = Config(k=4)
    limited = group.kmer_table(ix, cfg).collect()
    assert sorted(r.pos for r in limited) == [44, 45, 46, 47, 48, 50] and {r.kept_t for r in limited} == {6}
    assert {r.kept_t for r in group.kmer_table(ix, cfg, None, per_entry=True).collect()} == {1} and len(group.kmer_table(ix, cfg, None).collect()) == 8
    assert group.groups(ix, cfg).first().pos_a == [44, 45, 46, 47, 48, 50, 51, 52]


@pytest.mark.parametrize("k", [3, 16, 17, 30, 31, 32, 40])
def test_keys_of_any_width(spark, rows, k):
    rng = random.Random(k)
    data = [(f"r{i}", i % 2, "".join(rng.choice("ACGTACGTACGTACGTN" if i % 3 else "ACGT") for _ in range(rng.randrange(0, 130))), None) for i in range(80)]
    data += [("all-t", 0, "T" * 70, None), ("all-a", 1, "A" * 70, None), ("exact", 0, "G" * k, None), ("short", 0, "G" * (k - 1), None)]
    want = sorted((i, j, s[j : j + k], rc(s[j : j + k]), min(s[j + 1 : j + k - 1], rc(s[j + 1 : j + k - 1]))) for i, _, s, _ in data for j in range(len(s) - k + 1) if "N" not in s[j : j + k])
    got = kmers.with_root(kmers.occurrences(rows(data, SCHEMA), k), k)
    got = got.select("id", "at", *[kmers.text(F.col(c), n, k) for c, n in (("kmer", k), ("rc", k), ("root", k - 2))])
    assert sorted(map(tuple, got.collect())) == want


def test_annotation_of_repeated_ids(spark, rows):
    from strandlake.sources import tables

    cfg = Config(k=4)
    table = count.root_table(rows([(f"r{i}", 1, "ACGTT", None) for i in range(3)], SCHEMA), cfg)
    asked = rows([("m", 0, "ACGT", None), ("m", 0, "CCGTT", None), ("m", 0, "ACGT", None), ("x", 0, "GG", None)], SCHEMA)
    got = sorted((r.id, r.seq, sorted(r.kmers.items())) for r in tables.annotation(asked, lambda df, keep: count.annotated(df, table, cfg, keep)).collect())
    assert got == [("m", "ACGT", [("0", [0, 3])])] * 2 + [("m", "CCGTT", [("0", [0, 0]), ("1", [0, 3])]), ("x", "GG", [])]
