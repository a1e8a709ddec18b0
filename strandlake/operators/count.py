"""k-mer frequencies by kind, and what is computed from them.

A k-mer and its reverse complement are counted in one row, so the candidate test needs
no look-up.  Where the total of a root matters, one more shuffle brings its rows together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Config
from ..functions import sequence as S
from . import kmers as K, runs

COUNTERS = runs.COUNTERS


def pair_counts(reads: DataFrame, cfg: Config, roots: DataFrame | None = None) -> DataFrame:
    """(a, b, a_n, a_t, b_n, b_t): a k-mer, its reverse complement (both as keys) and their
    counters, not saturated.

    One shuffle, of sums from the map side.  With ``roots``, occurrences of other roots are
    dropped before they are counted.
    """
    rows = K.occurrences(reads, cfg.k, ("kind",))
    if roots is not None:
        rows = K.with_root(rows, cfg.k).join(roots.select("root"), "root", "left_semi")
    side = lambda c, kind: F.count(F.when(c & (F.col("kind") == kind), 1))
    ahead = F.col("ahead")
    rows = rows.select("kind", F.least("kmer", "rc").alias("a"), (F.col("kmer") <= F.col("rc")).alias("ahead"))
    sums = rows.groupBy("a").agg(side(ahead, 0).alias("a_n"), side(ahead, 1).alias("a_t"), side(~ahead, 0).alias("b_n"), side(~ahead, 1).alias("b_t"))
    return K.with_complement(sums, "a", "b", cfg.k)


def _saturated(pairs: DataFrame, cfg: Config, *more: Column) -> DataFrame:
    return pairs.select(K.root(F.col("a"), F.col("b"), cfg.k).alias("root"), *more, "a", "b", *[S.saturated(F.col(c)).alias(c) for c in COUNTERS])


def _of_root() -> WindowSpec:
    return Window.partitionBy("root")


def root_table(reads: DataFrame, cfg: Config, once: bool | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, total, a, b, a_n, a_t, b_n, b_t): pairs with saturated counters and their root's total.

    The pairs of a root, 16 at most, are brought together so that each learns the total: in one
    shuffle of runs of k-mers if k-mers are packed, else in a second one.  Roots that occur once in all are dropped unless ``once`` (by default if there is
    no cache).
    """
    once = not cfg.enable_cache if once is None else once
    if cfg.k <= K.PACKED and roots is None:
        return runs.pair_table(reads, cfg.k, S.SATURATED, None if once else lambda counters, total: total >= 2)
    total = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    table = _saturated(pair_counts(reads, cfg, roots), cfg, total.alias("total")).withColumn("total", F.sum("total").over(_of_root()))
    return table if once else table.filter("total >= 2")


def cells(table: DataFrame, cfg: Config) -> DataFrame:
    """(root, kmer, rc, n, t, n_rc, t_rc): a k-mer's counters and its reverse complement's.

    A complement that wasn't seen has zeros; so has that of a k-mer whose stem is its
    own reverse complement.
    """
    rows = table.withColumn("own", K.own(F.col("a"), F.col("b"), cfg.k))
    zero = F.lit(0).cast("long")
    cell = lambda x, y: F.struct(F.col(x).alias("kmer"), F.col(y).alias("rc"), F.col(f"{x}_n").alias("n"), F.col(f"{x}_t").alias("t"), *[F.when(F.col("own"), zero).otherwise(F.col(f"{y}_{c}")).alias(f"{c}_rc") for c in "nt"])
    return rows.select("root", F.inline(F.array(cell("a", "b"), cell("b", "a")))).filter("n + t > 0")


def decoded(rows: DataFrame, cfg: Config) -> DataFrame:
    """Rows with the bases of their ``kmer``."""
    return rows.withColumn("kmer", K.text(F.col("kmer"), cfg.k, cfg.k))


def kmer_counts(table: DataFrame, cfg: Config) -> DataFrame:
    """(root, kmer, n, t), the k-mers as strings."""
    return decoded(cells(table, cfg).select("root", "kmer", "n", "t"), cfg)


def _condition(cfg: Config, a_n, a_t, b_n, b_t) -> Column:
    return (a_t >= cfg.min_tumor_a) & (a_n <= cfg.max_normal_a) & (b_t >= cfg.min_tumor_b) & (b_n <= cfg.max_normal_b)


def _hit(cfg: Config) -> Column:
    return _condition(cfg, F.col("n"), F.col("t"), F.col("n_rc"), F.col("t_rc"))


def _one_sided(cfg: Config, n, t) -> Column:
    """What a k-mer needs to be the one or the other side of a candidate."""
    return ((t >= cfg.min_tumor_a) & (n <= cfg.max_normal_a)) | ((t >= cfg.min_tumor_b) & (n <= cfg.max_normal_b))


def candidates(table: DataFrame, cfg: Config) -> DataFrame:
    """(root, kmer, n, t, n_rc, t_rc) of candidate k-mers, as strings, with both sides' counters."""
    pair = ("a_n", "a_t", "b_n", "b_t")
    able = _one_of(pair, lambda n, t: (t >= cfg.min_tumor_a) & (n <= cfg.max_normal_a))
    return decoded(cells(table.filter(able), cfg).filter(_hit(cfg)).drop("rc"), cfg)


def candidates_of(reads: DataFrame, cfg: Config) -> DataFrame:
    """The same straight from reads.

    A candidate that occurs twice has a root that does, so totals of roots, and the shuffle
    for them, are only needed if one occurrence can make a candidate.
    """
    if cfg.enable_cache and cfg.min_tumor_a < 2:
        return candidates(root_table(reads, cfg), cfg)
    if cfg.k <= K.PACKED:
        least, most = cfg.min_tumor_a, cfg.max_normal_a
        able = lambda c, total: ((c[:, 1] >= least) & (c[:, 0] <= most)) | ((c[:, 3] >= least) & (c[:, 2] <= most))
        return candidates(runs.pair_table(reads, cfg.k, S.SATURATED, able), cfg)
    return candidates(_saturated(pair_counts(reads, cfg), cfg), cfg)


def _one_of(counters: tuple[str, ...], test: Callable[[Column, Column], Column]) -> Column:
    a_n, a_t, b_n, b_t = (F.col(c) for c in counters)
    return test(a_n, a_t) | test(b_n, b_t)


def stem_counts(table: DataFrame, cfg: Config) -> DataFrame:
    """(stem, root, kmers, n, t, open, ord), stems and roots as keys: each stem's sums;
    open if a k-mer passes one side."""
    rows = cells(table, cfg).withColumn("stem", K.stem(F.col("kmer"), cfg.k)).withColumn("ord", K.orientation(F.col("kmer"), F.col("rc"), cfg.k))
    return rows.groupBy("stem", "root").agg(
        F.count("*").alias("kmers"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.bool_or(_one_sided(cfg, F.col("n"), F.col("t"))).alias("open"), F.max("ord").alias("ord")
    )


def prefiltered(table: DataFrame, cfg: Config) -> DataFrame:
    """Pairs of roots that hold a candidate; the pairs of a root are together already."""
    own, zero = K.own(F.col("a"), F.col("b"), cfg.k), F.lit(0).cast("long")
    other = lambda c: F.when(own, zero).otherwise(F.col(c))
    side = lambda x, y: _condition(cfg, F.col(f"{x}_n"), F.col(f"{x}_t"), other(f"{y}_n"), other(f"{y}_t"))
    return table.withColumn("_holds", F.max(side("a", "b") | side("b", "a")).over(_of_root())).filter("_holds").drop("_holds")


def export_range(table: DataFrame, cfg: Config) -> DataFrame:
    """k-mers with a counter strictly between the export bounds."""
    within = lambda c: (F.col(c) > cfg.export_min) & (F.col(c) < cfg.export_max)
    return decoded(cells(table, cfg).filter(within("n") | within("t")).select("kmer", "n", "t"), cfg)


def annotated(reads: DataFrame, table: DataFrame, cfg: Config, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, at, kmer, n, t) of reads' k-mers with a known root; zeros if the k-mer wasn't seen."""
    rows = K.with_root(K.occurrences(reads, cfg.k, keep), cfg.k)
    pairs = table.groupBy("root").agg(F.collect_list(F.struct("a", *COUNTERS)).alias("pairs"))
    met = rows.join(pairs, "root").withColumn("pair", F.get(F.filter("pairs", lambda p: p.a == F.least("kmer", "rc")), F.lit(0)))
    of = lambda c: F.coalesce(F.when(F.col("kmer") <= F.col("rc"), F.col(f"pair.a_{c}")).otherwise(F.col(f"pair.b_{c}")), F.lit(0).cast("long")).alias(c)
    return decoded(met.select(*keep, "at", "kmer", of("n"), of("t")), cfg)


def annotated_reads(reads: DataFrame, cfg: Config) -> DataFrame:
    """(id, at, kmer, n, t), the same for reads (id, kind, seq, counted), with the counters of those that are ``counted``.

    Up to 31 bases nothing is joined: k-mers are counted and looked up in their bin.
    """
    if cfg.k <= K.PACKED:
        return runs.annotated(reads, cfg.k, S.SATURATED, known_from(cfg), lines=False)
    return annotated(reads, root_table(reads.filter("counted"), cfg), cfg)


def known_from(cfg: Config) -> int:
    """The least total of a root in ``root_table``."""
    return 2 if cfg.enable_cache else 1


def _by_root(table: DataFrame, cfg: Config) -> DataFrame:
    """Each root's stems, k-mers, sums and hits by orientation."""
    rows = cells(table, cfg).select("root", K.orientation(F.col("kmer"), F.col("rc"), cfg.k).alias("o"), "n", "t", _hit(cfg).cast("int").alias("hit"))
    of = lambda o, c: F.sum(F.when(F.col("o") == o, F.col(c)).otherwise(0))
    return rows.groupBy("root").agg(
        F.count("*").alias("kmers"), of(0, "hit").alias("h0"), of(1, "hit").alias("h1"), *[of(o, c).alias(f"{c}{o}") for o in (0, 1) for c in "nt"]
    )


def stats(table: DataFrame, cfg: Config, compat: bool = True) -> DataFrame:
    """One row: roots, stems, once, kmers, sum, hits_roots, hits_stems, hits_kmers.

    ``compat`` counts hits as the established report does, adding the first
    orientation's once more; otherwise they are distinct roots, stems and k-mers.
    """
    r = _by_root(table, cfg)
    s0, s1 = F.col("n0") + F.col("t0"), F.col("n1") + F.col("t1")
    yes = lambda c: c.cast("long")
    h0, h1 = F.col("h0") > 0, F.col("h1") > 0
    if compat:
        hits = yes(h0) + yes(h0 | h1), 2 * yes(h0) + yes(h1), 2 * F.col("h0") + F.col("h1")
    else:
        hits = yes(h0 | h1), yes(h0) + yes(h1), F.col("h0") + F.col("h1")
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(c), zero).cast("long")
    return r.agg(
        F.count("*").alias("roots"), total(yes(s0 >= 1) + yes(s1 >= 1)).alias("stems"), total(yes(s0 == 1) + yes(s1 == 1)).alias("once"), total(F.col("kmers")).alias("kmers"),
        total(s0 + s1).alias("sum"), total(hits[0]).alias("hits_roots"), total(hits[1]).alias("hits_stems"), total(hits[2]).alias("hits_kmers"),
    )


def histograms(table: DataFrame, cfg: Config) -> DataFrame:
    """(kind, bin, low, stems): log2 bins of stems' sums, by kind."""
    rows = stem_counts(table, cfg).select(F.explode(F.array(F.struct(F.lit("N").alias("kind"), F.col("n").alias("x")), F.struct(F.lit("T").alias("kind"), F.col("t").alias("x")))).alias("v"))
    rows = rows.select("v.kind", S.log2_bin(F.col("v.x")).alias("bin"), "v.x").filter("x > 0")
    return rows.groupBy("kind", "bin").agg(F.count("*").alias("stems")).withColumn("low", F.expr("shiftleft(1L, bin)")).select("kind", "bin", "low", "stems")
