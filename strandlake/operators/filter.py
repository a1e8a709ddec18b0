"""Indexes of the reads that hold candidate k-mers.

``k2i`` (set, kmer, id): reads of a kind with any k-mer on a candidate's root, whatever
its first and last base.  ``i2p`` (id, dir, pos): places of tumor reads where the
candidate itself stands, ahead (a) or on the other strand (b).  ``seq`` (set, id, seq):
those reads.  The sets: nn and tn, normal and tumor reads of k2i; tm, reads of i2p.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import sequence as S
from ..session import give_back
from . import runs
from .kmers import PACKED, key, occurrences, own, segment_place, text, with_root


#: Rows that may be broadcast: some 20 MB of k-mers or ids.  Candidates that may be, as arrays: 64 MB.
FEW, FEW_KNOWN = 200_000, 4_000_000


@dataclass
class Indexes:
    seq: DataFrame
    k2i: DataFrame
    i2p: DataFrame
    #: (kind, id, seq, keys, a, b, tags): what a read is in, in one row, where the indexes were made from such rows.
    by_read: DataFrame | None = None
    #: What ``group`` has made from ``by_read`` already.
    made: dict = field(default_factory=dict)
    #: The rows are made where they are read, for one reader, and nothing made of them is kept.
    once: bool = False


def set_of(kind):
    return F.when(kind == 0, "nn").otherwise("tn")


def few(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if a look shows that there are at most ``FEW``.

    Without the look Spark would shuffle the other side, all occurrences, before it knows.
    ``rows`` should be persisted: the look computes them.
    """
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def known(candidates: DataFrame) -> pa.Table | None:
    """The candidates by root, if there are some and at most ``FEW_KNOWN``: the step that cuts the
    reads looks them up, and other places don't leave it."""
    rows = candidates.limit(FEW_KNOWN + 1).toArrow()
    return rows.sort_by("root") if 0 < len(rows) <= FEW_KNOWN else None


def hits(reads: DataFrame, candidates: DataFrame, cfg: Config, tags: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, key, dir, pos, tags): every place where a read meets a candidate's root, with the
    candidate's key; ``dir`` is null, and ``pos``, unless the candidate itself stands there in a
    tumor read.

    The reads are cut into k-mers once, for both indexes.  Up to ``FEW_KNOWN`` candidates are
    looked up where that is done; where there are more, Spark joins, and splits frequent roots.
    Places count from the start of the segment; on strand b from the read's other end.
    """
    wanted = candidates.select("root", key(F.col("kmer"), cfg.k).alias("key"), *tags)
    table = known(wanted) if cfg.k <= PACKED else None
    if table is not None:
        return runs.met(reads, cfg.k, table, wanted.schema)
    cut = reads.select("id", "kind", "seq", F.length("seq").alias("len"), F.when(F.contains("seq", F.lit("N")), F.col("seq")).alias("split"))
    met = with_root(occurrences(cut, cfg.k, ("id", "kind", "len", "split")), cfg.k).join(few(wanted), "root")
    ahead = F.col("kmer") == F.col("key")
    behind = (F.col("rc") == F.col("key")) & ~own(F.col("kmer"), F.col("rc"), cfg.k)
    dir_ = F.when(F.col("kind") == 1, F.when(ahead, "a").when(behind, "b"))
    place = F.when(F.col("split").isNull(), F.col("at")).otherwise(segment_place(F.col("split"), F.col("at")))
    pos = F.when(F.col("dir") == "a", place).when(F.col("dir") == "b", F.col("len") - cfg.k - place)
    return met.withColumn("dir", dir_).select("id", "kind", "key", "dir", pos.alias("pos"), *tags)


def k2i(met: DataFrame, cfg: Config, tags: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Keys are kept, and made into bases where they are read."""
    rows = keep(met.select("kind", "key", "id", *tags).distinct())
    return rows.select(set_of(F.col("kind")).alias("set"), text(F.col("key"), cfg.k, cfg.k).alias("kmer"), "id", *tags)


def i2p(met: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    return met.filter("dir is not null").select("id", "dir", "pos", *tags).distinct()


def seq(reads: DataFrame, met: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """Duplicate ids keep the least sequence of their kind.  A read is shuffled once for all its sets."""
    ids = met.groupBy("kind", "id", *tags).agg(F.count("dir").alias("placed"))
    best = reads.select("kind", "id", "seq").join(few(ids), ["kind", "id"]).groupBy("kind", "id", *tags).agg(F.min("seq").alias("seq"), F.max("placed").alias("placed"))
    sets = F.when(F.col("kind") == 0, F.array(F.lit("nn"))).when(F.col("placed") > 0, F.array(F.lit("tn"), F.lit("tm"))).otherwise(F.array(F.lit("tn")))
    return best.select(F.explode(sets).alias("set"), "id", *tags, "seq")


def shared_ids(each: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(_hash) of kinds and ids that several reads have, or None; of rows (kind, id, own), of which ``own`` counts reads."""
    shared = keep(each.groupBy(F.xxhash64("kind", "id").alias("_hash")).agg(F.sum("own").alias("n")).filter("n > 1").select("_hash"))
    return None if shared.isEmpty() else shared


def one_row_a_read(rows: DataFrame, reads: DataFrame, tags: tuple[str, ...], shared: DataFrame | None) -> DataFrame:
    """Rows of ``runs.by_read`` that hit, one for each kind, id and tags.

    Reads mostly have their own ids, and then nothing is shuffled but hashes of ids.  Reads that share
    one are united, with the least sequence of all reads of that id and kind.
    """
    hash_ = F.xxhash64("kind", "id")
    rows = rows.filter("seq is not null").drop("own")
    if shared is None:
        return rows
    shared = few(shared)
    tagged = rows.withColumn("_hash", hash_)
    least = reads.select("kind", "id", "seq").withColumn("_hash", hash_).join(shared, "_hash", "left_semi").groupBy("kind", "id").agg(F.min("seq").alias("_least"))
    some = tagged.join(shared, "_hash", "left_semi").drop("_hash")
    same = some["kind"].eqNullSafe(least["kind"]) & some["id"].eqNullSafe(least["id"])
    some = some.join(least, same, "left").select(*[some[c] for c in some.columns if c != "seq"], "_least").withColumnRenamed("_least", "seq")
    return tagged.join(shared, "_hash", "left_anti").drop("_hash").unionByName(runs.united(some, tags))


def of_reads(rows: DataFrame, cfg: Config, tags: tuple[str, ...] = ()) -> Indexes:
    """The indexes from rows of reads, one for each kind, id and tags.  Nothing is shuffled."""
    placed = (F.col("kind") == 1) & (F.size("a") + F.size("b") > 0)
    sets = F.when(F.col("kind") == 0, F.array(F.lit("nn"))).when(placed, F.array(F.lit("tn"), F.lit("tm"))).otherwise(F.array(F.lit("tn")))
    by_set = rows.filter("id is not null").select(F.explode(sets).alias("set"), "id", *tags, "seq")
    by_kmer = rows.select(set_of(F.col("kind")).alias("set"), F.explode("keys").alias("kmer"), "id", *tags)
    by_kmer = by_kmer.withColumn("kmer", text(F.col("kmer"), cfg.k, cfg.k))
    by_place = rows.select("id", F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), F.col(d).alias("at")) for d in "ab"])).alias("x"), *tags)
    by_place = by_place.select("id", "x.dir", F.explode("x.at").alias("pos"), *tags)
    return Indexes(by_set, by_kmer, by_place, rows)


def indexes(reads: DataFrame, candidates: DataFrame, cfg: Config, tags: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = False) -> Indexes:
    """``tags`` are columns of the candidates that all rows carry on; ``keep`` may persist
    what several indexes are made from (all but the reads is small).  With ``once``, for one
    reader of one index, the reads' rows are not kept.

    Up to ``FEW_KNOWN`` candidates the reads' rows are what is kept, and the counting's shuffle is
    given back.  Where there are more, occurrences are joined and each index is kept.
    """
    was = candidates.is_cached
    candidates = keep(candidates)
    wanted = candidates.select("root", key(F.col("kmer"), cfg.k).alias("key"), *tags)
    table = known(wanted) if cfg.k <= PACKED else None
    if table is not None:
        schema = wanted.schema
        if candidates.is_cached and not was:
            candidates.unpersist()
        del wanted
        give_back(reads.sparkSession)
        rows = runs.by_read(reads, cfg.k, table, schema)
        # To be kept the rows are made anyway; else hashes of ids come from the reads, whatever these meet.
        rows = rows if once else keep(rows)
        shared = shared_ids(reads.filter("kind is not null").select("kind", "id", F.lit(1).alias("own")) if once else rows, keep)
        ix = of_reads(one_row_a_read(rows, reads, tags, shared), cfg, tags)
        ix.once = once
        if once and shared is None:
            give_back(reads.sparkSession)
            if not tags:
                ix.k2i = runs.held(reads, cfg.k, table)
        return ix
    met = keep(hits(reads, candidates, cfg, tags))
    return Indexes(keep(seq(reads, met, tags)), k2i(met, cfg, tags, keep), keep(i2p(met, tags)))


def capped(by_kmer: DataFrame, most: int) -> DataFrame:
    """(set, kmer, n) of k-mers with at most ``most`` reads."""
    return by_kmer.groupBy("set", "kmer").agg(F.count("*").alias("n")).filter(F.col("n") <= most)


def capped_rows(by_kmer: DataFrame, most: int) -> DataFrame:
    """k2i without the k-mers above the cap; few k-mers are above it, so they are looked for."""
    over = by_kmer.groupBy("set", "kmer").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return by_kmer.join(over.select("set", "kmer"), ["set", "kmer"], "left_anti")


def bitmaps(by_place: DataFrame) -> DataFrame:
    """(id, dir, word, bits): words of 64 places."""
    rows = by_place.select("id", "dir", F.floor(F.col("pos") / 64).cast("int").alias("word"), S.bit(F.col("pos")).alias("bit"))
    return rows.groupBy("id", "dir", "word").agg(F.bit_or("bit").alias("bits"))


def bitmap_words(positions, words: int):
    """The bitmap of one row's places, as an array of ``words`` words of 64."""
    of = lambda w: F.aggregate(F.filter(positions, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(S.bit(p)))
    return F.array(*[of(w) for w in range(words)])


def sizes(ix: Indexes) -> DataFrame:
    """(index, set, n): distinct ids of seq and i2p, distinct k-mers of k2i."""
    one = ix.seq.groupBy("set").agg(F.countDistinct("id").alias("n")).select(F.lit("seq").alias("index"), "set", "n")
    two = ix.k2i.groupBy("set").agg(F.countDistinct("kmer").alias("n")).select(F.lit("k2i").alias("index"), "set", "n")
    three = ix.i2p.agg(F.countDistinct("id").alias("n")).select(F.lit("i2p").alias("index"), F.lit("tm").alias("set"), "n")
    return one.unionByName(two).unionByName(three)
