"""Groups of reads around leaders.

A leader is a tumor read without N that has ``window_min`` candidate places within
``window_len`` bases in one direction.  Its group: the k-mers at its places, and the
reads of k2i that hold them, unless a k-mer has more than ``max_group_reads``.  Of a run
in several processes, each forms the groups of its own leaders.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import sequence as S
from ..session import give_back
from . import runs
from .filter import FEW_KNOWN, Indexes, set_of
from .kmers import text
from .merge import partition_of


def own_leads(rows: DataFrame, cfg: Config) -> DataFrame:
    """The rows that this process looks for leaders in, where a run is dealt to several."""
    return rows if cfg.num_partitions == 1 else rows.filter(partition_of("id", cfg.num_partitions) == cfg.pid)


def positions(ix: Indexes, cfg: Config) -> DataFrame:
    """(id, dir, positions, seq) of i2p reads with a sequence, positions ascending."""
    if ix.by_read is not None:
        rows = own_leads(ix.by_read.filter("kind = 1 and id is not null"), cfg)
        sides = F.array(*[F.struct(F.lit(d).alias("dir"), F.col(d).alias("positions")) for d in "ab"])
        return rows.select("id", F.explode(sides).alias("x"), "seq").select("id", "x.dir", "x.positions", "seq").filter(F.size("positions") > 0)
    rows = own_leads(ix.i2p, cfg).groupBy("id", "dir").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return rows.join(ix.seq.filter("set = 'tm'").select("id", "seq"), "id")


def _led(ix: Indexes, cfg: Config) -> DataFrame:
    """(id, seq, a, b) of leaders from rows of reads; a direction that leads to nothing is empty.  Kept, as it is read several times, unless the rows are for one reader."""
    name = ("led", cfg)
    if name not in ix.made:
        rows = own_leads(ix.by_read.filter("kind = 1 and id is not null"), cfg).filter(S.leads_possible(F.col("seq")))
        side = lambda d: F.when(S.dense(F.col(d), cfg.window_min, cfg.window_len), F.col(d)).otherwise(F.array().cast("array<int>"))
        found = rows.select("id", "seq", *[side(d).alias(d) for d in "ab"]).filter("size(a) + size(b) > 0")
        ix.made[name] = found if ix.once else found.persist()
    return ix.made[name]


def leads(ix: Indexes, cfg: Config) -> DataFrame:
    """(id, dir, positions, seq) of the directions that make their read a leader."""
    if ix.by_read is not None:
        sides = F.array(*[F.struct(F.lit(d).alias("dir"), F.col(d).alias("positions")) for d in "ab"])
        rows = _led(ix, cfg).select("id", F.explode(sides).alias("x"), "seq")
        return rows.select("id", "x.dir", "x.positions", "seq").filter(F.size("positions") > 0)
    rows = positions(ix, cfg).filter(S.leads_possible(F.col("seq")))
    return rows.filter(S.dense(F.col("positions"), cfg.window_min, cfg.window_len))


def leads_by_window(ix: Indexes, cfg: Config) -> DataFrame:
    """The same leaders by a window over places: (id, dir).

    From rows of reads, whose places are together and in order, the window is a shift of the places
    of many reads at once; else a window function, by a shuffle of all places.
    """
    if ix.by_read is not None:
        rows = own_leads(ix.by_read.filter("kind = 1 and id is not null"), cfg).filter(S.leads_possible(F.col("seq")))
        return runs.windowed(rows, cfg.window_min, cfg.window_len)
    from pyspark.sql import Window

    order = Window.partitionBy("id", "dir").orderBy("pos")
    able = own_leads(ix.seq.filter("set = 'tm'").filter(S.leads_possible(F.col("seq"))).select("id"), cfg)
    placed = ix.i2p.join(able, "id")
    ahead = placed.withColumn("ahead", F.lead("pos", cfg.window_min - 1).over(order))
    return ahead.filter(F.col("ahead") - F.col("pos") < cfg.window_len).select("id", "dir").distinct()


def lead_kmers(lead: DataFrame, cfg: Config, last: int | None = 50) -> DataFrame:
    """(id, dir, pos, kmer): k-mers at a leader's places, up to place ``last``."""
    rows = lead.select("id", "dir", S.directed(F.col("seq"), F.col("dir")).alias("seq"), F.explode("positions").alias("pos"))
    rows = rows if last is None else rows.filter(F.col("pos") <= last)
    return rows.select("id", "dir", "pos", F.expr(f"substring(seq, pos + 1, {cfg.k})").alias("kmer"))


def kmer_reads(ix: Indexes, cfg: Config) -> DataFrame:
    """(set, kmer, reads): reads of each k-mer under the filter's cap."""
    if ix.by_read is None:
        return ix.k2i.groupBy("set", "kmer").agg(F.count("*").alias("reads")).filter(F.col("reads") <= cfg.max_reads)
    rows = ix.by_read.select("kind", F.explode("keys").alias("key")).groupBy("kind", "key").agg(F.count("*").alias("reads")).filter(F.col("reads") <= cfg.max_reads)
    return rows.select(set_of(F.col("kind")).alias("set"), text(F.col("key"), cfg.k, cfg.k).alias("kmer"), "reads")


def kmer_table(ix: Indexes, cfg: Config, last: int | None = 50, per_entry: bool = False) -> DataFrame:
    """(id, dir, pos, kmer, kept_n, kept_t, dropped_n, dropped_t).

    A k-mer's counters add up over its occurrences in both directions of the leader, or
    stand for each entry alone with ``per_entry``.
    """
    known = None if ix.by_read is None else _known(ix, cfg, last)
    if known is not None:
        met = runs.entries(_led(ix, cfg), cfg.k, last, known).withColumn("kmer", text(F.col("key"), cfg.k, cfg.k))
        return _counters(met, cfg, F.lit(1).cast("long") if per_entry else F.col("times"))
    rows = lead_kmers(leads(ix, cfg), cfg, last)
    reads = kmer_reads(ix, cfg)
    wanted = reads.join(rows.select("kmer").distinct(), "kmer", "left_semi")
    wide = wanted.groupBy("kmer").agg(*[F.coalesce(F.sum(F.when(F.col("set") == s, F.col("reads"))), F.lit(0)).alias(x) for s, x in (("nn", "n"), ("tn", "t"))])
    met = rows.join(wide, "kmer", "left").na.fill(0, ["n", "t"])
    if per_entry:
        times = F.lit(1).cast("long")
    else:
        seen = rows.groupBy("id", "kmer").agg(F.count("*").alias("times"))
        met = met.join(seen, ["id", "kmer"])
        times = F.col("times")
    return _counters(met, cfg, times)


def _counters(met: DataFrame, cfg: Config, times: Column) -> DataFrame:
    kept = lambda c: F.when(F.col(c) <= cfg.max_group_reads, F.col(c) * times).otherwise(0)
    dropped = lambda c: F.when(F.col(c) > cfg.max_group_reads, F.col(c) * times).otherwise(0)
    return met.select("id", "dir", "pos", "kmer", *[f(c).cast("long").alias(f"{n}_{c}") for n, f in (("kept", kept), ("dropped", dropped)) for c in "nt"])


def _known(ix: Indexes, cfg: Config, last: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The leaders' keys, ascending, and the reads of both kinds that hold them, 0 above the filter's cap.

    None if there are too many keys for arrays, or if ids that are shared put places outside of their
    sequence.  The reads' lists are gone through once; only counters are shuffled.
    """
    name = ("known", cfg, last)
    if name not in ix.made:
        led = _led(ix, cfg)
        reach = F.greatest(F.coalesce(F.array_max("a"), F.lit(0)), F.coalesce(F.array_max("b"), F.lit(0)))
        keys = runs.entries(led, cfg.k, last).select("key").distinct().limit(FEW_KNOWN + 1).toArrow().column(0).to_numpy()
        if len(keys) > FEW_KNOWN or not led.filter(reach + cfg.k > F.length("seq")).isEmpty():
            ix.made[name] = None
        else:
            keys, counters = np.sort(keys), np.zeros((len(keys), 2), np.int64)
            if len(keys):
                of = runs.counted(ix.by_read, keys).toArrow()
                counters[of.column("nth").to_numpy(), of.column("kind").to_numpy()] = of.column("n").to_numpy()
            counters[counters > cfg.max_reads] = 0
            ix.made[name] = keys, counters
            give_back(led.sparkSession)
    return ix.made[name]


def _members(ix: Indexes, known: tuple[np.ndarray, np.ndarray], cfg: Config, last: int | None) -> DataFrame:
    """(lead, kind, id), distinct: reads that hold a leader's k-mer which is under both caps.

    Keys are looked up in the reads' lists, so only what belongs to a group is shuffled.
    """
    keys, counters = known
    under = (counters > 0) & (counters <= cfg.max_group_reads)
    held = runs.holding(ix.by_read, np.sort(np.concatenate([2 * keys[under[:, kind]] + kind for kind in (0, 1)])))
    of_leads = runs.entries(_led(ix, cfg), cfg.k, last).select(F.col("id").alias("lead"), "key").distinct()
    return held.join(of_leads, "key").select("lead", "kind", "id").distinct()


def read_table(ix: Indexes, cfg: Config, last: int | None = 50) -> DataFrame:
    """(lead, set, id, seq): distinct reads of each leader's group."""
    rows = lead_kmers(leads(ix, cfg), cfg, last).select(F.col("id").alias("lead"), "kmer").distinct()
    known = None if ix.by_read is None else _known(ix, cfg, last)
    if known is not None:
        members = _members(ix, known, cfg, last)
        seqs = ix.by_read.filter("id is not null").select("kind", "id", "seq")
        return members.join(seqs, ["kind", "id"]).select("lead", set_of(F.col("kind")).alias("set"), "id", "seq")
    few = kmer_reads(ix, cfg).filter(F.col("reads") <= cfg.max_group_reads).select("set", "kmer")
    # Reads are cut down to the leaders' k-mers before they meet the leaders.
    members = ix.k2i.join(few, ["set", "kmer"], "left_semi").join(rows, "kmer").select("lead", "set", "id").distinct()
    return members.join(ix.seq, ["set", "id"]).select("lead", "set", "id", "seq")


def groups(ix: Indexes, cfg: Config, last: int | None = 50, per_entry: bool = False) -> DataFrame:
    """One nested row to a leader: lead, pos_a, pos_b, kmers_a, kmers_b, reads_n, reads_t."""
    lead = leads(ix, cfg)
    of = lambda d, c: F.flatten(F.collect_list(F.when(F.col("dir") == d, F.col(c))))
    base = lead.groupBy(F.col("id").alias("lead_id")).agg(F.min("seq").alias("lead_seq"), of("a", "positions").alias("pos_a"), of("b", "positions").alias("pos_b"))
    entry = F.struct("pos", F.struct("kmer", "kept_n", "kept_t", "dropped_n", "dropped_t").alias("e"))
    table = kmer_table(ix, cfg, last, per_entry).withColumn("entry", entry)
    in_order = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("dir") == d, F.col("entry")))), lambda x: x.e)
    kmers = table.groupBy(F.col("id").alias("lead_id")).agg(in_order("a").alias("kmers_a"), in_order("b").alias("kmers_b"))
    reads = read_table(ix, cfg, last).withColumn("read", F.struct("id", "seq"))
    members = lambda s: F.array_sort(F.collect_list(F.when(F.col("set") == s, F.col("read"))))
    reads = reads.groupBy(F.col("lead").alias("lead_id")).agg(members("nn").alias("reads_n"), members("tn").alias("reads_t"))
    none = F.array().cast("array<struct<id:string,seq:string>>")
    bare = F.array().cast("array<struct<kmer:string,kept_n:bigint,kept_t:bigint,dropped_n:bigint,dropped_t:bigint>>")
    out = base.join(kmers, "lead_id", "left").join(reads, "lead_id", "left")
    return out.select(F.struct(F.col("lead_id").alias("id"), F.col("lead_seq").alias("seq")).alias("lead"), "pos_a", "pos_b", F.coalesce("kmers_a", bare).alias("kmers_a"), F.coalesce("kmers_b", bare).alias("kmers_b"), F.coalesce("reads_n", none).alias("reads_n"), F.coalesce("reads_t", none).alias("reads_t"))


def sets(ix: Indexes, cfg: Config, last: int | None = None) -> DataFrame:
    """(lead, n, ids): distinct ids of both kinds, sorted."""
    rows = read_table(ix, cfg, last).select("lead", "id").distinct()
    found = rows.groupBy("lead").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    every = leads(ix, cfg).select(F.col("id").alias("lead")).distinct().join(found, "lead", "left")
    every = every.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return every.select("lead", F.size("ids").cast("long").alias("n"), "ids")


def selection_stats(ix: Indexes, cfg: Config) -> DataFrame:
    """One row: iterated, existing, mapped, match_a, match_b."""
    hit = lambda c: S.dense(F.col(c), cfg.window_min, cfg.window_len).cast("int")
    if ix.by_read is not None:
        per_read = ix.by_read.filter("kind = 1 and size(a) + size(b) > 0").select("id", hit("a").alias("a"), hit("b").alias("b"), F.when(F.col("id").isNotNull(), F.col("seq")).alias("seq"))
    else:
        rows = ix.i2p.groupBy("id", "dir").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
        match = lambda d: F.max(F.when(F.col("dir") == d, hit("positions")).otherwise(0))
        per_read = rows.groupBy("id").agg(match("a").alias("a"), match("b").alias("b")).join(ix.seq.filter("set = 'tm'").select("id", "seq"), "id", "left")
    exists, mapped = F.col("seq").isNotNull(), F.coalesce(S.leads_possible(F.col("seq")), F.lit(False))
    if cfg.num_partitions > 1:  # every process looks at all reads and maps its own
        mapped = mapped & (partition_of("id", cfg.num_partitions) == cfg.pid)
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return per_read.agg(
        F.count("*").alias("iterated"), total(exists).alias("existing"), total(mapped).alias("mapped"), total(mapped & (F.col("a") == 1)).alias("match_a"), total(mapped & (F.col("b") == 1)).alias("match_b")
    )


def group_count(ix: Indexes, cfg: Config) -> DataFrame:
    return leads(ix, cfg).agg(F.countDistinct("id").alias("groups"))
