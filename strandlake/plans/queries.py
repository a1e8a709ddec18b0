"""Registered queries, one for each operator, over reads made from ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import sequence as S
from ..operators import count, filter as index, group, kmers, merge, prune
from ..session import scratch
from ..sources import derived, fastq, tables

CFG = Config(k=16, max_normal_a=1, min_tumor_a=4, max_normal_b=1, min_tumor_b=1)
DEFAULT_K = Config(k=30, max_normal_a=1, min_tumor_a=4, max_normal_b=1, min_tumor_b=1)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.reads(spark, sf_dir)


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.quality_filtered(_raw(spark, sf_dir))


def _all_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads, cleaned; ``counted`` are those of ``_reads``."""
    return kmers.quality_filtered(_raw(spark, sf_dir).withColumn("counted", S.passes_quality(F.col("qual"))), check=False)


def _table(spark: SparkSession, sf_dir: str, cfg: Config = CFG) -> DataFrame:
    return count.root_table(_reads(spark, sf_dir), cfg)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The reads, and the few candidates among their k-mers."""
    reads = _reads(spark, sf_dir)
    return reads, count.candidates_of(reads, CFG).select("root", "kmer")


def _kept(rows: DataFrame) -> DataFrame:
    """Kept as compressed bytes: sequences and lists are large as objects, and what memory can't hold goes to disk."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _indexes(spark: SparkSession, sf_dir: str, once: bool = False) -> index.Indexes:
    """The indexes; the reads are cut once for counting and once for all of them, or for the one that is read."""
    reads, found = _candidates(spark, sf_dir)
    return index.indexes(reads, found, CFG, keep=_kept, once=once)


def read_quality_filter(spark, d):
    return _raw(spark, d).filter(S.passes_quality(F.col("qual"))).select("id", "kind", "seq")


def low_quality_histogram(spark, d):
    return _raw(spark, d).groupBy("kind", S.low_quality(F.col("qual")).alias("low")).agg(F.count("*").alias("reads"))


def n_split_segments(spark, d):
    return kmers.segments(_reads(spark, d), CFG.k)


def kmer_explode(spark, d):
    rows = kmers.occurrences(_reads(spark, d), CFG.k, ("id",))
    text = lambda f: kmers.text(f("kmer"), CFG.k, CFG.k)
    return rows.groupBy("id").agg(F.count("*").alias("kmers"), text(F.min).alias("least"), text(F.max).alias("greatest"), F.sum("at").alias("places"))


def revcomp_reads(spark, d):
    return _reads(spark, d).select("id", S.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"))


def encode_stems(spark, d):
    rows = kmers.occurrences(_reads(spark, d), CFG.k, ()).groupBy(kmers.stem(F.col("kmer"), CFG.k).alias("key")).agg(F.count("*").alias("n"))
    rows = rows.select("n", kmers.text(F.col("key"), CFG.stem_len, CFG.k).alias("stem"))
    code = S.encode(F.col("stem"))
    return rows.select("stem", "n", code.alias("code"), S.decode(code, CFG.k - 2).alias("decoded"), S.reverse_complement_code(code, CFG.k - 2).alias("rc_code"))


def canonical_roots(spark, d):
    rows = kmers.occurrences(_reads(spark, d), CFG.k, ()).groupBy("kmer").agg(F.count("*").alias("n"))
    rows = rows.select("n", kmers.text(F.col("kmer"), CFG.k, CFG.k).alias("kmer"))
    stem = S.stem(F.col("kmer"), CFG.k)
    rows = rows.select("n", S.root(stem).alias("root"), S.orientation(stem).alias("ord"), S.first_base(F.col("kmer")).alias("first"), S.last_base(F.col("kmer")).alias("last"))
    return rows.select("root", "ord", "first", "last", "n", S.kmer_of(F.col("root"), F.col("first"), F.col("last"), F.col("ord")).alias("kmer"))


def partition_code(spark, d):
    root = kmers.text(F.col("root"), CFG.stem_len, CFG.k)
    rows = _table(spark, d).select("root").distinct().select(F.substring(root, (CFG.stem_len - 6) // 2 + 1, 6).alias("sixmer")).groupBy("sixmer")
    return rows.agg(F.count("*").alias("roots")).withColumn("code", S.partition_code(F.col("sixmer")))


def kmer_counts(spark, d):
    return count.kmer_counts(_table(spark, d), CFG).select("kmer", "n", "t")


def kmer_counts_nocache(spark, d):
    return count.kmer_counts(count.root_table(_reads(spark, d), CFG, once=True), CFG).select("kmer", "n", "t")


def kmer_counts_k30(spark, d):
    return count.kmer_counts(_table(spark, d, DEFAULT_K), DEFAULT_K).select("kmer", "n", "t")


def _root_text(rows: DataFrame, column: str = "root") -> DataFrame:
    return rows.withColumn(column, kmers.text(F.col(column), CFG.stem_len, CFG.k))


def repeated_roots(spark, d):
    return _root_text(prune.repeated_roots(_reads(spark, d), CFG.k))


def prune_semi_join(spark, d):
    return prune.of_reads(_reads(spark, d), CFG.k, _kept)


def pruned_counts(spark, d):
    """Counts of occurrences whose root was seen to repeat before anything was counted."""
    reads = _reads(spark, d)
    table = count.root_table(reads, CFG, once=True, roots=prune.repeated_roots(reads, CFG.k))
    return count.kmer_counts(table, CFG).select("kmer", "n", "t")


def stem_counts(spark, d):
    return _root_text(_root_text(count.stem_counts(_table(spark, d), CFG)), "stem")


def prefiltered_roots(spark, d):
    seen = (F.col("a_n") + F.col("a_t") > 0).cast("long") + (F.col("b_n") + F.col("b_t") > 0).cast("long")
    return _root_text(count.prefiltered(_table(spark, d), CFG).groupBy("root").agg(F.max("total").alias("total"), F.sum(seen).alias("kmers")))


def candidate_kmers(spark, d):
    return count.candidates_of(_reads(spark, d), CFG).select("kmer", "n", "t", "n_rc", "t_rc")


def candidate_kmers_k30(spark, d):
    return count.candidates_of(_reads(spark, d), DEFAULT_K).select("kmer", "n", "t", "n_rc", "t_rc")


def export_range(spark, d):
    return count.export_range(_table(spark, d), Config(k=16, export_min=2, export_max=6))


def annotate_kmers(spark, d):
    return count.annotated_reads(_all_reads(spark, d), CFG)


def count_stats(spark, d):
    return count.stats(_table(spark, d), CFG)


def count_stats_distinct(spark, d):
    return count.stats(_table(spark, d), CFG, compat=False)


def count_histogram(spark, d):
    return count.histograms(_table(spark, d), CFG)


def index_seq(spark, d):
    return _indexes(spark, d).seq


def index_k2i(spark, d):
    return _indexes(spark, d, once=True).k2i


def k2i_capped(spark, d):
    return index.capped(_indexes(spark, d).k2i, 10)


def index_i2p(spark, d):
    return _indexes(spark, d).i2p


def i2p_bitmap(spark, d):
    return index.bitmaps(_indexes(spark, d).i2p)


def i2p_positions(spark, d):
    """Bitmaps, to text and back, as positions."""
    ix = _indexes(spark, d, once=True)
    # A step of its own: within the look at each place the words would be made once more.
    as_text = lambda rows, full: rows.select("id", "dir", S.words_of_hex(S.hex_words(full)).alias("w")).select("id", "dir", F.array_join(S.positions_of(F.col("w")).cast("array<string>"), " ").alias("positions"))
    if ix.by_read is not None:  # a read's places are in one row, so its bitmap is made there
        sides = F.array(*[F.struct(F.lit(d).alias("dir"), F.col(d).alias("at")) for d in "ab"])
        rows = ix.by_read.filter("size(a) + size(b) > 0").select("id", F.explode(sides).alias("x")).filter(F.size("x.at") > 0)
        return as_text(rows.select("id", "x.dir", "x.at"), index.bitmap_words(F.col("at"), 2))
    words = index.bitmaps(ix.i2p)
    rows = words.groupBy("id", "dir").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    full = F.array(*[F.coalesce(F.col("m")[w], F.lit(0).cast("long")) for w in (0, 1)])
    return as_text(rows, full)


def filter_sizes(spark, d):
    return index.sizes(_indexes(spark, d))


def merge_partitions(spark, d):
    """Indexes built for four partitions of the candidates' roots, merged: their rows."""
    reads, found = _candidates(spark, d)
    found = found.withColumn("part", merge.partition_of("root", 4))
    ix = index.indexes(reads, found, CFG, ("part",), keep=_kept)
    if ix.by_read is not None:
        rows, over = merge.merged_reads(ix, CFG)
        over = index.few(over.persist()).select(F.lit("k2i").alias("index"), "set", F.col("kmer").alias("key"))
        return _rows_of_reads(rows).join(over, ["index", "set", "key"], "left_anti").select("index", "set", "key", "value")
    return _rows_of(merge.merged([index.Indexes(ix.seq.drop("part"), ix.k2i.drop("part"), ix.i2p.drop("part"))], CFG))


def _rows_of_reads(rows: DataFrame) -> DataFrame:
    """The same as ``_rows_of`` from rows of reads, in one pass."""
    row = lambda name, set_, key, value: F.struct(F.lit(name).alias("index"), set_.alias("set"), key.alias("key"), value.alias("value"))
    id_, placed = F.col("id"), (F.col("kind") == 1) & (F.size("a") + F.size("b") > 0)
    sets = F.when(F.col("kind") == 0, F.array(F.lit("nn"))).when(placed, F.array(F.lit("tn"), F.lit("tm"))).otherwise(F.array(F.lit("tn")))
    seqs = F.transform(F.when(id_.isNotNull(), sets).otherwise(F.array().cast("array<string>")), lambda s: row("seq", s, id_, F.col("seq")))
    by_kmer = F.transform("keys", lambda x: row("k2i", index.set_of(F.col("kind")), kmers.text(x, CFG.k, CFG.k), id_))
    by_place = lambda d: F.transform(d, lambda p: row("i2p", F.lit("tm"), id_, F.concat(F.lit(d), p.cast("string"))))
    places = F.when(F.col("kind") == 1, F.concat(by_place("a"), by_place("b"))).otherwise(F.array().cast("array<struct<index:string,set:string,key:string,value:string>>"))
    return rows.select(F.inline(F.concat(seqs, by_kmer, places)))


def _rows_of(ix: index.Indexes) -> DataFrame:
    """(index, set, key, value) of all three indexes."""
    seq = ix.seq.select(F.lit("seq").alias("index"), "set", F.col("id").alias("key"), F.col("seq").alias("value"))
    by_kmer = ix.k2i.select(F.lit("k2i").alias("index"), "set", F.col("kmer").alias("key"), F.col("id").alias("value"))
    by_place = ix.i2p.select(F.lit("i2p").alias("index"), F.lit("tm").alias("set"), F.col("id").alias("key"), F.concat("dir", F.col("pos").cast("string")).alias("value"))
    return seq.unionByName(by_kmer).unionByName(by_place)


def to_fastq(spark, d):
    seq = _indexes(spark, d).seq
    return merge.fastq(seq, "nn").withColumn("set", F.lit("nn")).unionByName(merge.fastq(seq, "tn").withColumn("set", F.lit("tn")))


def group_leads(spark, d):
    return group.leads(_indexes(spark, d, once=True), CFG).select("id", "dir", F.concat_ws(" ", F.col("positions").cast("array<string>")).alias("positions"), "seq")


def group_leads_window(spark, d):
    return group.leads_by_window(_indexes(spark, d, once=True), CFG)


def group_kmers(spark, d):
    return group.kmer_table(_indexes(spark, d), CFG)


def group_kmers_rocks(spark, d):
    return group.kmer_table(_indexes(spark, d), CFG, None, per_entry=True)


def group_reads(spark, d):
    return group.read_table(_indexes(spark, d), CFG)


def group_documents(spark, d):
    g = group.groups(_indexes(spark, d), CFG)
    return g.select("lead.id", F.size("pos_a").alias("pos_a"), F.size("pos_b").alias("pos_b"), F.size("kmers_a").alias("kmers_a"), F.size("kmers_b").alias("kmers_b"), F.size("reads_n").alias("reads_n"), F.size("reads_t").alias("reads_t"))


def group_sets(spark, d):
    return group.sets(_indexes(spark, d), CFG).select("lead", "n", F.concat_ws(" ", "ids").alias("ids"))


def group_selection_stats(spark, d):
    return group.selection_stats(_indexes(spark, d), CFG)


def group_count(spark, d):
    return group.group_count(_indexes(spark, d), CFG)


def fastq_round_trip(spark, d):
    """Reads written as FASTQ files and read by the data source."""
    raw, parts = _raw(spark, d), []
    for kind in (0, 1):
        at = scratch(spark, f"reads-{kind}")
        record = F.concat(F.lit("@"), "id", F.lit(" of the fixture\n"), "seq", F.lit("\n+\n"), "qual")
        raw.filter(F.col("kind") == kind).select(record.alias("value")).write.text(at)
        parts.append(fastq.fastq(spark, f"{at}/part-*").withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1]).select("id", "kind", "seq", "qual")


def plain_round_trip(spark, d):
    """The text forms of the indexes, written and read again: their rows."""
    at = scratch(spark, "plain")
    tables.write_plain(_indexes(spark, d), at, CFG.max_reads)
    return _rows_of(tables.read_plain(spark, at))


def annotation_lines(spark, d):
    """The annotation's map of each read, as text in order of places."""
    return tables.annotation_text(_all_reads(spark, d), CFG)


def group_content(spark, d):
    """What the groups hold: places, k-mers with their counters, and reads."""
    g = group.groups(_indexes(spark, d), CFG)
    places = lambda c: F.concat_ws(" ", F.col(c).cast("array<string>")).alias(c)
    kms = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.concat_ws(":", x.kmer, *[x[n].cast("string") for n in ("kept_n", "kept_t", "dropped_n", "dropped_t")]))).alias(c)
    reads = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.concat_ws(":", x.id, x.seq))).alias(c)
    return g.select("lead.id", "lead.seq", places("pos_a"), places("pos_b"), kms("kmers_a"), kms("kmers_b"), reads("reads_n"), reads("reads_t"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        read_quality_filter, low_quality_histogram, n_split_segments, kmer_explode, revcomp_reads, encode_stems, canonical_roots, partition_code, kmer_counts,
        kmer_counts_nocache, kmer_counts_k30, repeated_roots, prune_semi_join, pruned_counts, stem_counts, prefiltered_roots, candidate_kmers, candidate_kmers_k30, export_range, annotate_kmers,
        count_stats, count_stats_distinct, count_histogram, index_seq, index_k2i, k2i_capped, index_i2p, i2p_bitmap, i2p_positions, filter_sizes, merge_partitions, to_fastq,
        group_leads, group_leads_window, group_kmers, group_kmers_rocks, group_reads, group_documents, group_sets, group_selection_stats, group_count,
        fastq_round_trip, plain_round_trip, annotation_lines, group_content,
    )
}
