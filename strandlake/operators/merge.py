"""Indexes of several partitions as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import runs
from .filter import Indexes, capped_rows, set_of
from .kmers import text


def partition_of(column: str, partitions: int):
    """Logical partition of a root or id."""
    return F.pmod(F.xxhash64(column), F.lit(partitions)).cast("int")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merged_seq(parts: list[DataFrame]) -> DataFrame:
    return _all(parts).groupBy("set", "id").agg(F.min("seq").alias("seq"))


def merged_k2i(parts: list[DataFrame], most: int | None = None) -> DataFrame:
    rows = _all(parts).distinct()
    return rows if most is None else capped_rows(rows, most)


def merged_i2p(parts: list[DataFrame]) -> DataFrame:
    return _all(parts).distinct()


def merged(parts: list[Indexes], cfg: Config) -> Indexes:
    return Indexes(merged_seq([p.seq for p in parts]), merged_k2i([p.k2i for p in parts], cfg.max_reads), merged_i2p([p.i2p for p in parts]))


def merged_reads(parts: Indexes, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """The merged rows of reads of ``parts``, whose rows carry their partition, and (set, kmer) of the
    k-mers above the cap, which are in one partition each."""
    return runs.united(parts.by_read), over(parts, cfg)


def over(ix: Indexes, cfg: Config) -> DataFrame:
    """(set, kmer) of k-mers with more reads than ``max_reads``."""
    rows = ix.by_read.select("kind", F.explode("keys").alias("key")).groupBy("kind", "key").agg(F.count("*").alias("n")).filter(F.col("n") > cfg.max_reads)
    return rows.select(set_of(F.col("kind")).alias("set"), text(F.col("key"), cfg.k, cfg.k).alias("kmer"))


def fastq(seq: DataFrame, set_: str) -> DataFrame:
    """(record): FASTQ records of a set, with the lowest quality throughout."""
    return seq.filter(F.col("set") == set_).select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('!', length(seq))")).alias("record"))
