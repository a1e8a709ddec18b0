"""Roots that occur at least twice: an exact set, or a Bloom filter without false negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import give_back
from . import runs
from .filter import few, shared_ids
from .kmers import occurrences, with_root


def repeated_roots(reads: DataFrame, k: int) -> DataFrame:
    """(root, total) of roots that occur at least twice, in both kinds and strands."""
    return with_root(occurrences(reads, k, ()), k).groupBy("root").agg(F.count("*").alias("total")).filter("total >= 2")


def pruned(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with a ``root`` in the set."""
    return rows.join(roots.select("root"), "root", "left_semi")


def of_reads(reads: DataFrame, k: int, keep=lambda df: df) -> DataFrame:
    """(id, kind, kmers, roots): how many k-mers of a read have a root that occurs at least twice, and how many such roots.

    Short roots are looked up in a table of bits where reads are cut, and only reads that share their
    id meet; others are joined, by a shuffle of all occurrences.
    """
    if 2 * (k - 2) > runs.DENSE_BITS or k < 4:
        rows = pruned(with_root(occurrences(reads, k, ("id", "kind")), k), repeated_roots(reads, k))
        return rows.groupBy("id", "kind").agg(F.count("*").alias("kmers"), F.countDistinct("root").alias("roots"))
    table = runs.repeated(reads, k)
    give_back(reads.sparkSession)
    shared = shared_ids(reads.select("kind", "id", F.lit(1).alias("own")), keep)
    if shared is None:
        return runs.of_repeated(reads, k, table)
    shared, tagged = few(shared), reads.withColumn("_hash", F.xxhash64("kind", "id"))
    own, some = (tagged.join(shared, "_hash", how).drop("_hash") for how in ("left_anti", "left_semi"))
    united = runs.of_repeated(some, k, table, each=True).groupBy("id", "kind").agg(F.sum("kmers").alias("kmers"), F.countDistinct("root").alias("roots"))
    return runs.of_repeated(own, k, table).unionByName(united)


def bloom(roots: DataFrame, expected: int, false_positives: float):
    """A JVM Bloom filter of the roots; its size is set by ``expected`` and the rate."""
    return roots._jdf.stat().bloomFilter("root", expected, false_positives)
