"""k-mer counts that grow as read files arrive.

Counts are sums, so counting incrementally gives what counting all at once gives.  The
state has a row for each k-mer; there is no event time, nothing is late and nothing
expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.kmers import occurrences, quality_filtered, text

SCHEMA = "id string, kind int, seq string, qual string"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Reads of the Parquet files that come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def growing_counts(reads: DataFrame, cfg: Config) -> DataFrame:
    """(kmer, n, t) so far, with unsaturated counters; write in ``complete`` or ``update`` mode."""
    rows = occurrences(quality_filtered(reads, cfg.check_quality), cfg.k, ("kind",)).groupBy("kmer").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("n"), F.count(F.when(F.col("kind") == 1, 1)).alias("t"))
    return rows.withColumn("kmer", text(F.col("kmer"), cfg.k, cfg.k))
