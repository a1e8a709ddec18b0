"""The corpus pipeline: toxicity, line dedup, near dedup, decontamination, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works
on all rows that the stage before it kept.  All stages but the last return the columns
of ``documents``:

1. ``toxicity`` drops documents that the tagger rejects (score 0.3 or more).
2. ``line_dedup`` drops boilerplate lines from texts and sets ``n_chars`` anew where it
   did; no document goes.  Near copies count as one page, or the lines of a large group
   of them would go from all of them before the next stage could keep one.
3. ``near_dedup`` keeps one document of each class, the one of least id.
4. ``decontaminate`` drops documents with an occurrence of a benchmark window.
5. ``encode`` returns the segmentations' digests of each document that is left.

Null and empty texts pass all stages.  Encoding returns one row for each of them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontam, lines, neardup, pieces, toxicity
from strandlake.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(docs, copies=lines.near_copies(docs))
    n_chars = F.when(F.col("_line_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers still hold what earlier stages needed: a smaller cache than for encoding alone.
    return pieces.encoding_digest(docs, cache=250_000)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontaminate", drop_contaminated), ("encode", encode)]

#: The tagger, the sampled candidates and the lattice search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
