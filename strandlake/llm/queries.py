"""Registered queries of the training-data operators, and SQL for those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lines, media, neardup, pieces, quality, suffixes, toxicity, urls
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("_line_n").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digest(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_decontaminate, op3_suffix_dedup, op4_sentencepiece, op5_media, op6_toxicity, op7_url_filter, op8_language_id, op9_near_duplicates, op10_quality)}

ORACLE = {
    "op1_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(source, '') host, text FROM documents),
l AS (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM d WHERE strlen(text) > 0),
b AS (SELECT r, host, text, line, i, regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') bare FROM l),
t AS (SELECT host, count(DISTINCT text) total FROM d WHERE strlen(text) > 0 GROUP BY host),
f AS (SELECT host, bare FROM b JOIN t USING (host) WHERE bare <> '' GROUP BY host, bare, total
      HAVING count(DISTINCT text) >= 10 AND count(DISTINCT text) > total * 0.01),
k AS (SELECT r, count(*) n, count(*) FILTER (WHERE f.bare IS NOT NULL) gone, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.bare IS NULL) kept
      FROM b LEFT JOIN f ON f.host = b.host AND f.bare = b.bare GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) n_lines, CAST(coalesce(gone, 0) AS BIGINT) n_dropped, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (r)
""",
    "op2_decontaminate": r"""
WITH dw AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, dwin.n, item_id FROM dwin JOIN win ON win.n = dwin.n AND win.s = dwin.s),
words AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(i, i + n)) p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) n_items, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
}
