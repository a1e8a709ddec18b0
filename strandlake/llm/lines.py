"""Line dedup by site-relative frequency.

A line of a page is boilerplate if, among the pages of the page's host, the share
that contain it exceeds ``ratio`` and at least ``least`` of them do.  Boilerplate
lines are dropped, all occurrences; the others stay in order.  Lines are split at
``\\n`` and compared without the white space around them; blank lines always stay.
A host's pages with equal texts count as one page: many exact copies of a page are
for near dedup to remove, they don't turn its lines into boilerplate.  With ``copies``,
a table of near copies, pages of one class count as one page as well.

Scale.  One shuffle counts (host, line, page) by 64-bit hashes and one rolls them up,
both after sums on the map side, so a host with a third of all pages is spread by its
lines.  Texts are not shuffled: the boilerplate lines of a host are at most its mean
number of lines a page over ``ratio``; they are written as a table, one row to a host,
and joined to the pages by host.  Spark broadcasts that table if its size allows, and
else splits large hosts in a sort-merge join.

Edge cases.  A null text stays null and an empty one empty (0 lines).  Pages without
a host share one host.  Tables may be empty; other columns are carried along as they
are, whatever their names, unless they begin with ``_line_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import stage

RATIO, LEAST = 0.01, 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")


def _key(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def near_copies(pages: DataFrame, text: str = "text") -> DataFrame:
    """(_page, _as): hashes of texts that have near copies, and the one that their class counts as."""
    texts = pages.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")).filter(F.octet_length("text") > 0)
    found = neardup.classes(texts).filter("class_size > 1 and doc_id <> class_id")
    return stage(found.select(F.col("doc_id").alias("_page"), F.col("class_id").alias("_as")).distinct(), "near-copies")


def one_each(rows: DataFrame, copies: DataFrame | None, *by: str) -> DataFrame:
    """Distinct pages of each group; hashes alone are joined to the near copies."""
    out = rows.groupBy(*by, "_page").agg(F.lit(1).alias("one"))
    if copies is None:
        return out
    same = neardup.shipped(copies, copies.count(), 24)
    out = out.join(same, "_page", "left").withColumn("_page", F.coalesce("_as", "_page"))
    return out.groupBy(*by, "_page").agg(F.lit(1).alias("one"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, copies: DataFrame | None = None) -> DataFrame:
    """(_line_host, _line_keys): the hashes of each host's boilerplate lines, where it has any."""
    page = pages.filter(F.octet_length(text) > 0).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_line_host"), F.xxhash64(text).alias("_page"), F.col(text).alias("_text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: _bare(x) != ""), _key))
    each = page.select("_line_host", "_page", F.explode(keys).alias("_key"))
    total = one_each(page, copies, "_line_host").groupBy("_line_host").agg(F.count("*").alias("_total"))
    counts = one_each(each, copies, "_line_host", "_key").groupBy("_line_host", "_key").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    found = counts.join(total, "_line_host").filter(F.col("_n") > F.col("_total") * ratio)
    return found.groupBy("_line_host").agg(F.sort_array(F.collect_list("_key")).alias("_line_keys"))


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, copies: DataFrame | None = None) -> DataFrame:
    """``pages`` with boilerplate lines dropped from ``text``, and (_line_n, _line_dropped) counts."""
    found = stage(boilerplate(pages, host, text, ratio, least, copies), "boilerplate")
    joined = pages.withColumn("_line_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).join(found, "_line_host", "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(F.col("_line_keys"), _key(x)))
    changed = F.col("_line_keys").isNotNull() & F.col(text).isNotNull()
    n = F.when(F.octet_length(text) > 0, F.size(lines)).otherwise(F.lit(0)).cast("long")
    out = joined.withColumn("_line_n", n).withColumn("_line_kept", F.when(changed, kept))
    dropped = F.when(changed & (F.col("_line_n") > 0), F.col("_line_n") - F.size("_line_kept")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("_line_dropped", dropped).withColumn("_line_text", F.when(changed, F.array_join("_line_kept", "\n")).otherwise(F.col(text)))
    same = [F.col("_line_text").alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns]
    return out.select(*same, "_line_n", "_line_dropped")
