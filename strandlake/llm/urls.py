"""URL filters by a character language-model ratio, in DataFrame functions only.

``judge_urls`` gives each page a verdict.  A url that one of the host and path
rules fits takes the longest such rule's verdict.  These urls are also the
accepted and rejected examples of two variable-order Markov models over
characters; every other url is judged by the difference of its length-normalised
log-likelihoods under the two, against a threshold calibrated on examples that
took no part in the counts.

Model.  Urls are lower-cased and folded to 40 symbols (a-z, one for all digits,
ten for punctuation, one for the rest, start and end).  A context holds up to
five symbols.  ``p(c | ctx) = (n(ctx c) + S p(c | shorter ctx)) / (n(ctx) + S)``
with ``S = strength``; the empty context backs off to the uniform 1/40.  A gram
seen in no example takes its longest seen suffix.  The table holds one row for
each gram of up to six symbols that an example has, and grows with the examples;
each length's part is broadcast where its counted rows are few enough (``SHIP_BYTES``),
and met in a shuffle where they are not.

Edge cases.  Null urls and urls without ``://``: host and path are empty, no rule
fits, the verdict is the method's over the whole url.  A null or empty url has
score 0.  Without any accepted or rejected example every score is 0 and the
verdict is ``allow``.  Repeated rows are judged alike; null ids are carried along.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SYMBOLS = 40
ORDER = 6
SHIP_BYTES = 32 << 20


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows, of some 64 bytes, stay under the bound."""
    return F.broadcast(table) if table.count() * 64 <= SHIP_BYTES else table


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null.  A rule's host fits itself and its subdomains."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def folded(url: Column) -> Column:
    """Lower case, digits to 0, rare characters to *, between ORDER - 1 times ^ and a $."""
    text = F.lower(F.coalesce(url, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"(?s)[^a-z0./:?=&#%_-]", "*")
    return F.when(F.length(text) > 0, F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))).otherwise(F.lit(""))


def _positions(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each position after the start marks, with its gram of ORDER symbols."""
    n = F.length("_text")
    at = df.filter(n >= ORDER).select(*keep, "_text", F.explode(F.sequence(F.lit(1), n - (ORDER - 1))).alias("_i"))
    return at.select(*keep, F.expr(f"substring(_text, _i, {ORDER})").alias("_g"))


def gram_scores(examples: DataFrame, strength: float = 4.0) -> list[DataFrame]:
    """(gram, ratio) for each length: log p_accepted - log p_rejected of a gram's last symbol.

    ``examples`` has ``_text`` and ``_accepted``.  Counts of ORDER-grams are summed
    before they are shuffled; the shorter grams come from those counts.
    """
    full = _positions(examples, ["_accepted"]).groupBy("_g").agg(F.count(F.when(F.col("_accepted"), 1)).alias("a"), F.count(F.when(~F.col("_accepted"), 1)).alias("r"))
    by_order = {ORDER: stage(full.select(F.col("_g").alias("gram"), "a", "r"), f"url-grams-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        shorter = by_order[k + 1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        by_order[k] = stage(shorter, f"url-grams-{k}")
    uniform, s = F.lit(1.0 / SYMBOLS), F.lit(float(strength))
    total = by_order[1].agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    level = by_order[1].select("gram", *[((F.col(x) + s * uniform) / F.lit((total[x] or 0) + float(strength))).alias(f"p{x}") for x in "ar"])
    levels = [level]
    for k in range(2, ORDER + 1):
        context = by_order[k].groupBy(F.expr(f"substring(gram, 1, {k - 1})").alias("ctx")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        shorter = level.select(F.col("gram").alias("_short"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        rows = by_order[k].withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})")).withColumn("_short", F.expr(f"substring(gram, 2, {k - 1})"))
        level = rows.join(context, "ctx").join(small(shorter), "_short").select("gram", *[((F.col(x) + s * F.col(f"q{x}")) / (F.col(f"c{x}") + s)).alias(f"p{x}") for x in "ar"])
        level = stage(level, f"url-level-{k}")
        levels.append(level)
    return [stage(level.select("gram", F.round(F.log("pa") - F.log("pr"), 9).alias("ratio")), f"url-model-{k}") for k, level in enumerate(levels, 1)]


def url_scores(df: DataFrame, key: str, model: list[DataFrame]) -> DataFrame:
    """(key, score): mean log ratio over a url's symbols."""
    at = _positions(df, [key])
    found = F.lit(0.0)
    for k, grams in enumerate(model, 1):
        part = grams.select(F.col("gram").alias(f"_g{k}"), F.col("ratio").alias(f"_r{k}"))
        at = at.withColumn(f"_g{k}", F.expr(f"right(_g, {k})")).join(small(part), f"_g{k}", "left")
        found = F.coalesce(F.col(f"_r{k}"), found)
    return at.groupBy(key).agg(F.avg(found).alias("score"))


def calibrated(scored: DataFrame) -> float:
    """The score where a normal curve for each class, of its own spread, is equally far out."""
    ok = F.col("_ok")
    m = scored.agg(*[f(F.when(c, F.col("score"))).alias(f"{n}{x}") for c, x in ((ok, "a"), (~ok, "r")) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    if m["ma"] is None or m["mr"] is None:
        return 0.0
    sa, sr = m["sa"] + 1e-6, m["sr"] + 1e-6
    return (m["ma"] * sr + m["mr"] * sa) / (sa + sr)


def judge_urls(pages: DataFrame, rules=RULES, strength: float = 4.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, margin) for each row of ``pages``."""
    base = pages.select("page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), folded(F.col("url")).alias("_text")
    )
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    base = base.withColumn("_accepted", verdict_of(F.col("rule"), rules) == "allow")
    examples = base.filter(F.col("rule").isNotNull()).select("_text", "_accepted")
    fold = F.crc32(F.col("_text").cast("binary")) % 5
    model = gram_scores(examples.filter(fold != 0), strength)
    # Equal texts have equal scores, so a text is scored once; the calibration takes those held back.
    held = examples.filter(fold == 0).groupBy("_text").agg(F.max("_accepted").alias("_ok"))
    cut = calibrated(url_scores(held.select("_text"), "_text", model).join(held, "_text"))
    rest = base.filter(F.col("rule").isNull())
    scores = url_scores(rest.select("_text").distinct(), "_text", model)
    judged = base.join(scores, "_text", "left")
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), F.when(score >= cut, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.round(score - cut, 6)).alias("margin"),
    )
