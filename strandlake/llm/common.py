"""Shared parts of the training-data operators: tables, staging, tokens as arrays.

Everything here works on whole texts.  ``words_of`` and friends take the raw
UTF-8 buffer of an Arrow string column, so no Python string is made per token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship, spare_driver

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts lineage in a way that survives lost executors, and gives the planner
    the true size of the table.  The files go when the application ends.  Garbage of the
    stages before is collected if there is much of it on the driver.
    """
    spare_driver(df.sparkSession)
    at = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what a Python worker holds at once, by rows and bytes, and ship this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def split_of(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``most`` bytes each, or a single longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply, as in public hash functions."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def byte_classes(lower: bool = True) -> np.ndarray:
    """Byte to lower-cased byte for word bytes (0-9, letters, everything not ASCII), else 0."""
    lut = np.zeros(256, np.uint8)
    lut[0x30:0x3A] = np.arange(0x30, 0x3A)
    lut[0x61:0x7B] = np.arange(0x61, 0x7B)
    lut[0x41:0x5B] = np.arange(0x61, 0x7B) if lower else np.arange(0x41, 0x5B)
    lut[0x80:] = np.arange(0x80, 0x100)
    return lut


WORD = byte_classes()
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], U64)


def run_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes at a time; long runs only cost their own length."""
    padded = np.zeros(len(mapped) + 8, np.uint8)
    padded[: len(mapped)] = mapped
    eight = np.ndarray(len(mapped) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    h = fmix((eight[starts] & _MASK[np.minimum(size, 8)]) ^ U64(0x9E3779B97F4A7C15 + seed))
    live, at = np.flatnonzero(size > 8), 8
    while len(live):
        rest = np.minimum(size[live] - at, 8)
        h[live] = fmix(h[live] * U64(0x9E3779B97F4A7C15) ^ (eight[starts[live] + at] & _MASK[rest]))
        at += 8
        live = live[size[live] > at]
    return fmix(h ^ size.astype(U64) * U64(0x94D049BB133111EB))


def runs(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-zero class that don't cross texts."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n + 1, bool)
    change[1:n] = classes[1:] != classes[:-1]
    change[0] = change[n] = True
    change[offsets] = True
    edges = np.flatnonzero(change)
    keep = classes[edges[:-1]] != 0
    return edges[:-1][keep], edges[1:][keep]


def words_of(raw: np.ndarray, offsets: np.ndarray, lut: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and n + 1 word offsets, one range for each text."""
    mapped = lut[raw]
    starts, ends = runs((mapped != 0).astype(np.uint8), offsets)
    return run_hashes(mapped, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive items that stay in one text, and their n + 1 offsets."""
    count = np.maximum(np.diff(offsets) - k + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], count)
    out = np.zeros(len(pos), U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + h[pos + j]
    return fmix(out), at


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges of ``at``."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def carried(documents: DataFrame, *own: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``documents`` with all columns but ``own`` under names that clash with nothing, those
    names, and what gives a result the original columns back."""
    others = [c for c in documents.columns if c not in own]
    names = [f"_x{i}" for i in range(len(others))]
    inner = documents.select(*own, *[F.col(f"`{c}`").alias(x) for c, x in zip(others, names)])
    of = dict(zip(others, names))
    return inner, names, lambda df: df.select(*[F.col(of.get(c, c)).alias(c) for c in documents.columns])


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch of ``df``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out

    return df.mapInArrow(each, schema)


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a zero byte before and after each, so that none touches its neighbour."""
    n = len(offsets) - 1
    out = np.zeros(len(raw) + n + 1, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    return out, offsets + np.arange(n + 1) + 1


def quotas(counts: np.ndarray, most: int, even: float) -> np.ndarray:
    """How many of ``most`` go to each label: a part ``even`` is dealt evenly, the rest by the counts.

    What a label cannot fill goes to the others; all are taken if they are no more than ``most``.
    """
    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.int64)
    while (left := int(min(most, counts.sum()) - out.sum())) > 0:
        free = counts - out
        some = free > 0
        want = left * (even * some / some.sum() + (1 - even) * free / free.sum())
        more = np.minimum(free, want.astype(np.int64))
        if not more.any():
            more[np.argsort(-free, kind="stable")[:left]] = 1
            more = np.minimum(more, free)
        out += more
    return out


def bounded_sample(rows: DataFrame, documents: DataFrame | None, most: int, most_bytes: int, even: float = 0.25) -> tuple[list, dict]:
    """At most ``most`` labelled rows with their texts, and how many usable rows each label has.

    ``rows`` has a ``doc_id`` and a ``label``, and a ``text`` if there are no ``documents``
    to join.  Rows with an id and a text that is not empty are usable, whatever its length;
    repeated rows count once.  Each label gets its part of the rows (``quotas``), those of
    least hash of id and text.  All texts together have at most ``most`` times ``most_bytes``
    bytes, which labels that need much share evenly; texts that don't fit any more are passed
    over, and only if a label's first text is longer than all that the label has, it is
    learned from as far as that goes.  The order depends on ids and texts alone.

    Only ids, lengths and hashes are joined and grouped.  Which rows come first is decided
    among few candidates, those with a hash under a bound by the label's count.
    """
    usable = lambda df: df.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    sizes = [F.octet_length("text").alias("_bytes"), F.xxhash64("text").alias("_text")]
    if documents is None:
        found = usable(rows).select("doc_id", "label", *sizes)
    else:
        found = usable(documents).select("doc_id", *sizes).join(rows.select("doc_id", "label"), "doc_id")
    found = found.filter("label is not null").groupBy("doc_id", "label", "_text").agg(F.max("_bytes").alias("_bytes"))
    found = stage(found.withColumn("_hash", F.xxhash64("doc_id", "_text")), "usable")
    groups = found.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most).collect()
    counts = {g["label"]: g["n"] for g in groups}
    if not counts:
        return [], counts
    dealt = dict(zip(counts, quotas(np.array(list(counts.values())), most, even).tolist()))
    spark = found.sparkSession
    # Twice the quota and 100 more are expected under the bound: never too few.
    bounds = [(label, min(2**63 - 1, -(2**63) + 2**64 * (2 * dealt[label] + 100) // n)) for label, n in counts.items()]
    bounds = spark.createDataFrame(bounds, f"label {found.schema['label'].dataType.simpleString()}, _bound long")
    near: dict = {}
    for r in found.join(F.broadcast(bounds), "label").filter("_hash <= _bound").select("label", "_hash", "doc_id", "_text", "_bytes").collect():
        near.setdefault(r["label"], []).append((r["_hash"], r["doc_id"], r["_text"], r["_bytes"]))
    first = {label: sorted(x)[: dealt[label]] for label, x in near.items()}
    share = dict(zip(first, quotas(np.array([sum(x[3] for x in own) for own in first.values()]), most * most_bytes, 1.0).tolist()))
    chosen = {}
    for label, own in first.items():
        left = share[label]
        for nth, (h, doc_id, text, size) in enumerate(own):
            if size <= left or nth == 0 and size > share[label]:
                chosen[doc_id, text, label] = (h, min(size, left))
                left -= min(size, left)
    wanted = [(d, t, str(label), size) for (d, t, label), (_, size) in chosen.items()]
    wanted = F.broadcast(spark.createDataFrame(wanted, "doc_id long, _text long, _label string, _most long"))
    texts = (rows if documents is None else documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text") > 0)
    cut = F.when(F.octet_length("text") > F.col("_most"), F.expr("left(text, int(greatest(1, _most div 4)))")).otherwise(F.col("text"))
    texts = texts.withColumn("_text", F.xxhash64("text")).join(wanted, ["doc_id", "_text"]).select("doc_id", "_text", "_label", cut.alias("text"))
    texts = {(r["doc_id"], r["_text"], r["_label"]): r["text"] for r in texts.collect()}
    out = sorted((hash_id(d), d, t, label) for d, t, label in chosen)
    return [{"doc_id": d, "label": label, "text": texts[d, t, str(label)]} for _, d, t, label in out if (d, t, str(label)) in texts], counts


def oversampled(labels: list[int], counts: dict) -> float:
    """By how much the log odds of label 1 in a sample exceed those of all usable rows."""
    ones, zeros = sum(labels), len(labels) - sum(labels)
    if not (ones and zeros):
        return 0.0
    return float(np.log(ones / zeros) - np.log(counts[1] / counts[0]))


def hash_id(doc_id: int) -> int:
    return int(fmix(np.array([doc_id], np.int64).view(U64))[0])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def without_near_copies(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that share neither of two least 5-word shingles with an earlier text.

    For samples only: copies of one text would make its rare words look like evidence.
    """
    h, _, _, at = words_of(raw, offsets)
    g, gat = grams(h, at, 5)
    seen: set[tuple[int, int]] = set()
    keep = []
    for i in range(len(offsets) - 1):
        own = g[gat[i] : gat[i + 1]]
        keys = {(s, int((own * U64(m)).min())) for s, m in enumerate((1, 0x9FB21C651E98DF25))} if len(own) else set()
        if not keys & seen:
            keep.append(i)
        seen |= keys
    return np.array(keep, np.int64)
