"""Benchmark decontamination by winnowing.

A benchmark item's windows are its runs of ``window`` consecutive words; an item of
fewer words, but not none, is one window.  A document word inside any occurrence of
a window is hit.

Method.  Both sides are cut into words over the UTF-8 bytes (A-Z lower-cased).  Of
every ``window - k + 1`` consecutive k-word grams the least hash is kept (winnowing),
so any shared span of ``window`` words has a kept gram on both sides, at the same
place of the span: no shared window is missed.  Document fingerprints are looked up
among those of the benchmark; each hit is extended word by word to the left and the
right, comparing the words themselves, and counts if it reaches ``window`` words.
Items of n < ``window`` words are fingerprinted whole (k = n, one gram to a window).

Scale.  Documents are read once and are not shuffled.  The benchmark is taken in
blocks of at most ``block_bytes`` of text, each shipped to all executors: that is the
size bound of what is broadcast.  One block is the usual case; a benchmark beyond it
costs one more pass over the documents for each further block, and the spans of the
passes are joined by document.

Edge cases.  Null, empty and wordless texts have no words and no hits; wordless items
occur nowhere.  Items with equal texts are each reported.  An item with a null id
marks words but is not counted.  Repeated documents are each reported.  Extra columns
are ignored.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, grams, map_texts, small_batches, text_buffer, words_of

WINDOW, K, BLOCK_BYTES = 10, 5, 16 << 20


def selected(h: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: hash and word position of the rightmost least k-gram of each window."""
    if window < k or not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, at = grams(h, offsets, k)
    span = window - k + 1
    count = np.maximum(np.diff(at) - span + 1, 0)
    base = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(base[-1]) + np.repeat(at[:-1] - base[:-1], count)
    best, pos = g[start], start
    for j in range(1, span):
        other = g[start + j]
        take = other <= best
        best, pos = np.where(take, other, best), np.where(take, start + j, pos)
    pos = np.unique(pos)
    shift = np.repeat(offsets[:-1] - at[:-1], np.diff(at))  # from gram number to word number
    return g[pos], pos + shift[pos]


class Block:
    """Some benchmark items, indexed by their fingerprints."""

    def __init__(self, items: list[tuple], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        raw, offsets = text_buffer(pa.array([t for _, t in items], pa.large_string()))
        h, starts, ends, at = words_of(raw, offsets)
        low = WORD[raw].tobytes()
        self.ids = [i for i, _ in items]
        self.words = [[low[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at[:-1], at[1:])]
        sizes = np.diff(at)
        self.short: dict[int, dict[int, list[int]]] = {}
        for item in np.flatnonzero((sizes > 0) & (sizes < window)):
            n, a = int(sizes[item]), int(at[item])
            key, _ = grams(h[a : a + n], np.array([0, n]), n)
            self.short.setdefault(n, {}).setdefault(int(key[0]), []).append(int(item))
        fp, pos = selected(h, at, k, window)
        self.index: dict[int, list[tuple[int, int]]] = {}
        owner = np.searchsorted(at, pos, "right") - 1
        for key, item, q in zip(fp.tolist(), owner.tolist(), (pos - at[owner]).tolist()):
            self.index.setdefault(key, []).append((item, q))
        self.keys = np.array(sorted(self.index), np.uint64)
        self.short_keys = {n: np.array(sorted(d), np.uint64) for n, d in self.short.items()}


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where ``values`` are among the sorted ``keys``."""
    if not len(keys) or not len(values):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.flatnonzero(keys[at] == values)


def _extend(words: list[bytes], item: list[bytes], p: int, q: int) -> tuple[int, int]:
    a = 0
    while p - a > 0 and q - a > 0 and words[p - a - 1] == item[q - a - 1]:
        a += 1
    b, most = 0, min(len(words) - p, len(item) - q)
    while b < most and words[p + b] == item[q + b]:
        b += 1
    return p - a, p + b


def hits(block: Block, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Words of each text, and for texts with hits their hit spans and item numbers."""
    h, starts, ends, at = words_of(raw, offsets)
    fp, pos = selected(h, at, block.k, block.window)
    found = [(pos[i := member(fp, block.keys)], fp[i], 0)]
    for n, keys in block.short_keys.items():
        g, gat = grams(h, at, n)
        i = member(g, keys)
        shift = np.repeat(at[:-1] - gat[:-1], np.diff(gat))
        found.append((i + shift[i], g[i], n))
    out: dict[int, tuple[list, set]] = {}
    low = None
    by_doc: dict[int, list[tuple[int, int, int]]] = {}
    for where, keys, n in found:
        for doc, p, key in zip((np.searchsorted(at, where, "right") - 1).tolist(), where.tolist(), keys.tolist()):
            by_doc.setdefault(doc, []).append((p, key, n))
    for doc, seen in by_doc.items():
        a, z = int(at[doc]), int(at[doc + 1])
        low = WORD[raw[starts[a] : ends[z - 1]]].tobytes()
        zero = int(starts[a])
        words = [low[s - zero : e - zero] for s, e in zip(starts[a:z].tolist(), ends[a:z].tolist())]
        spans, items, reach = [], set(), {}
        for p, key, n in seen:
            p -= a
            if n:
                for item in block.short[n][key]:
                    if words[p : p + n] == block.words[item]:
                        spans.append((p, p + n))
                        items.add(item)
                continue
            for item, q in block.index[key]:
                if reach.get((item, p - q), -1) > p:  # inside a span that this item already gave
                    continue
                lo, hi = _extend(words, block.words[item], p, q)
                reach[item, p - q] = hi
                if hi - lo >= block.window:
                    spans.append((lo, hi))
                    items.add(item)
        if spans:
            out[doc] = (spans, items)
    return np.diff(at), out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_SCHEMA = "doc_id long, n_words long, spans array<struct<lo: bigint, hi: bigint>>, items array<long>"
_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def find_hits(documents: DataFrame, benchmark: DataFrame, extra: list[str] | None = None, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items, ...): spans are ranges of word numbers, items are sorted ids.

    ``extra`` columns of documents are carried along.  With more than one block the
    rows of a document's passes are joined; rows that share an id are told apart by
    their contents and number.
    """
    spark, extra = documents.sparkSession, extra or []
    small_batches(spark)
    items = benchmark.select("item_id", "text").filter(F.octet_length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = int(size // block_bytes) + 1
    schema = _SCHEMA + "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in extra)

    def one(docs: DataFrame, chosen: DataFrame) -> DataFrame:
        shipped = spark.sparkContext.broadcast(Block([(r["item_id"], r["text"]) for r in chosen.collect()], window, k))

        def work(batch: pa.RecordBatch) -> pa.Table:
            block = shipped.value
            raw, offsets = text_buffer(batch["text"])
            n, out = hits(block, raw, offsets)
            spans, found = [[] for _ in n], [[] for _ in n]
            for doc, (s, i) in out.items():
                spans[doc] = [{"lo": lo, "hi": hi} for lo, hi in union(s)]
                found[doc] = sorted({block.ids[x] for x in i} - {None})
            columns = [batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.int64()))]
            return pa.Table.from_arrays([*columns, *(batch[c] for c in extra)], ["doc_id", "n_words", "spans", "items", *extra])

        return map_texts(docs.select("doc_id", "text", *[c for c in extra if c not in ("doc_id", "text")]), work, schema)

    if blocks == 1:
        return one(documents, items)
    return _blocks(documents, items, blocks, one, extra)


def _blocks(documents: DataFrame, items: DataFrame, blocks: int, one, extra: list[str]) -> DataFrame:
    """The exact way for a benchmark above the bound: one pass for each block of items."""
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    passes = [one(documents, items.filter(part == b)) for b in range(blocks)]
    key = ["doc_id", "n_words", *extra]
    every = passes[0].withColumn("_pass", F.lit(0))
    for b, more in enumerate(passes[1:], 1):
        every = every.unionByName(more.withColumn("_pass", F.lit(b)))
    # Equal rows have equal hits, so any pairing of theirs across the passes is right.
    every = every.withColumn("_copy", F.row_number().over(Window.partitionBy("_pass", F.xxhash64(*key), *key).orderBy(F.size("spans"))))
    merged = every.groupBy(*key, "_copy").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.drop("_copy").select("doc_id", "n_words", "spans", "items", *extra)


def n_hit(spans: Column) -> Column:
    """Words under spans, which may overlap."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.sort_array(spans),
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda s, x: F.struct((s.n + F.greatest(zero, x.hi - F.greatest(x.lo, s.end))).alias("n"), F.greatest(s.end, x.hi).alias("end")),
        lambda s: s.n,
    )


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of each document's hits."""
    found = find_hits(documents, benchmark, **options)
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    hit = n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, most: float = 0.0, **options) -> DataFrame:
    """Rows of ``documents``, all columns, whose share of hit words is at most ``most``."""
    inner, others, back = carried(documents, "doc_id", "text")
    found = find_hits(inner, benchmark, extra=["text", *others], **options)
    return back(found.filter(n_hit(F.col("spans")) <= F.col("n_words") * F.lit(float(most))))
