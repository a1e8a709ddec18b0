"""Removal of long repeated byte strings by a sparse suffix array, sorted by distributed merging.

Every byte covered by a ``length``-byte string that also starts anywhere else, in the
same text or another, is marked.  Texts are UTF-8 bytes; matches stay inside a text.

Sampling.  Each window of ``length`` bytes has an anchor: the place in it whose 32
bytes have the least hash (the leftmost of equals).  Equal windows have their anchors
at the same offset, so only windows whose anchors start the same 32 bytes can be equal,
and only suffixes that begin at anchors (about one place in 185) are sorted.  Anchors
whose hash occurs once in the corpus are dropped by a count before anything is sorted;
texts that are equal as a whole are counted by digest and sorted once.

Sorting.  Every task sorts the suffixes at its anchors by (hash, ``length`` bytes) and
cuts the run at fixed ranges of the hash.  The pieces travel front-coded: the length
of the prefix shared with the suffix before, and the rest; likewise what stands in
front of the anchor, backwards.  The receiver merges the pieces of its range with a
loser tree that keeps, for each candidate, its common prefix with the last winner.  A
comparison looks at bytes only behind a common prefix that both are known to share,
and its outcome gives the next one, so no known prefix is read again, and the common
prefixes of neighbours in the merged order come for free.

Matching.  Suffixes with the same 32 bytes are a group.  Two of them share R bytes from
the anchor on (a minimum over neighbours' common prefixes) and L bytes before it: their
windows at offsets from ``length - R`` to L are equal.  Small groups are compared in
pairs.  Larger ones find a partner for each window by a rolling hash and check it byte
by byte.  Groups beyond ``hot`` suffixes are not collected: their windows are counted
by 128-bit hashes in a native aggregation with sums on the map side, and joined back.

Passages.  400 bytes are more than the shortest passages of over 50 words.  Beside what it
removes, the operator counts for each text the words in runs of ``WORDS`` words (as tokens,
A-Z lower-cased) that another text or row has too: the anchors are then least hashes of 8
words, the windows of anchors that several texts have are counted by 64-bit hashes, and
nothing is removed for them.

Scale.  Texts move only if the tables of anchors or spans that they meet are above
``SHIP_BYTES``; below it these are broadcast.  Long texts are hashed in segments.

Edge cases.  A null text is empty.  Texts shorter than ``length`` keep all.  Equal
texts of at least ``length`` bytes, repeated rows included, are removed whole.  Null ids
and extra columns don't matter.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fmix, map_texts, slices, small_batches, stage, text_buffer, words_of

LENGTH, GRAM, HOT, PAIRS = 400, 32, 50_000, 12
WORDS, WORD_GRAM = 51, 8
SHIP_BYTES, RANGE_BYTES, RUN_ROWS = 32 << 20, 8 << 20, 50_000
_SEGMENT = 1 << 19
_PLACE = U64((1 << 24) - 1)
_BYTES = fmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all strings of ``gram`` bytes, or hashed words; ``gram`` is a power of two."""
    h, size = _BYTES[raw] if raw.dtype == np.uint8 else raw, 1
    for m in _STEPS[: gram.bit_length() - 1]:
        h = h[: len(h) - size] * U64(m) + h[size:] if len(h) > size else h[:0]
        size *= 2
    return fmix(h)


def sliding_least(x: np.ndarray, wide: int) -> np.ndarray:
    """Minimum of each ``wide`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - wide + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // wide) * wide, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    block = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash, and first and last window start of each anchor, in order."""
    out = []
    for i, j in slices(offsets, _SEGMENT):
        a, z = int(offsets[i]), int(offsets[j])
        for at in range(a, max(z - length + 1, a), _SEGMENT):
            part = raw[at : min(at + _SEGMENT + length - 1, z)]
            h = gram_hashes(part, gram)
            if len(h) < length - gram + 1:
                continue
            packed = (h & ~_PLACE) | np.arange(len(h), dtype=U64)
            least = sliding_least(packed, length - gram + 1)
            start = np.arange(len(least)) + at
            owner = np.searchsorted(offsets, start, "right") - 1
            inside = start + length <= offsets[owner + 1]
            place = (least & _PLACE).astype(np.int64)[inside]
            start, owner = start[inside], owner[inside]
            if len(place):
                new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
                last = np.append(new[1:], len(place)) - 1
                out.append((place[new] + at, h[place[new]], start[new], start[last]))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    place, h, lo, hi = (np.concatenate(x) for x in zip(*out))
    same = np.zeros(len(place), bool)  # an anchor that two segments found
    same[1:] = place[1:] == place[:-1]
    first = np.flatnonzero(~same)
    return place[first], h[first], lo[first], hi[np.append(first[1:], len(place)) - 1]


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    step = 16
    while at < n:
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return at + m - (d.bit_length() + 7) // 8
        at += len(x)
        step *= 2
    return n


class Run:
    """Sorted suffixes: (key, member); a key is the hash and the suffix.

    A member is (digest, place, first and last offset of its windows, bytes before the
    anchor backwards).  ``packed`` and ``read`` are the front-coded form.
    """

    @staticmethod
    def packed(rows: list[tuple[bytes, tuple]]) -> bytes:
        out, last, before = [len(rows).to_bytes(4, "little")], b"", b""
        for key, (digest, place, lo, hi, left) in rows:
            n, m = shared(last, key), shared(before, left)
            out.append(np.array([n, len(key) - n, m, len(left) - m, lo, hi], "<u2").tobytes() + place.to_bytes(8, "little") + digest + key[n:] + left[m:])
            last, before = key, left
        return b"".join(out)

    @staticmethod
    def read(data: bytes) -> Iterator[tuple[bytes, int, tuple]]:
        """(key, common prefix with the key before, member)."""
        at, last, before = 4, b"", b""
        for _ in range(int.from_bytes(data[:4], "little")):
            n, more, m, rest, lo, hi = (int.from_bytes(data[at + 2 * i : at + 2 * i + 2], "little") for i in range(6))
            place, digest = int.from_bytes(data[at + 12 : at + 20], "little"), data[at + 20 : at + 36]
            at += 36
            key, left = last[:n] + data[at : at + more], before[:m] + data[at + more : at + more + rest]
            at += more + rest
            yield key, n, (digest, place, lo, hi, left)
            last, before = key, left


def merged(runs: list[Iterator[tuple[bytes, int, tuple]]]) -> Iterator[tuple[bytes, int, tuple]]:
    """All entries in order, each with its common prefix with the entry before.

    A loser tree over the runs.  ``prefix[r]`` is what run r's head shares with the last
    winner; every head is at least that winner, so of two heads the one that shares more
    is less, and only equals are compared, behind that prefix.
    """
    count = 1
    while count < len(runs):
        count *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (count - len(runs))
    prefix = [0] * count
    loser = [0] * count

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if prefix[a] != prefix[b]:
            # The shorter prefix is also what the loser shares with the winner.
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        p, q = x[0], y[0]
        n = shared(p, q, prefix[a])
        first = n == len(p) or (n < len(q) and p[n] < q[n])
        if n == len(p) == len(q):
            first = a < b
        win, lose = (a, b) if first else (b, a)
        prefix[lose] = n
        return win, lose

    def build(node: int) -> int:
        if node >= count:
            return node - count
        win, loser[node] = duel(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if count > 1 else 0
    while heads[win] is not None:
        key, _, member = heads[win]
        yield key, prefix[win], member
        heads[win] = next(runs[win], None) if win < len(runs) else None
        prefix[win] = heads[win][1] if heads[win] is not None else 0
        node = (win + count) // 2
        while node:
            win, loser[node] = duel(win, loser[node])
            node //= 2


def _pairs(group: list[tuple[bytes, int, tuple]], length: int) -> list[list[tuple[int, int]]]:
    """Ranges of window offsets that have an equal elsewhere, by comparing all pairs."""
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for i in range(len(group)):
        right = length + 8
        _, _, lo, hi, left = group[i][2]
        for j in range(i + 1, len(group)):
            right = min(right, group[j][1])
            _, _, lo2, hi2, left2 = group[j][2]
            most, least = shared(left, left2), length - (right - 8)
            a, b = max(least, lo, lo2), min(most, hi, hi2)
            if a <= b:
                out[i].append((a, b))
                out[j].append((a, b))
    return out


def _rolling(text: np.ndarray, length: int, m: int) -> np.ndarray:
    """Hashes of all windows of ``length`` bytes, or hashed words, from sums of powers."""
    power = np.full(len(text) + 1, U64(m))
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = U64(pow(m, -1, 1 << 64))
    back = np.full(len(text) + 1, inverse)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, U64), np.cumsum((_BYTES[text] if text.dtype == np.uint8 else text) * power[:-1])])
    n = len(text) - length + 1
    return fmix((total[length:] - total[:n]) * back[:n])


def _windows(group: list[tuple[bytes, int, tuple]], length: int) -> list[list[tuple[int, int]]]:
    """The same for a large group: partners by hash, checked byte by byte."""
    texts = [m[4][::-1] + key[8:] for key, _, m in group]
    count = [max(0, m[3] - m[2] + 1) for _, _, m in group]
    begin = np.concatenate([[0], np.cumsum(count)])
    hashes = np.empty(begin[-1], U64)
    offset = np.empty(begin[-1], np.int64)
    for i, (text, (_, _, m)) in enumerate(zip(texts, group)):
        first = len(m[4]) - m[3]  # the window of offset hi starts here
        part = np.frombuffer(text, np.uint8)[first : first + count[i] - 1 + length]
        hashes[begin[i] : begin[i + 1]] = _rolling(part, length, 0x5851F42D4C957F2D)
        offset[begin[i] : begin[i + 1]] = m[3] - np.arange(count[i])
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    equal = h[1:] == h[:-1]
    partner = np.full(len(h), -1)
    partner[order[1:][equal]] = order[:-1][equal]
    after = np.full(len(h), -1)
    after[order[:-1][equal]] = order[1:][equal]
    partner = np.where(partner < 0, after, partner)
    owner = np.repeat(np.arange(len(group)), count)
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for i in np.unique(owner[partner >= 0]).tolist():
        w, end = int(begin[i]), int(begin[i + 1])
        while w < end:
            p = int(partner[w])
            if p < 0:
                w += 1
                continue
            j, off = int(owner[p]), int(offset[w])
            x, y = texts[i][len(group[i][2][4]) - off :], texts[j][len(group[j][2][4]) - off :]
            n = shared(x, y)
            if n < length or int(offset[p]) != off:  # a false partner: look at the others of this hash
                n = _true_partner(w, i, hashes, offset, owner, texts, group, length)
            if n < length:
                w += 1
                continue
            last = min(n - length, end - 1 - w)
            out[i].append((off - last, off))
            w += last + 1
    return out


def _true_partner(w: int, i: int, hashes, offset, owner, texts, group, length: int) -> int:
    """The longest match of a window with any other of its hash; only after a collision."""
    best, off = 0, int(offset[w])
    x = texts[i][len(group[i][2][4]) - off :]
    for p in np.flatnonzero((hashes == hashes[w]) & (offset == off)).tolist():
        if p != w:
            j = int(owner[p])
            best = max(best, shared(x, texts[j][len(group[j][2][4]) - off :]))
    return best


def covered(entries: Iterator[tuple[bytes, int, tuple]], length: int = LENGTH, gram: int = GRAM, pairs: int = PAIRS) -> Iterator[tuple[bytes, int, int]]:
    """(digest, first byte, end) of repeated strings, from merged suffixes."""

    def settle(group):
        if len(group) > 1:
            for (_, _, (digest, place, *_)), found in zip(group, (_pairs if len(group) <= pairs else _windows)(group, length)):
                for a, b in found:
                    yield digest, place - b, place - a + length

    group: list[tuple[bytes, int, tuple]] = []
    for entry in entries:
        if group and entry[1] < 8 + gram:
            yield from settle(group)
            group = []
        group.append(entry)
    yield from settle(group)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _per_text(h: np.ndarray, at: np.ndarray, some: np.ndarray) -> pa.ListArray:
    """The part of ``h`` of each of some texts; the others have none."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(at)[some])]), pa.int32()), pa.array(h.view(np.int64)))


def _anchor_table(documents: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, size, hashes, words): anchors of the texts that have windows, of bytes or words."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        raw, offsets = text_buffer(batch["text"])
        place, h, _, _ = anchors(raw, offsets, length)
        word, _, _, word_at = words_of(raw, offsets)
        word_place, word_h, _, _ = anchors(word, word_at, WORDS, WORD_GRAM)
        data = raw.tobytes()
        some = np.flatnonzero((np.diff(offsets) >= length) | (np.diff(word_at) >= WORDS))
        digests = [hashlib.md5(data[offsets[i] : offsets[i + 1]]).digest() for i in some]
        lists = _per_text(h, np.searchsorted(place, offsets), some), _per_text(word_h, np.searchsorted(word_place, word_at), some)
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()).take(pa.array(some)), pa.array(digests, pa.binary()), pa.array(np.diff(offsets)[some]), *lists], ["doc_id", "digest", "size", "hashes", "words"])

    return map_texts(documents.select("doc_id", "text"), work, "doc_id long, digest binary, size long, hashes array<long>, words array<long>")


def _shippable(table: DataFrame, size) -> DataFrame:
    """Broadcast if a sum of sizes proves the table small enough."""
    n = table.agg(F.sum(size).alias("n")).first()["n"] or 0
    return F.broadcast(table) if n <= SHIP_BYTES else table


def _digest(column: str = "text"):
    return F.unhex(F.md5(F.col(column).cast("binary")))


def _runs(candidates: DataFrame, ranges: int, length: int) -> DataFrame:
    """(part, run): each task's suffixes at its candidate anchors, sorted, cut, front-coded.

    A task sorts at most ``RUN_ROWS`` suffixes at a time.
    """

    def suffixes(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple]]:
        raw, offsets = text_buffer(batch["text"])
        place, h, lo, hi = anchors(raw, offsets, length)
        at = np.searchsorted(place, offsets)
        data = raw.tobytes()
        for d, (digest, wanted) in enumerate(zip(batch["digest"].to_pylist(), batch["cold"])):
            keep = np.flatnonzero(np.isin(h[at[d] : at[d + 1]], np.asarray(wanted.values).view(U64))) + at[d]
            for p, key, a, z in zip(place[keep].tolist(), fmix(h[keep]).tolist(), lo[keep].tolist(), hi[keep].tolist()):
                # Least hashes are small; hashed once more they spread over the ranges.  Only what
                # the anchor's own windows reach is kept: back to the first, on to the last's end.
                yield key.to_bytes(8, "big") + data[p : z + length], (digest, p - int(offsets[d]), p - z, p - a, data[a:p][::-1])

    def run(rows: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        parts: dict[int, list] = {}
        for row in rows:
            parts.setdefault(int.from_bytes(row[0][:8], "big") * ranges >> 64, []).append(row)
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([Run.packed(x) for x in parts.values()], pa.binary())], ["part", "run"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, tuple]] = []
        for batch in batches:
            for row in suffixes(batch):
                rows.append(row)
                if len(rows) >= RUN_ROWS:
                    yield run(rows)
                    rows = []
        if rows:
            yield run(rows)

    return candidates.select("text", "digest", "cold").mapInArrow(work, "part int, run binary")


def _hot_spans(candidates: DataFrame, length: int) -> DataFrame:
    """(digest, spans) of windows at hot anchors: counted natively by their hashes."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        raw, offsets = text_buffer(batch["text"])
        place, h, lo, hi = anchors(raw, offsets, length)
        at = np.searchsorted(place, offsets)
        digests, starts, one, two = [], [], [], []
        for d, (digest, wanted) in enumerate(zip(batch["digest"].to_pylist(), batch["hot"])):
            keep = np.flatnonzero(np.isin(h[at[d] : at[d + 1]], np.asarray(wanted.values).view(U64))) + at[d]
            for a, z in zip(lo[keep].tolist(), hi[keep].tolist()):
                part = raw[a : z + length]
                one.append(_rolling(part, length, 0x5851F42D4C957F2D))
                two.append(_rolling(part, length, 0x2545F4914F6CDD1D))
                starts.append(np.arange(a, z + 1) - offsets[d])
                digests += [digest] * (z - a + 1)
        cat = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(digests, pa.binary()), pa.array(cat(starts)), pa.array(cat(one)), pa.array(cat(two))], ["digest", "start", "one", "two"])

    windows = map_texts(candidates.filter(F.size("hot") > 0).select("text", "digest", "hot"), work, "digest binary, start long, one long, two long")
    again = windows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two")
    found = windows.join(again, ["one", "two"])
    return found.groupBy("digest").agg(F.transform(F.array_sort(F.collect_set("start")), lambda s: F.struct(s.alias("lo"), (s + length).alias("hi"))).alias("spans"))


def _passages(texts: DataFrame, one_each: DataFrame, copies: DataFrame) -> DataFrame:
    """(digest, passage): how many words of a text are in runs of ``WORDS`` words that another text has."""
    each = one_each.select("digest", F.explode(F.array_distinct("words")).alias("h"))
    again = stage(each.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h"), "words-again")
    chosen = stage(each.join(_shippable(again, F.lit(16)), "h").groupBy("digest").agg(F.collect_list("h").alias("wanted")).join(copies, "digest", "left"), "words-chosen")
    candidates = texts.join(_shippable(chosen, F.size("wanted") * 8 + 64), "digest").filter(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))

    def work(batch: pa.RecordBatch) -> pa.Table:
        raw, offsets = text_buffer(batch["text"])
        word, _, _, word_at = words_of(raw, offsets)
        place, h, lo, hi = anchors(word, word_at, WORDS, WORD_GRAM)
        at = np.searchsorted(place, word_at)
        owner, start, hashes = [], [], []
        for d, wanted in enumerate(batch["wanted"]):
            keep = np.flatnonzero(np.isin(h[at[d] : at[d + 1]], np.asarray(wanted.values).view(U64))) + at[d]
            for a, z in zip(lo[keep].tolist(), hi[keep].tolist()):
                hashes.append(_rolling(word[a : z + WORDS], WORDS, 0x5851F42D4C957F2D))
                start.append(np.arange(a, z + 1) - word_at[d])
                owner += [d] * (z - a + 1)
        if not owner:
            return None
        return pa.Table.from_arrays([batch["key"].take(pa.array(owner)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], ["key", "start", "hash"])

    key = F.xxhash64("digest").alias("key")
    windows = stage(map_texts(candidates.select("text", key, "wanted"), work, "key long, start int, hash long"), "words-windows")
    # Shared windows grow with the input: they are met in a shuffle at every size.
    shared = windows.groupBy("hash").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("hash")
    found = windows.join(shared, "hash").groupBy("key").agg(F.array_sort(F.collect_set("start")).alias("s")).join(chosen.select("digest", key), "key")
    more = F.expr(f"aggregate(sequence(1, size(s) - 1), 0L, (n, i) -> n + least({WORDS}, s[i] - s[i - 1]))")
    return found.select("digest", (F.lit(WORDS) + F.when(F.size("s") > 1, more).otherwise(0)).cast("long").alias("passage"))


_SPANS = "array<struct<lo: bigint, hi: bigint>>"


def repeated_spans(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(digest, spans, passage): repeated strings of each text that has some; spans may overlap.

    ``passage`` is the number of words in passages that repeat, -1 if the whole text does.
    """
    spark = documents.sparkSession
    small_batches(spark)
    table = stage(_anchor_table(documents, length), "anchors")
    copies = stage(table.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("size").alias("size")).filter("n > 1"), "copies")
    groups = copies.drop("size")
    many = groups if groups.count() * 64 > SHIP_BYTES else F.broadcast(groups)  # else the texts of a large group meet in one task
    one_each = table.join(many, "digest", "left").filter(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))
    each = one_each.select("digest", F.explode("hashes").alias("h"))
    again = stage(each.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "again")
    per_text = each.distinct().join(again, "h").groupBy("digest").agg(
        F.collect_list(F.when(F.col("m") <= hot, F.col("h"))).alias("cold"), F.collect_list(F.when(F.col("m") > hot, F.col("h"))).alias("hot")
    )
    chosen = stage(per_text.join(groups, "digest", "left"), "chosen")
    size = chosen.agg(F.sum(F.size("cold")).alias("cold"), F.sum(F.size("hot")).alias("hot")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((size["cold"] or 0) * 600 // RANGE_BYTES) + 1)
    texts = documents.filter(F.octet_length("text") >= min(length, 2 * WORDS - 1)).select("doc_id", "text", _digest().alias("digest"))
    passages = _passages(texts, one_each, groups)
    candidates = texts.join(_shippable(chosen, F.size("cold") * 8 + F.size("hot") * 8 + 64), "digest")
    candidates = candidates.filter(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))

    def merge(group: pa.Table) -> pa.Table:
        spans: dict[bytes, list[tuple[int, int]]] = {}
        for digest, lo, hi in covered(merged([Run.read(x.as_py()) for x in group["run"]]), length):
            spans.setdefault(digest, []).append((lo, hi))
        lists = [[{"lo": lo, "hi": hi} for lo, hi in union(x)] for x in spans.values()]
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.Table.from_arrays([pa.array(list(spans), pa.binary()), pa.array(lists, kind)], ["digest", "spans"])

    found = _runs(candidates, ranges, length).groupBy("part").applyInArrow(merge, f"digest binary, spans {_SPANS}")
    if size["hot"]:
        found = found.unionByName(_hot_spans(candidates, length))
    whole = F.when(F.col("size") >= length, F.expr("array(struct(0L as lo, 9223372036854775807L as hi))"))
    every = found.withColumn("passage", F.lit(0).cast("long")).unionByName(copies.select("digest", whole.alias("spans"), F.lit(-1).cast("long").alias("passage")))
    every = every.unionByName(passages.select("digest", F.lit(None).cast(_SPANS).alias("spans"), "passage"))
    least = F.min("passage")  # -1 goes before any count
    return stage(every.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.when(least < 0, least).otherwise(F.max("passage")).alias("passage")), "spans")


def without_repeats(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, kept) for each row of ``documents``."""
    found = _shippable(repeated_spans(documents, length, hot), F.size("spans") * 16 + 72)
    rows = documents.select("doc_id", "text", _digest().alias("digest")).join(found, "digest", "left").select("doc_id", "text", "spans", "passage")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"]

    def one(text: str | None, spans: list[dict] | None, passage: int | None) -> tuple:
        raw = (text or "").encode()
        gone = union([(s["lo"], min(s["hi"], len(raw))) for s in spans or ()])
        parts, at = [], 0
        for lo, hi in gone:
            parts.append(raw[at:lo])
            at = hi
        kept = b"".join([*parts, raw[at:]])
        if passage == -1:
            n = len(words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
            passage = n if n >= WORDS else 0
        return len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), passage or 0, kept

    def work(batch: pa.RecordBatch) -> pa.Table:
        out = [one(t.as_py(), s.as_py(), p.as_py()) for t, s, p in zip(batch["text"], batch["spans"], batch["passage"])]
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return map_texts(rows, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary")
