"""k-mers of many reads at once, as arrays; runs of neighbouring k-mers as what is shuffled.

A k-mer's bin comes from the least hashed canonical m-mer of its stem (its minimizer), so
all k-mers of a root, on both strands, are in one bin and neighbours mostly share one.  A
run of neighbours in a bin is stored as its bases, four to a byte, and a byte for its kind
and length: some 1.5 bytes a k-mer instead of a row.  Counting in a bin needs nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import ship

#: Bins (a power of two), bases that are worked on at once, k-mers of a run, bytes
#: of runs that are counted at once, rows of a result's batch.
BINS, BASES, LONGEST, RUN_BYTES, OUT_ROWS = 2048, 1 << 20, 127, 1 << 19, 50_000
_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = range(4)
_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))
COUNTERS = ("a_n", "a_t", "b_n", "b_t")


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a column of strings; null is empty."""
    a = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(offsets: np.ndarray, most: int = BASES) -> Iterator[tuple[int, int]]:
    """Ranges of reads with up to ``most`` bases, one read at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def places(codes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Where k bases without N start, within one read."""
    n_at = np.flatnonzero(codes == 4)
    starts = np.sort(np.concatenate([offsets[:-1], n_at + 1]))
    ends = np.sort(np.concatenate([offsets[1:], n_at]))
    long_ = ends - starts >= k
    change = np.zeros(len(codes) + 1, np.int8)
    # A place that ends one stretch may start the next.
    np.add.at(change, starts[long_], 1)
    np.add.at(change, ends[long_] - k + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))


def codes_at(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-mers at ``at`` as unsigned longs, two bits a base."""
    out = np.zeros(len(at), np.uint64)
    done = 0
    if k >= 8:
        two = (codes[:-1].astype(np.uint16) << 2) | codes[1:]
        four = (two[:-2] << 4) | two[2:]
        eight = (four[:-4] << 8) | four[4:]
        while done + 8 <= k:
            out = (out << np.uint64(16)) | eight[at + done]
            done += 8
    while done < k:
        out = (out << np.uint64(2)) | codes[at + done]
        done += 1
    return out


def complement(kmers: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements."""
    x = ~kmers
    for n, mask in _SWAPS:
        n, m = np.uint64(n), np.uint64(mask)
        x = ((x >> n) & m) | ((x & m) << n)
    return (x >> np.uint64(64 - 2 * k)) & np.uint64((1 << 2 * k) - 1)


def roots(kmers: np.ndarray, rcs: np.ndarray, k: int) -> np.ndarray:
    mask = np.uint64((1 << 2 * (k - 2)) - 1)
    return np.minimum((kmers >> np.uint64(2)) & mask, (rcs >> np.uint64(2)) & mask)


def bins(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The bin of each k-mer: the same for all k-mers of a root."""
    m = min(10, max(1, (k - 2) // 2))
    n, w = len(codes) - m + 1, k - 1 - m
    f, r, each = np.zeros(n, np.uint32), np.zeros(n, np.uint32), (codes & 3).astype(np.uint32)
    for j in range(m):
        c = each[j : j + n]
        f <<= np.uint32(2)
        f |= c
        r |= (np.uint32(3) - c) << np.uint32(2 * j)
    least = np.minimum(f, r, out=f)
    least *= np.uint32(0x9E3779B1)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[at + 1], least[at + 1 + w - span])
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (least >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.uint16)


def _stretches(codes: np.ndarray, at: np.ndarray, k: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin, the first of ``at`` and the k-mers of each run, by bin."""
    bin_ = bins(codes, at, k)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (bin_[1:] != bin_[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    parts = (n + longest - 1) // longest
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(longest, np.repeat(n, parts) - longest * nth)
        first = np.repeat(first, parts) + longest * nth
    order = np.argsort(bin_[first], kind="stable")
    first, n = first[order], n[order]
    return bin_[first], first, n


def _runs(codes: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, k: int, longest: int = LONGEST) -> pa.RecordBatch | None:
    """(bin, heads, bases): the runs of some reads, a row to each bin that they are in.  A head is a run's k-mers and its kind above them."""
    at = places(codes, offsets, k)
    if not len(at):
        return None
    bin_, first, n = _stretches(codes, at, k, longest)
    start = at[first]
    heads = (n | (kinds[np.searchsorted(offsets, start, "right") - 1].astype(np.int64) << longest.bit_length())).astype(np.uint8)
    size = (n + k + 2) // 4
    c = np.append(codes & 3, np.zeros(4, np.uint8))
    quad = (c[:-4] << 6) | (c[1:-3] << 4) | (c[2:-2] << 2) | c[3:-1]
    ends = np.cumsum(size)
    from_ = np.repeat((start - 4 * (ends - size)).astype(np.int32), size)
    from_ += np.arange(0, 4 * ends[-1], 4, np.int32)
    bases = quad[np.minimum(from_, len(quad) - 1)]
    del from_, quad, c
    rows = np.flatnonzero(np.append(True, bin_[1:] != bin_[:-1]))
    binary = lambda data, to: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(0, to).astype(np.int32)), pa.py_buffer(data)])
    last = np.append(rows[1:], len(bin_)) - 1
    return pa.RecordBatch.from_arrays([pa.array(bin_[rows].astype(np.int32)), binary(heads, last + 1), binary(bases, ends[last])], ["bin", "heads", "bases"])


def _kmers(heads: np.ndarray, bases: np.ndarray, k: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of runs, in order, and how many each run has."""
    n = (heads & longest).astype(np.int64)
    size = (n + k + 2) // 4
    codes = np.empty((len(bases), 4), np.uint8)
    for j in range(4):
        codes[:, j] = (bases >> (6 - 2 * j)) & 3
    ends = np.cumsum(n)
    at = np.repeat(4 * (np.cumsum(size) - size) - (ends - n), n) + np.arange(ends[-1])
    return codes_at(codes.ravel(), at, k), n


def _counted(heads: np.ndarray, bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The lesser of each k-mer and its reverse complement, ascending, and their four counters."""
    kmers, n = _kmers(heads, bases, k)
    return _pairs(kmers, np.repeat((heads >> 7).astype(np.uint64), n), k)


def _pairs(kmers: np.ndarray, kinds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rcs = complement(kmers, k)
    side = (kmers > rcs).astype(np.uint64) << np.uint64(1) | kinds
    found, times = np.unique((np.minimum(kmers, rcs) << np.uint64(2)) | side, return_counts=True)
    keys = found >> np.uint64(2)
    new = np.append(True, keys[1:] != keys[:-1])
    counters = np.zeros((int(new.sum()), 4), np.int64)
    counters[np.cumsum(new) - 1, (found & np.uint64(3)).astype(np.int64)] = times
    return keys[new], counters


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, counters = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(counters[order], new)


class _Bin:
    """The counters of one bin, from its runs in pieces of bounded size."""

    def __init__(self, k: int):
        self.k, self.raw, self.size, self.parts = k, [], 0, []

    def add(self, heads: np.ndarray, bases: np.ndarray) -> None:
        self.raw.append((heads, bases))
        self.size += len(heads) + len(bases)
        if self.size >= RUN_BYTES:
            self.count()

    def count(self) -> None:
        if self.raw:
            counted_ = _counted(np.concatenate([h for h, _ in self.raw]), np.concatenate([b for _, b in self.raw]), self.k)
            self.raw, self.size = [], 0
            self.put(counted_)

    def put(self, part: tuple[np.ndarray, np.ndarray]) -> None:
        if len(part[0]):
            self.parts.append(part)
            while len(self.parts) > 1 and len(self.parts[-2][0]) < 2 * len(self.parts[-1][0]):
                self.parts[-2:] = [_summed(self.parts[-2:])]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.count()
        return _summed(self.parts)


#: What a bin's pairs are chosen by: their counters (a column each) and their root's total.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pair_table(reads: DataFrame, k: int, most: int, wanted: Wanted | None = None) -> DataFrame:
    """(root, total, a, b, a_n, a_t, b_n, b_t) of reads (kind, seq): every pair of a k-mer and
    its reverse complement, counters at most ``most``, with its root's total before that.

    ``wanted`` chooses pairs before they leave their bin.  One shuffle, of runs.
    """
    ship(reads.sparkSession)

    def cut(batches):
        for batch in batches:
            pa.default_memory_pool().release_unused()
            data, offsets = _strings(batch.column(1))
            kinds = batch.column(0).to_numpy()
            for i, j in _pieces(offsets):
                out = _runs(_CODE[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], kinds[i:j], k)
                if out is not None:
                    yield out

    def rows(bin_: _Bin):
        keys, counters = bin_.result()
        rcs = complement(keys, k)
        root = roots(keys, rcs, k)
        order = np.argsort(root, kind="stable")
        root, keys, rcs, counters = root[order], keys[order], rcs[order], counters[order]
        new = np.append(True, root[1:] != root[:-1])
        total = np.add.reduceat(counters.sum(axis=1), np.flatnonzero(new))[np.cumsum(new) - 1]
        counters = np.minimum(counters, most)
        if wanted is not None:
            keep = np.flatnonzero(wanted(counters, total))
            root, total, keys, rcs, counters = root[keep], total[keep], keys[keep], rcs[keep], counters[keep]
        for i in range(0, len(keys), OUT_ROWS):
            s = slice(i, i + OUT_ROWS)
            columns = [root[s].view(np.int64), total[s], keys[s].view(np.int64), rcs[s].view(np.int64), *(np.ascontiguousarray(counters[s, j]) for j in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["root", "total", "a", "b", *COUNTERS])

    def count(batches):
        now, bin_ = None, None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            heads, bases = (_strings(batch.column(i)) for i in (1, 2))
            for i, x in enumerate(ids):
                if x != now:
                    if bin_ is not None:
                        yield from rows(bin_)
                    now, bin_ = x, _Bin(k)
                # Copies: a piece must not hold its whole batch.
                bin_.add(heads[0][heads[1][i] : heads[1][i + 1]].copy(), bases[0][bases[1][i] : bases[1][i + 1]].copy())
        if bin_ is not None:
            yield from rows(bin_)

    cut_ = reads.filter("kind in (0, 1)").select("kind", "seq").mapInArrow(cut, "bin int, heads binary, bases binary")
    return cut_.repartition("bin").sortWithinPartitions("bin").mapInArrow(count, ", ".join(f"{c} long" for c in ("root", "total", "a", "b", *COUNTERS)))


class _Found:
    """Looks up k-mers by root in ``wanted`` (root, key, tags), sorted by root."""

    def __init__(self, wanted: pa.Table):
        self.roots, self.keys = (wanted.column(c).to_numpy().view(np.uint64) for c in ("root", "key"))
        # Most places fail a look into a bitmap of the roots' hashes.
        bits = max(16, min(24, len(wanted).bit_length() + 5))
        self.spin, self.shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[(self.roots * self.spin) >> self.shift] = True

    def at(self, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose root is wanted, and the row of ``wanted``: once for each row of it."""
        hit = np.flatnonzero(self.some[(root * self.spin) >> self.shift])
        first = np.searchsorted(self.roots, root[hit])
        n = np.searchsorted(self.roots, root[hit], "right") - first
        row = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(hit, n), row


_FOUR = np.array([int.from_bytes(bytes(b"ACGT"[(x >> s) & 3] for s in (6, 4, 2, 0)), "little") for x in range(256)], "<u4")


def texts(keys: np.ndarray, k: int) -> pa.Array:
    """The bases of k-mers."""
    n, size = len(keys), (k + 3) // 4
    bytes_ = (keys << np.uint64(64 - 2 * k)).astype(">u8").view(np.uint8).reshape(n, 8)[:, :size]
    bases = np.ascontiguousarray(_FOUR[bytes_].view(np.uint8).reshape(n, 4 * size)[:, :k])
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.py_buffer(bases)])


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists of ``n`` owners; ``owner`` ascends."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))


def _distinct(owner: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending; values of at most ``bits`` bits."""
    both = np.unique((owner.astype(np.int64) << bits) | values.astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


#: A read's row: its places by direction and the candidates' keys that it meets.  ``own`` is 1 in one row of each read.
READ_ROW = "kind int, id string, own int, seq string, keys array<bigint>, a array<int>, b array<int>"


def by_read(reads: DataFrame, k: int, wanted: pa.Table, schema: StructType) -> DataFrame:
    """(kind, id, own, seq, keys, a, b, tags) of reads (id, kind, seq): a row for each read and tags
    that it meets, or a row without a sequence for a read that meets nothing.

    ``wanted`` (root, key, tags) is sorted by root.  Places are those of ``filter.hits``.
    """
    ship(reads.sparkSession)
    names = [f.name for f in schema.fields if f.name not in ("root", "key")]
    more = wanted.select(names).combine_chunks()
    if names:  # candidates with the same tags have the same label
        values = more.to_pylist()
        label_of = {x: i for i, x in enumerate(dict.fromkeys(tuple(v.values()) for v in values))}
        labels = np.array([label_of[tuple(v.values())] for v in values], np.int64)
        shown = np.unique(labels, return_index=True)[1]
    else:
        labels, shown = np.zeros(1, np.int64), np.zeros(1, np.int64)
    more = more.take(pa.array(shown)) if names else more
    wanted, stem = wanted.select(["root", "key"]), np.uint64((1 << 2 * (k - 2)) - 1)

    def find(batches):
        found, n_labels = _Found(wanted), len(shown)
        width = len(found.keys).bit_length()
        for batch in batches:
            pa.default_memory_pool().release_unused()
            ids, kinds, seqs = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            data, offsets = _strings(seqs)
            for i, j in _pieces(offsets, BASES // 4):
                codes, here = _CODE[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                at = places(codes, here, k)
                kmers = codes_at(codes, at, k) if len(at) else np.zeros(0, np.uint64)
                rcs = complement(kmers, k)
                hit, row = found.at(roots(kmers, rcs, k))
                read = np.searchsorted(here, at[hit], "right") - 1
                owner = read * n_labels + (labels[row] if names else 0)
                rows = np.unique(owner)
                owner = np.searchsorted(rows, owner)
                key, one, two = found.keys[row], kmers[hit], rcs[hit]
                tumor = kinds[read + i] == 1
                ahead = tumor & (one == key)
                behind = tumor & (two == key) & ~ahead & (((one ^ two) >> np.uint64(2)) & stem != 0)
                n_at = np.append(-1, np.flatnonzero(codes == 4))
                lists = []
                by, key_rows = _distinct(owner, row, width)
                of = rows // n_labels
                none = np.setdiff1d(np.arange(j - i), of)
                n = len(rows) + len(none)
                lists.append(_lists(found.keys[key_rows].view(np.int64), by, n, pa.int64()))
                for chosen in (ahead, behind):
                    h, r = at[hit[chosen]], read[chosen]
                    place = h - np.maximum(here[r], n_at[np.searchsorted(n_at, h) - 1] + 1)
                    by, pos = _distinct(owner[chosen], place if chosen is ahead else here[r + 1] - here[r] - k - place, 32)
                    lists.append(_lists(pos.astype(np.int32), by, n, pa.int32()))
                first = np.append(np.append(True, of[1:] != of[:-1])[: len(of)], np.ones(len(none), bool))
                taken, met_ = np.append(of, none) + i, np.append(np.ones(len(of), bool), np.zeros(len(none), bool))
                seq = seqs.take(pa.array(taken, mask=~met_))
                tags = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (x.take(pa.array(np.append(rows % n_labels, none * 0), mask=~met_)) for x in more.columns)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds[taken].astype(np.int32)), ids.take(pa.array(taken)), pa.array(first.astype(np.int32)), seq, *lists, *tags], ["kind", "id", "own", "seq", "keys", "a", "b", *names])

    tagged = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in names]
    return reads.filter("kind is not null").select("id", "kind", "seq").mapInArrow(find, ", ".join([READ_ROW, *tagged]))


def held(reads: DataFrame, k: int, wanted: pa.Table) -> DataFrame:
    """(set, kmer, id) of reads (id, kind, seq), one for each read and candidate whose root it meets: ``k2i``, if no
    reads share an id.  ``wanted`` (root, key) is sorted by root."""
    ship(reads.sparkSession)

    def find(batches):
        found = _Found(wanted)
        width = len(found.keys).bit_length()
        names = pa.array(["nn", "tn"])
        for batch in batches:
            pa.default_memory_pool().release_unused()
            ids, kinds = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = _strings(batch.column(2))
            for i, j in _pieces(offsets, BASES // 4):
                codes, here = _CODE[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                at = places(codes, here, k)
                if not len(at):
                    continue
                kmers = codes_at(codes, at, k)
                hit, row = found.at(roots(kmers, complement(kmers, k), k))
                read, row = _distinct(np.searchsorted(here, at[hit], "right") - 1, row, width)
                for s in range(0, len(row), OUT_ROWS):
                    r, w = read[s : s + OUT_ROWS] + i, row[s : s + OUT_ROWS]
                    sets = pa.DictionaryArray.from_arrays(pa.array((kinds[r] != 0).astype(np.int8)), names).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([sets, texts(found.keys[w], k), ids.take(pa.array(r))], ["set", "kmer", "id"])

    return reads.filter("kind is not null").select("id", "kind", "seq").mapInArrow(find, "set string, kmer string, id string")


def united(rows: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``by_read`` that hit, made one for each kind, id and ``tags``: the least sequence, and
    all their keys and places.  One shuffle, of neighbours that are united before it."""
    ship(rows.sparkSession)
    by = ["kind", "id", *tags]

    def one(table: pa.Table):
        n = len(table)
        keys = [table.column(c).combine_chunks() for c in by]
        new = np.zeros(n, bool)
        new[0] = True
        for c in keys:
            x, y = c.slice(0, n - 1), c.slice(1)
            same = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False)
            nulls = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | (nulls[1:] & nulls[:-1]))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        out = table.take(pa.array(first))
        if len(first) < n:
            for c in ("keys", "a", "b"):
                column = table.column(c).combine_chunks()
                values = column.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(group, pc.list_value_length(column).to_numpy(zero_copy_only=False))
                order = np.lexsort((values, owner))
                values, owner = values[order], owner[order]
                fresh = np.ones(len(values), bool)
                fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                out = out.set_column(out.schema.get_field_index(c), c, _lists(values[fresh], owner[fresh], len(first), column.type.value_type))
        return out.combine_chunks().to_batches()

    def unite(batches):
        left = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            last, n = [table.column(c)[-1] for c in by], len(table)
            # The last group may go on in the next batch.
            while n and [table.column(c)[n - 1] for c in by] == last:
                n -= 1
            left = table.slice(n)
            if n:
                yield from one(table.slice(0, n))
        if left is not None:
            yield from one(left)

    held = rows.select("kind", "id", "seq", "keys", "a", "b", *tags).filter("seq is not null")
    # Rows of an id have one sequence, so it doesn't matter which of them come together first.
    return held.mapInArrow(unite, held.schema).repartition(*by).sortWithinPartitions(*by, "seq").mapInArrow(unite, held.schema)


def met(reads: DataFrame, k: int, wanted: pa.Table, schema: StructType) -> DataFrame:
    """(id, kind, key, dir, pos, tags) of reads (id, kind, seq): the places whose root is one of
    ``wanted`` (root, key, tags), sorted by root, with each row of it that has that root.

    As ``filter.hits`` describes them.
    """
    ship(reads.sparkSession)
    more = wanted.drop_columns(["root", "key"]).combine_chunks()
    stem = np.uint64((1 << 2 * (k - 2)) - 1)

    def find(batches):
        found = _Found(wanted)
        keys = found.keys
        for batch in batches:
            pa.default_memory_pool().release_unused()
            ids, kinds = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = _strings(batch.column(2))
            for i, j in _pieces(offsets, BASES // 4):
                codes, here = _CODE[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                at = places(codes, here, k)
                if not len(at):
                    continue
                n_at = np.append(-1, np.flatnonzero(codes == 4))
                kmers = codes_at(codes, at, k)
                rcs = complement(kmers, k)
                hit, row = found.at(roots(kmers, rcs, k))
                read = np.searchsorted(here, at[hit], "right") - 1
                for s in range(0, len(hit), OUT_ROWS):
                    h, r, w = hit[s : s + OUT_ROWS], read[s : s + OUT_ROWS], row[s : s + OUT_ROWS]
                    tumor, one, two, key = kinds[r + i] == 1, kmers[h], rcs[h], keys[w]
                    ahead = tumor & (one == key)
                    behind = tumor & (two == key) & ~ahead & (((one ^ two) >> np.uint64(2)) & stem != 0)
                    placed = ahead | behind
                    place = at[h] - np.maximum(here[r], n_at[np.searchsorted(n_at, at[h]) - 1] + 1)
                    pos = np.where(ahead, place, here[r + 1] - here[r] - k - place).astype(np.int32)
                    dir_ = pa.DictionaryArray.from_arrays(pa.array(behind.astype(np.int8), mask=~placed), ["a", "b"]).cast(pa.string())
                    taken = pa.array(w)
                    tags = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (x.take(taken) for x in more.columns)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + i)), pa.array(kinds[r + i].astype(np.int32)), pa.array(key.view(np.int64)), dir_, pa.array(pos, mask=~placed), *tags], ["id", "kind", "key", "dir", "pos", *more.column_names])

    tagged = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in ("root", "key")]
    return reads.filter("kind is not null").select("id", "kind", "seq").mapInArrow(find, ", ".join(["id string, kind int, key long, dir string, pos int", *tagged]))


def holding(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(kind, id, key) of rows (kind, id, keys): the keys of which 2 * key + kind is in ``wanted``, ascending."""
    ship(rows.sparkSession)

    def find(batches):
        for batch in batches:
            lists = batch.column(2)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            kinds = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            x = 2 * keys + kinds
            at = np.searchsorted(wanted, x)
            held = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == x) if len(wanted) else np.zeros(0, np.int64)
            for s in range(0, len(held), OUT_ROWS):
                h = held[s : s + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(kinds[h].astype(np.int32)), batch.column(1).take(pa.array(owner[h])), pa.array(keys[h])], ["kind", "id", "key"])

    return rows.filter("kind in (0, 1)").select("kind", "id", "keys").mapInArrow(find, "kind int, id string, key long")


def counted(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(nth, kind, n): rows (kind, keys) of each kind that hold the nth key of ``wanted``, ascending keys."""
    ship(rows.sparkSession)

    def count(batches):
        n = np.zeros((2, len(wanted)), np.int64)
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            kinds = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            at = np.searchsorted(wanted, keys)
            held = wanted[np.minimum(at, len(wanted) - 1)] == keys
            np.add.at(n, (kinds[held], at[held]), 1)
        for kind in (0, 1):
            some = np.flatnonzero(n[kind])
            for i in range(0, len(some), OUT_ROWS):
                x = some[i : i + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(np.full(len(x), kind, np.int32)), pa.array(n[kind][x])], ["nth", "kind", "n"])

    return rows.filter("kind in (0, 1)").select("kind", "keys").mapInArrow(count, "nth int, kind int, n long").groupBy("nth", "kind").sum("n").toDF("nth", "kind", "n")


def windowed(rows: DataFrame, least: int, length: int) -> DataFrame:
    """(id, dir) of rows (id, a, b), places ascending, with ``least`` places of a direction in under ``length`` bases."""
    ship(rows.sparkSession)

    def shift(batches):
        for batch in batches:
            for d in (1, 2):
                lists = batch.column(d)
                pos = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                n = max(0, len(pos) - least + 1)
                last = slice(least - 1, least - 1 + n)
                led = np.unique(owner[:n][(owner[last] == owner[:n]) & (pos[last] - pos[:n] < length)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(led)), pa.array(["ab"[d - 1]] * len(led), pa.string())], ["id", "dir"])

    return rows.select("id", "a", "b").mapInArrow(shift, "id string, dir string")


def entries(rows: DataFrame, k: int, last: int | None, known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, dir, pos, key, times, n, t) of the places up to ``last`` of leaders (id, seq, a, b): the k-mer there,
    how often its leader has it, and its counters in ``known`` (keys, ascending; counters of both kinds)."""
    ship(rows.sparkSession)

    def cut(batches):
        for batch in batches:
            data, offsets = _strings(batch.column(1))
            codes = np.append(_CODE[data], np.zeros(k, np.uint8))
            owner, pos, key, side = [], [], [], []
            for d, lists in enumerate((batch.column(2), batch.column(3))):
                p = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                o = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                if last is not None:
                    o, p = o[p <= last], p[p <= last]
                found = codes_at(codes, offsets[o] + p if d == 0 else offsets[o + 1] - k - p, k)
                owner.append(o), pos.append(p), key.append(complement(found, k) if d else found), side.append(np.full(len(o), d, np.int8))
            owner, pos, key, side = (np.concatenate(x) for x in (owner, pos, key, side))
            if not len(owner):
                continue
            key = key.view(np.int64)
            order = np.lexsort((key, owner))
            owner, pos, key, side = owner[order], pos[order], key[order], side[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(owner)))[np.cumsum(new) - 1]
            counters = np.zeros((len(key), 2), np.int64)
            if known is not None and len(known[0]):
                at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
                counters = np.where((known[0][at] == key)[:, None], known[1][at], 0)
            dirs = pa.DictionaryArray.from_arrays(pa.array(side), ["a", "b"]).cast(pa.string())
            columns = [batch.column(0).take(pa.array(owner)), dirs, pa.array(pos.astype(np.int32)), pa.array(key), pa.array(times), *(pa.array(np.ascontiguousarray(counters[:, j])) for j in (0, 1))]
            whole = pa.RecordBatch.from_arrays(columns, ["id", "dir", "pos", "key", "times", "n", "t"])
            for i in range(0, len(whole), OUT_ROWS):
                yield whole.slice(i, OUT_ROWS)

    return rows.select("id", "seq", "a", "b").mapInArrow(cut, "id string, dir string, pos int, key long, times long, n long, t long")


#: Roots of a block of the table of repeated roots, as bits; roots of one task that are sorted at once; bits of a root that has one.
BLOCK_BITS, SORTED, DENSE_BITS = 20, 1 << 22, 28


def _gaps(values: np.ndarray) -> np.ndarray:
    """Ascending whole numbers as bytes: their gaps, each a number of 255s and a byte below."""
    gap = np.diff(values, prepend=values.dtype.type(0))
    skips = (gap // 255).astype(np.int64)
    out = np.full(len(values) + int(skips.sum()), 255, np.uint8)
    out[np.cumsum(skips + 1) - 1] = gap % 255
    return out


def _of_gaps(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def repeated(reads: DataFrame, k: int) -> np.ndarray:
    """A bit for each possible root of reads (seq), of at most ``DENSE_BITS``: whether it occurs at least twice.

    Roots are shuffled once, sorted, as gaps of a byte or so, and at most twice each from a task's
    share of ``SORTED``; what comes back is the table, 32 MB at most.
    """
    ship(reads.sparkSession)
    bits = 2 * (k - 2)
    low = min(bits, BLOCK_BITS)

    def blocks(parts: list[np.ndarray]):
        all_ = np.sort(np.concatenate(parts))
        third = np.zeros(len(all_), bool)
        third[2:] = all_[2:] == all_[:-2]
        all_ = all_[~third]
        block = all_ >> low
        for s in np.split(np.arange(len(all_)), np.flatnonzero(block[1:] != block[:-1]) + 1):
            yield int(block[s[0]]), _gaps(all_[s[0] : s[-1] + 1] & np.uint32((1 << low) - 1)).tobytes()

    def cut(batches):
        parts, size = [], 0
        schema = pa.schema([("block", pa.int32()), ("gaps", pa.binary())])
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*blocks(parts)), schema, strict=True)], schema=schema)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            data, offsets = _strings(batch.column(0))
            for i, j in _pieces(offsets):
                codes, here = _CODE[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                at = places(codes, here, k)
                if len(at):
                    kmers = codes_at(codes, at, k)
                    parts.append(roots(kmers, complement(kmers, k), k).astype(np.uint32))
                    size += len(at)
                if size >= SORTED:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    def unite(batches):
        now, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = _strings(batch.column(1))
            for i, x in enumerate(ids):
                if x != now:
                    if now is not None:
                        yield done()
                    now, once, twice = int(x), np.zeros(1 << max(3, low), bool), np.zeros(1 << max(3, low), bool)
                values = _of_gaps(data[offsets[i] : offsets[i + 1]])
                same = np.flatnonzero(values[1:] == values[:-1])
                twice[values[same]] = True
                twice[values[once[values]]] = True
                once[values] = True
        if now is not None:
            yield done()

    rows = reads.select("seq").mapInArrow(cut, "block int, gaps binary").repartition("block").sortWithinPartitions("block").mapInArrow(unite, "block int, bits binary").toArrow()
    size = max(1, (1 << low) // 8)
    table = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for block, of in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        table[block * size : (block + 1) * size] = np.frombuffer(of.as_buffer(), np.uint8)
    return table


def of_repeated(reads: DataFrame, k: int, table: np.ndarray, each: bool = False) -> DataFrame:
    """(id, kind, kmers, roots) of reads (id, kind, seq): their k-mers with a root in ``table``, and distinct roots of them;
    reads without any are left out.  With ``each``, (id, kind, root, kmers)."""
    ship(reads.sparkSession)
    bits = 2 * (k - 2)

    def find(batches):
        for batch in batches:
            pa.default_memory_pool().release_unused()
            ids, kinds = batch.column(0), batch.column(1)
            data, offsets = _strings(batch.column(2))
            for i, j in _pieces(offsets, BASES // 4):
                codes, here = _CODE[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                at = places(codes, here, k)
                if not len(at):
                    continue
                kmers = codes_at(codes, at, k)
                root = roots(kmers, complement(kmers, k), k)
                in_ = np.flatnonzero((table[root >> np.uint64(3)] >> (root & np.uint64(7)).astype(np.uint8)) & 1)
                read = np.searchsorted(here, at[in_], "right") - 1
                both = np.sort((read << bits) | root[in_].astype(np.int64))
                if not len(both):
                    continue
                first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                if each:
                    columns = [both[first] & ((1 << bits) - 1), np.diff(np.append(first, len(both)))]
                    taken = both[first] >> bits
                else:
                    n = np.bincount(read, minlength=j - i)
                    taken = np.flatnonzero(n)
                    columns = [n[taken], np.bincount(both[first] >> bits, minlength=j - i)[taken]]
                whole = pa.RecordBatch.from_arrays([ids.take(pa.array(taken + i)), kinds.take(pa.array(taken + i)).cast(pa.int32()), *map(pa.array, columns)], ["id", "kind", *(("root", "kmers") if each else ("kmers", "roots"))])
                for s in range(0, len(whole), OUT_ROWS):
                    yield whole.slice(s, OUT_ROWS)

    return reads.select("id", "kind", "seq").mapInArrow(find, "id string, kind int, " + ("root long, kmers long" if each else "kmers long, roots long"))


#: What a value's byte holds: 0 for a root that isn't known, then both counters, or that they follow.
_LOW_N, _LOW_T, _MORE = 14, 18, 253
#: k-mers of a bin that are looked up at once, some 100 bytes each.
WHOLE = 2_000_000


def _values(known: np.ndarray, n: np.ndarray, t: np.ndarray) -> bytes:
    """Counters of at most 65,535, a byte each and four more where they are greater."""
    small = (n < _LOW_N) & (t < _LOW_T)
    first = np.where(known, np.where(small, 1 + n * _LOW_T + t, _MORE), 0).astype(np.uint8)
    more = known & ~small
    return first.tobytes() + n[more].astype("<u2").tobytes() + t[more].astype("<u2").tobytes()


def _looked_up(kmers: np.ndarray, kinds: np.ndarray, k: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers' numbers, and by number whether its root is known, n and t: a whole bin, in one sort by root and k-mer."""
    rcs, m, count = complement(kmers, k), np.uint64((1 << 2 * (k - 2)) - 1), len(kmers)
    a, b = (kmers >> np.uint64(2)) & m, (rcs >> np.uint64(2)) & m
    turned = (b < a) | ((a == b) & (rcs < kmers))
    own = np.where(turned, rcs, kmers)
    code = ((np.minimum(a, b) << np.uint64(4)) | ((own >> np.uint64(2 * k - 2)) << np.uint64(2)) | (own & np.uint64(3))) << np.uint64(1) | turned
    bits = count.bit_length()
    if 2 * k + 1 + bits <= 64:
        both = np.sort((code << np.uint64(bits)) | np.arange(count, dtype=np.uint64))
        order, code = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    new = np.append(True, code[1:] != code[:-1])
    nth = np.cumsum(new, dtype=np.int32) - 1
    code = code[new]
    counts = np.bincount(3 * nth + kinds[order], minlength=3 * len(code)).reshape(-1, 3)
    root = code >> np.uint64(5)
    first = np.append(True, root[1:] != root[:-1])
    known = np.add.reduceat(counts[:, 0] + counts[:, 1], np.flatnonzero(first)) >= least
    number = np.empty(count, np.int32)
    number[order] = nth
    return number, known[np.cumsum(first) - 1], np.minimum(counts[:, 0], most), np.minimum(counts[:, 1], most)


def _of_values(data: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``known``, n and t of ``count`` values."""
    first, rest = data[:count], np.frombuffer(data[count:].tobytes(), "<u2")
    n, t = np.divmod(first.astype(np.int32) - 1, _LOW_T)
    more = first == _MORE
    n[more], t[more] = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    return first > 0, n, t


def _lines(at: np.ndarray, n: np.ndarray, t: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``at:n:t at:n:t ..`` of reads whose places end at ``ends``, after a 0: words of a table that are put one after the other."""
    places_ = pa.array(np.arange(int(at.max(initial=0)) + 1)).cast(pa.string())
    after, first = (pc.binary_join_element_wise(x, places_, ":", "") for x in (" ", ""))
    more = np.flatnonzero((n >= _LOW_N) | (t >= _LOW_T))
    small = pa.array([f"{i}:{j}" for i in range(_LOW_N) for j in range(_LOW_T)])
    great = pc.binary_join_element_wise(pa.array(n[more]).cast(pa.string()), pa.array(t[more]).cast(pa.string()), ":")
    words = np.empty((len(at), 2), np.int32)
    words[:, 0], words[:, 1] = at, 2 * len(places_) + n * _LOW_T + t
    words[ends[:-1][ends[:-1] < ends[1:]], 0] += len(places_)
    words[more, 1] = 2 * len(places_) + len(small) + np.arange(len(more))
    text = pa.concat_arrays([after, first, small, great]).take(pa.array(words.ravel()))
    to = np.frombuffer(text.buffers()[1], np.int32, 2 * len(at) + 1, 4 * text.offset)[2 * ends] if len(at) else np.zeros(len(ends), np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(to.astype(np.int32)), text.buffers()[2] or pa.py_buffer(b"")])


def annotated(reads: DataFrame, k: int, most: int, least: int, lines: bool) -> DataFrame:
    """Each k-mer's counters among the reads (id, kind, seq, counted) that are ``counted``, at most ``most``, at the places of
    all reads; places whose root occurs under ``least`` times are left out.

    (id, at, kmer, n, t), a row for each place, or with ``lines`` (id, seq, kmers), one for each read, its places as at:n:t.

    Two shuffles: of runs to their bins, where counters are looked up, and of these, a byte for most,
    back to their reads, which go along as compressed pieces.  A piece's runs are found once more there.
    """
    ship(reads.sparkSession)
    longest, not_counted = 63, 2
    schema = pa.schema([("dest", pa.int32()), ("piece", pa.int64()), ("heads", pa.binary()), ("bases", pa.binary())])
    rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    def cut(batches):
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            pa.default_memory_pool().release_unused()
            data, offsets = _strings(batch.column(2))
            kinds, counted = batch.column(1).fill_null(not_counted), batch.column(3).fill_null(False)
            kinds = kinds.to_numpy(zero_copy_only=False)
            kinds = np.where(counted.to_numpy(zero_copy_only=False).astype(bool) & ((kinds == 0) | (kinds == 1)), kinds, not_counted)
            for i, j in _pieces(offsets):
                here = pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in (0, 2)], ["id", "seq"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, here.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(here)
                yield rows([BINS + piece % BINS], [piece], [b""], [sink.getvalue().to_pybytes()])
                found = _runs(_CODE[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], kinds[i:j], k, longest)
                if found is not None:
                    yield rows(found.column(0), np.full(len(found), piece, np.int64), found.column(1), found.column(2))
                piece += 1

    def looked_up(bin_: int, held: list):
        """(dest, piece, -, values) of one bin's rows (piece, heads, bases), all of which are needed to count."""
        ends = np.cumsum([int((x[1] & longest).sum(dtype=np.int64)) for x in held])
        if ends[-1] <= WHOLE:
            heads, bases = (np.concatenate([x[c] for x in held]) for c in (1, 2))
            kmers, n = _kmers(heads, bases, k, longest)
            number, known, n, t = _looked_up(kmers, np.repeat(heads >> 6, n), k, most, least)
            small = (n < _LOW_N) & (t < _LOW_T)
            first = np.where(known, np.where(small, 1 + n * _LOW_T + t, _MORE), 0).astype(np.uint8)[number]
            more = np.flatnonzero(first == _MORE)
            counts = [c[number[more]].astype("<u2") for c in (n, t)]
            from_ = np.append(0, ends[:-1])
            x, y = (np.searchsorted(more, e) for e in (from_, ends))
            values = [first[a:b].tobytes() + counts[0][c:d].tobytes() + counts[1][c:d].tobytes() for a, b, c, d in zip(from_.tolist(), ends.tolist(), x.tolist(), y.tolist(), strict=True)]
            yield rows([bin_] * len(held), [x[0] for x in held], [b""] * len(held), values)
            return
        # A bin of very many k-mers is counted, and then looked up, in pieces.
        counters, start, size = _Bin(k), 0, 0
        for at in range(len(held) + 1):
            if at < len(held):
                size += len(held[at][1]) + len(held[at][2])
            if at > start and (at == len(held) or size >= RUN_BYTES):
                heads, bases = (np.concatenate([x[c] for x in held[start:at]]) for c in (1, 2))
                kmers, n = _kmers(heads, bases, k, longest)
                kinds = np.repeat(heads >> 6, n)
                counts = kinds != not_counted
                if counts.any():
                    counters.put(_pairs(kmers[counts], kinds[counts].astype(np.uint64), k))
                start, size = at, 0
        if not counters.parts:
            keys, of, known_roots = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        else:
            keys, of = counters.result()
            root = roots(keys, complement(keys, k), k)
            known_roots, nth = np.unique(root, return_inverse=True)
            known_roots = known_roots[np.bincount(nth, of.sum(axis=1)) >= least]
            of = np.minimum(of, most)
        start, size = 0, 0
        for at in range(len(held) + 1):
            if at < len(held):
                size += len(held[at][1]) + len(held[at][2])
            if at > start and (at == len(held) or size >= RUN_BYTES):
                some = held[start:at]
                kmers, _ = _kmers(np.concatenate([x[1] for x in some]), np.concatenate([x[2] for x in some]), k, longest)
                rcs = complement(kmers, k)
                n, t, known = np.zeros(len(kmers), np.int64), np.zeros(len(kmers), np.int64), np.zeros(len(kmers), bool)
                if len(known_roots):
                    root, key, side = roots(kmers, rcs, k), np.minimum(kmers, rcs), 2 * (kmers > rcs)
                    nth = np.minimum(np.searchsorted(known_roots, root), len(known_roots) - 1)
                    known = known_roots[nth] == root
                    nth = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    seen = known & (keys[nth] == key)
                    n, t = (np.where(seen, of[nth, side + c], 0) for c in (0, 1))
                ends = np.cumsum([int((x[1] & longest).sum(dtype=np.int64)) for x in some])
                values = [_values(known[a:b], n[a:b], t[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
                yield rows([bin_] * len(some), [x[0] for x in some], [b""] * len(some), values)
                start, size = at, 0

    def look(batches):
        now, held = None, []
        for batch in batches:
            pa.default_memory_pool().release_unused()
            dest, pieces = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            through = dest >= BINS
            if through.any():
                yield rows(pa.array(np.full(int(through.sum()), -1, np.int32)), *(c.filter(pa.array(through)) for c in batch.columns[1:]))
            heads, bases = (_strings(batch.column(c)) for c in (2, 3))
            for i in np.flatnonzero(~through):
                if dest[i] != now:
                    if held:
                        yield from looked_up(now, held)
                    now, held = int(dest[i]), []
                held.append((int(pieces[i]), *(d[o[i] : o[i + 1]].copy() for d, o in (heads, bases))))
        if held:
            yield from looked_up(now, held)

    def of_piece(stored: bytes, found: list):
        """The rows of one piece, from the values (bin, values) of its runs."""
        here = pa.ipc.open_stream(stored).read_all().combine_chunks()
        ids, seqs = (here.column(c).combine_chunks() for c in (0, 1))
        data, offsets = _strings(seqs)
        codes = _CODE[data]
        at = places(codes, offsets, k)
        n, t, known = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32), np.zeros(len(at), bool)
        if len(at):
            bin_, first, size = _stretches(codes, at, k, longest)
            of = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())  # k-mers in order of bins
            ends = np.append(0, np.cumsum(size))[np.searchsorted(bin_.astype(np.int64), np.arange(BINS + 1))]
            for x, values in found:
                a, b = ends[x], ends[x + 1]
                known[of[a:b]], n[of[a:b]], t[of[a:b]] = _of_values(values, b - a)
        at, n, t = at[known], n[known], t[known]
        read = np.searchsorted(offsets, at, "right") - 1
        if not lines:
            kmers = codes_at(codes, at, k) if len(at) else np.zeros(0, np.uint64)
            for s in range(0, len(at), OUT_ROWS):
                x = slice(s, s + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(read[x])), pa.array((at[x] - offsets[read[x]]).astype(np.int32)), texts(kmers[x], k), pa.array(n[x].astype(np.int64)), pa.array(t[x].astype(np.int64))], ["id", "at", "kmer", "n", "t"])
            return
        ends = np.append(0, np.cumsum(np.bincount(read, minlength=len(ids))))
        text = _lines(at - offsets[read], n, t, ends)
        for i in range(0, len(ids), 500):
            yield pa.RecordBatch.from_arrays([c.slice(i, 500) for c in (ids, seqs, text)], ["id", "seq", "kmers"])

    def back(batches):
        now, stored, found = None, None, []
        for batch in batches:
            pa.default_memory_pool().release_unused()
            dest, pieces = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = _strings(batch.column(3))
            for i in range(len(batch)):
                if pieces[i] != now:
                    if stored is not None:
                        yield from of_piece(stored, found)
                    now, stored, found = pieces[i], None, []
                x = data[offsets[i] : offsets[i + 1]].copy()
                if dest[i] < 0:
                    stored = x.tobytes()
                else:
                    found.append((int(dest[i]), x))
        if stored is not None:
            yield from of_piece(stored, found)

    shape = "dest int, piece long, heads binary, bases binary"
    of = reads.select("id", "kind", "seq", "counted").mapInArrow(cut, shape).repartition("dest").sortWithinPartitions("dest").mapInArrow(look, shape)
    return of.repartition("piece").sortWithinPartitions("piece").mapInArrow(back, "id string, seq string, kmers string" if lines else "id string, at int, kmer string, n long, t long")
