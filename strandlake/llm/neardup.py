"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

Two texts are linked if the weighted Jaccard similarity of their 5-word shingles
(A-Z lower-cased; a text of one to four words is one shingle) is at least ``least``.
Classes are the connected components of the links.

Weights.  ``tf x (1 + 0.25 idf)``, with idf from 0 to 1 by the logarithm of the share
of documents that have a shingle's bucket, of 2^18 (shares under 2^-9 count as 2^-9).
The table has a fixed size and its entries are shares, so it is shipped whole and
means the same at every size of the corpus.

Candidates.  Improved consistent weighted sampling draws ``BANDS x ROWS`` samples a
text; texts that agree in all rows of a band meet in a bucket.  With 20 bands of 4 a
pair at 0.8 is missed with probability 3e-5, at 0.9 less than 1e-9.  (Per sample the
three random numbers of a shingle come from a table by its hash, and weights up to
``exp(_LEVELS x _STEP)``, about 100, are rounded to steps of 15 % for the draws; greater
ones are drawn by as they are.  Only the candidates depend on that.)

Verification.  Every bucket has a hub, the member that meets most others in all its
buckets; all members of other classes are compared with it by their whole shingle sets,
and the classes are joined along the links.  The hub then leaves its bucket, and buckets
whose remaining members are of one class are done.  After ``TURNS`` such rounds, what is
still open is compared completely (``rest_links``): in blocks of bounded size, each node
outside a cloud's largest class with all nodes of the cloud.  So no two members of a
bucket that end in different classes stay uncompared: no link between classes is lost,
nothing is capped, and no pairs are made of a class's own members.

Scale.  Texts with equal shingles are one node from the start.  Buckets and hubs come
from sums and maxima on the map side; large buckets meet their hub in joins that Spark
splits.  Shingle sets are made again only for nodes in a bucket with others.  Every
round's tables are written to the shared folder.

Edge cases.  Null and empty texts are classes of their own.  Other texts without words
are in a class with their equals only.  Rows with a null id have classes too, whose id
is the least id in them, null if there is none.  Repeated rows are each reported.  Extra columns are
ignored (``classes``) or kept (``without_near_duplicates``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, carried, fmix, grams, map_texts, slices, small_batches, stage, text_buffer, words_of

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 20, 4
BUCKET_BITS, FLOOR, IDF = 18, 2.0**-9, 0.25
SHIP_BYTES, TURNS = 32 << 20, 2
_DRAW_BITS, _LEVELS, _STEP = 11, 32, 0.15


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each text, repeats included, and n + 1 offsets."""
    h, _, _, at = words_of(raw, offsets)
    g, gat = grams(h, at, k)
    n = np.diff(at)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = n[short] > j
            own[has] = own[has] * U64(0xD6E8FEB86659FD93) + h[at[short[has]] + j]
        g = np.insert(g, gat[short], fmix(own ^ n[short].astype(U64)))
        gat = gat + np.concatenate([[0], np.cumsum((n > 0) & (n < k))])
    for a, z in zip(gat[:-1].tolist(), gat[1:].tolist()):
        g[a:z].sort()
    return g, gat


def counted(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often each occurs, and n + 1 offsets."""
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[at[:-1][at[:-1] < len(g)]] = True
    first = np.flatnonzero(new)
    return g[first], np.diff(np.append(first, len(g))), np.searchsorted(first, at)


def bucket(g: np.ndarray) -> np.ndarray:
    return (g >> U64(64 - BUCKET_BITS)).astype(np.int64)


def shares(documents: DataFrame) -> np.ndarray:
    """Weight of each bucket's shingles, from all documents.

    Each task adds up its own counts in a table of fixed size; those are summed by bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            raw, offsets = text_buffer(batch["text"])
            for i, j in slices(offsets):
                g, at = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seen += np.bincount(bucket(counted(g, at)[0]), minlength=len(seen))
                n += int((np.diff(at) > 0).sum())
        some = np.flatnonzero(seen)
        for a in range(0, len(some), 1 << 16):
            part = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seen[part], pa.int64())], ["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], ["bucket", "n"])

    total = documents.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(total["bucket"], total["n"]))
    documents_n = max(1, n.pop(-1, 0))
    share = np.full(1 << BUCKET_BITS, FLOOR)
    share[list(n.keys())] = np.clip(np.array(list(n.values()), float) / documents_n, FLOOR, 1.0)
    return (1 + IDF * np.log(share) / np.log(FLOOR)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with tabled random numbers."""

    def __init__(self, weight: np.ndarray, samples: int = BANDS * ROWS, seed: int = 1):
        self.weight, self.samples, self.seed = weight, samples, seed
        self.tables: np.ndarray | None = None

    def __reduce__(self):
        return Sampler, (self.weight, self.samples, self.seed)

    def prepare(self) -> None:
        rng = np.random.default_rng(self.seed)
        size = self.samples, 1, 1 << _DRAW_BITS
        r, c, beta = rng.gamma(2, 1, size), rng.gamma(2, 1, size), rng.random(size)
        log_s = np.arange(_LEVELS)[None, :, None] * _STEP
        self.tables = self.ranks(log_s, r, np.log(c), beta).reshape(self.samples, -1)
        self.random = [x[:, 0] for x in (r, np.log(c), beta)]
        self.odd = rng.integers(1, 2**63, self.samples, dtype=np.int64).astype(U64) * U64(2) + U64(1)

    @staticmethod
    def ranks(log_s: np.ndarray, r: np.ndarray, log_c: np.ndarray, beta: np.ndarray) -> np.ndarray:
        t = np.floor(log_s / r + beta)
        log_a = log_c - r * (t - beta) - r
        # As order-preserving 20-bit numbers in the upper bits; the hash's bits stand below.
        return np.clip((log_a + 40.0) * (2**20 / 80.0), 0, 2**20 - 1).astype(U64) << U64(44)

    def draw(self, g: np.ndarray, tf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Samples of each text that has shingles, one row each."""
        if self.tables is None:
            self.prepare()
        some = np.flatnonzero(np.diff(at))
        out = np.zeros((len(some), self.samples), U64)
        log_s = np.log(tf) + np.log(self.weight[bucket(g)])
        level = np.rint(log_s / _STEP).astype(np.int64)
        beyond = np.flatnonzero(level >= _LEVELS)  # few: each stands for a hundred shingles
        level = np.clip(level, 0, _LEVELS - 1) << _DRAW_BITS
        starts = at[some]
        for a in range(0, len(some), 128):  # blocks that stay in the cache
            z = min(a + 128, len(some))
            lo, hi = int(starts[a]), int(starts[z]) if z < len(some) else len(g)
            block, offset, begin = g[lo:hi], level[lo:hi], starts[a:z] - lo
            far = beyond[slice(*np.searchsorted(beyond, (lo, hi)))] - lo
            far_s = log_s[far + lo]
            for k in range(self.samples):
                m = block * self.odd[k]
                i = (m >> U64(64 - _DRAW_BITS)).astype(np.int64)
                i += offset
                key = self.tables[k].take(i)
                if len(far):
                    key[far] = self.ranks(far_s, *(x[k].take(i[far] & ((1 << _DRAW_BITS) - 1)) for x in self.random))
                key |= m & U64((1 << 44) - 1)
                out[a:z, k] = np.minimum.reduceat(key, begin)
        return out


def bands(samples: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band, different in each."""
    out = np.zeros((len(samples), count), U64)
    for b in range(count):
        h = np.full(len(samples), b + 1, U64)
        for r in range(rows):
            h = fmix(h * U64(0xD6E8FEB86659FD93) + samples[:, b * rows + r])
        out[:, b] = h
    return out


def similarity(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists with repeats."""
    x, n, _ = counted(a, np.array([0, len(a)]))
    y, m, _ = counted(b, np.array([0, len(b)]))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    wx = weight[bucket(x)].astype(np.float64)
    wy = weight[bucket(y)].astype(np.float64)
    both = float((np.minimum(n[i], m[j]) * wx[i]).sum())
    every = float((n * wx).sum() + (m * wy).sum()) - both
    return both / every if every else 0.0


_KEYS = [f"b{i}" for i in range(BANDS)]


def signatures(documents: DataFrame, sampler) -> DataFrame:
    """(doc_id, text_hash, node, b0 .. ): a text's node and band keys; no keys without words, no node without text."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        raw, offsets = text_buffer(batch["text"])
        data, nodes, none = raw.tobytes(), [], np.ones(len(offsets) - 1, bool)
        keys = np.zeros((len(offsets) - 1, BANDS), U64)
        for i, j in slices(offsets, 1 << 20):
            g, at = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            some = np.flatnonzero(np.diff(at))
            keys[i + some] = bands(sampler.value.draw(*counted(g, at)))
            for d in range(j - i):
                if at[d + 1] > at[d]:
                    nodes.append(hashlib.md5(g[at[d] : at[d + 1]].tobytes()).digest())
                else:
                    text = data[offsets[i + d] : offsets[i + d + 1]]
                    nodes.append(hashlib.md5(b"text" + text).digest() if text else None)
            none[i + some] = False
        columns = [pa.array(keys[:, b].view(np.int64), pa.int64(), mask=none) for b in range(BANDS)]
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), batch["text_hash"], pa.array(nodes, pa.binary()), *columns], ["doc_id", "text_hash", "node", *_KEYS])

    return map_texts(documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), work, "doc_id long, text_hash long, node binary, " + ", ".join(f"{b} long" for b in _KEYS))


def meetings(signed: DataFrame) -> DataFrame:
    """(band, node, degree): members of buckets with at least two nodes.

    The degree is the number of members of all the node's buckets.
    """
    nodes = signed.filter(F.col(_KEYS[0]).isNotNull()).groupBy("node").agg(*[F.first(b).alias(b) for b in _KEYS])
    member = nodes.select("node", F.explode(F.array(*_KEYS)).alias("band"))
    sizes = member.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    found = stage(member.join(sizes, "band"), "meetings")
    degree = found.groupBy("node").agg(F.sum("size").alias("degree"))
    return found.select("band", "node").join(degree, "node").select("band", "node", "degree")


def shipped(table: DataFrame, rows: int, width: int) -> DataFrame:
    """Broadcast if ``rows`` of ``width`` bytes stay under the bound, else as it is."""
    return F.broadcast(table) if rows * width <= SHIP_BYTES else table


def joined_classes(labels: DataFrame, count: int, links: DataFrame) -> DataFrame:
    """(node, label) after joining the classes that links connect; the least label stays.

    Links are first turned into links of labels; then every label takes the least of its
    neighbours' and follows it once more, until nothing changes.
    """
    small = shipped(labels, count, 64)
    pairs = links.join(small.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(small.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    pairs = pairs.select("x", "y").filter("x <> y")
    edges = stage(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "class-links")
    n = edges.count()
    best = stage(edges.groupBy("x").agg(F.least("x", F.min("y")).alias("to")), "class-least")
    while True:
        near = edges.join(shipped(best.select(F.col("x").alias("y"), F.col("to").alias("t")), n, 64), "y").groupBy("x").agg(F.min("t").alias("t"))
        step = shipped(best, n, 64).join(near, "x").select("x", "to", F.least("to", "t").alias("t"))
        jump = shipped(best.select(F.col("x").alias("t"), F.col("to").alias("u")), n, 64)
        after = stage(step.join(jump, "t", "left").select("x", "to", F.least("t", F.coalesce("u", "t")).alias("t")), "class-step")
        changed = not after.filter("t <> to").isEmpty()
        best = after.select("x", F.col("t").alias("to"))
        if not changed:
            break
    moved = shipped(best.select(F.col("x").alias("label"), "to"), n, 64)
    return stage(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "classes")


def node_sets(documents: DataFrame, signed: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(node, list): the sorted shingles of the given nodes, from one document each."""
    wanted = shipped(nodes, count, 48)
    chosen = signed.select("doc_id", "node").filter("doc_id is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = stage(chosen, "chosen")
    docs = documents.select("doc_id", "text")
    known = docs.join(shipped(chosen.select("doc_id"), count, 24), "doc_id", "left_semi")
    if not nodes.join(shipped(chosen, count, 48), "node", "left_anti").isEmpty():  # some have no row with an id
        known = known.unionByName(docs.filter("doc_id is null"))

    def work(batch: pa.RecordBatch) -> pa.Table:
        raw, offsets = text_buffer(batch["text"])
        keys, lists = [], []
        for i, j in slices(offsets):
            g, at = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for a, z in zip(at[:-1], at[1:]):
                lists.append(g[a:z].tobytes())
                keys.append(hashlib.md5(lists[-1]).digest())
        return pa.Table.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, pa.binary())], ["node", "list"])

    made = map_texts(known.select("text"), work, "node binary, list binary").filter(F.octet_length("list") > 0)
    # Ids that repeat can bring a text twice, or texts that nobody asked for.
    return stage(made.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("list").alias("list")), "sets")


def links_of(pairs: DataFrame, count: int, sets: DataFrame, weight, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``least``."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        ok = [similarity(np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64), weight.value) >= least for p, q in zip(batch["p"], batch["q"])]
        return pa.Table.from_batches([batch]).filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    if count * 64 <= SHIP_BYTES:
        # Sets find their pairs where they lie, and move once.
        both = F.broadcast(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")))
        met = sets.join(both, "node").groupBy("a", "b").agg(F.first("list").alias("p"), F.last("list").alias("q"))
    else:
        one, two = (sets.select(F.col("node").alias(x), F.col("list").alias(y)) for x, y in (("a", "p"), ("b", "q")))
        met = pairs.join(one, "a").join(two, "b")
    return map_texts(met.select("a", "b", "p", "q"), work, "a binary, b binary")


def links_within(labels: list[bytes], lists: list[np.ndarray], weight: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between rows of different labels, as few as join the same labels.

    All rows are compared at once: overlaps are sums over shared shingles, by a matrix
    product for the frequent ones and by their few pairs for the rare ones.  Pairs near
    the threshold are decided by ``similarity``.
    """
    n = len(lists)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    g = np.concatenate(lists)
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    begin = np.ones(len(g), bool)
    begin[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(begin)
    nth = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    w = weight[bucket(g)].astype(np.float64)
    total = np.add.reduceat(w, at[:-1])
    # A shingle's second occurrence only meets second occurrences, and so on.
    token, shared_by = np.unique(np.where(nth > 0, fmix(g + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), g), return_inverse=True)
    order = np.argsort(shared_by, kind="stable")
    row, w, f = row[order], w[order], np.bincount(shared_by, minlength=len(token))
    start = np.concatenate([[0], np.cumsum(f)])
    overlap = np.zeros((n, n), np.float32)
    many = np.flatnonzero(f > 16)
    for a in range(0, len(many), 1024):
        part = many[a : a + 1024]
        dense = np.zeros((n, len(part)), np.float32)
        for c, t in enumerate(part.tolist()):
            dense[row[start[t] : start[t + 1]], c] = np.sqrt(w[start[t]])
        overlap += dense @ dense.T
    flat = overlap.reshape(-1)
    for k in range(2, 17):
        some = np.flatnonzero(f == k)
        for a in range(0, len(some), 1 << 14):
            part = start[some[a : a + (1 << 14)]]
            for i in range(k):
                for j in range(i + 1, k):
                    np.add.at(flat, row[part + i] * n + row[part + j], w[part].astype(np.float32))
    overlap = np.maximum(overlap, overlap.T)
    _, label = np.unique(np.array(labels, dtype=object), return_inverse=True)
    leader = list(range(int(label.max()) + 1)) if n else []

    def find(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    out = []
    for i in range(n):
        both = overlap[i, i + 1 :]
        sim = both / (total[i] + total[i + 1 :] - both)
        for j in (np.flatnonzero((sim >= least - 1e-3) & (label[i + 1 :] != label[i])) + i + 1).tolist():
            x, y = find(int(label[i])), find(int(label[j]))
            if x != y and (sim[j - i - 1] >= least + 1e-3 or similarity(lists[i], lists[j], weight) >= least):
                leader[x] = y
                out.append((i, j))
    return out


BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20


def rest_links(members: DataFrame, sets: DataFrame, weight, least: float) -> DataFrame:
    """Links between the classes of members that no hub has joined: all that there are.

    Buckets that have members in common make a cloud.  A cloud's nodes outside its
    largest class are compared with all of the cloud, in pairs of blocks of bounded size
    that are spread over the cluster; pairs are compared but not made.
    """
    nodes = stage(members.select("node", "label").distinct(), "open-nodes")
    count = nodes.count()
    # Buckets of one cloud mostly have the same member of highest degree, so few ties differ.
    centre = members.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top")).select("band", F.col("top.node").alias("b"))
    ties = stage(members.select("band", F.col("node").alias("a")).join(centre, "band").filter("a <> b").select("a", "b").distinct(), "cloud-links")
    cloud = joined_classes(nodes.select("node", F.col("node").alias("label")), count, ties).withColumnRenamed("label", "cloud")
    known = nodes.join(shipped(cloud, count, 64), "node")
    rows = stage(sets.join(shipped(known, count, 96), "node"), "open-sets")
    of_label = rows.groupBy("cloud", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("list")).alias("size"))
    most = of_label.groupBy("cloud").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    plan = most.filter("n > top.n").select(
        "cloud", F.col("top.label").alias("main"), blocks(F.col("top.n"), F.col("top.size")).alias("nm"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("nu")
    )
    plan = stage(plan, "cloud-plan")
    rows = rows.join(shipped(plan, plan.count(), 64), "cloud")
    main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(main, F.col("nm")).otherwise(F.col("nu"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    key = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    met_by_main = F.transform(upto(F.col("nu")), lambda k: key("m", k, F.col("own")))
    met_by_other = F.concat(F.transform(upto(F.col("nm")), lambda t: key("m", F.col("own"), t)), F.transform(upto(F.col("nu")), lambda k: key("u", F.least(k, F.col("own")), F.greatest(k, F.col("own")))))
    rows = rows.withColumn("own", own).withColumn("_meets", F.when(main, met_by_main).otherwise(met_by_other))
    spread = rows.select("node", "label", "list", "cloud", F.explode("_meets").alias("meet")).select("node", "label", "list", "cloud", "meet.kind", "meet.x", "meet.y")

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        nodes = group["node"].to_pylist()
        lists = [np.frombuffer(x, U64) for x in group["list"].to_pylist()]
        found = links_within(group["label"].to_pylist(), lists, weight.value, least)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return spread.groupBy("cloud", "kind", "x", "y").applyInArrow(work, "a binary, b binary")


def still_open(members: DataFrame) -> DataFrame:
    """Members of buckets with more than one class."""
    hashed = F.xxhash64("label")
    mixed = stage(members.groupBy("band").agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi")).filter("lo < hi").select("band"), "open")
    return stage(members.join(shipped(mixed, mixed.count(), 24), "band", "left_semi"), "members")


def classes(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id, class_size, node, label, text_hash): class_id is the least id of the
    class, label its name whatever the ids, text_hash tells apart the texts of an id."""
    spark = documents.sparkSession
    small_batches(spark)
    weight = shares(documents)
    sampler, table = spark.sparkContext.broadcast(Sampler(weight)), spark.sparkContext.broadcast(weight)
    signed = stage(signatures(documents, sampler), "signatures")
    members = stage(meetings(signed).withColumn("label", F.col("node")), "members")
    labels = stage(members.select("node", "label").distinct(), "labels")
    count = labels.count()
    sets = node_sets(documents, signed, labels.select("node"), count)
    for _ in range(TURNS):
        if members.isEmpty():
            break
        hubs = stage(members.groupBy("band").agg(F.max(F.struct("degree", "node", "label")).alias("hub")), "hubs")
        near = shipped(hubs, hubs.count(), 96)
        met = members.join(near, "band").filter("label <> hub.label").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        pairs = stage(met.distinct(), "pairs")
        links = stage(links_of(pairs, pairs.count(), sets, table, least), "links")
        if not links.isEmpty():
            labels = joined_classes(labels, count, links)
        left = members.join(near.select("band", F.col("hub.node").alias("node")), ["band", "node"], "left_anti").drop("label")
        members = still_open(left.join(shipped(labels, count, 64), "node").select("band", "node", "degree", "label"))
    if not members.isEmpty():
        links = stage(rest_links(members, sets, table, least), "links")
        if not links.isEmpty():
            labels = joined_classes(labels, count, links)
    labelled = signed.select("doc_id", "text_hash", "node").join(shipped(labels, count, 64), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled, "labelled")
    ids = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    ids = stage(ids.filter("class_size > 1"), "class-ids")
    out = labelled.join(shipped(ids, ids.count(), 48), "label", "left")
    alone = F.col("class_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "node", "label", "text_hash")


def without_near_duplicates(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class, all columns: the one of least id.

    Rows without an id stay.  Where an id has several texts, each is judged by its own class;
    of rows that repeat both id and text, and have a class with others, one stays.
    """
    found = classes(documents.select("doc_id", "text"), least).filter("class_size > 1 and doc_id is not null")
    found = stage(found.select("label", "doc_id", "text_hash"), "copies")
    row = F.struct("doc_id", "text_hash")
    first = stage(found.groupBy("label").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    met = found.join(shipped(first, first.count(), 64), "label")
    gone = stage(met.filter(row != F.col("first")).select("doc_id", "text_hash").distinct(), "gone")
    again = stage(met.filter(row == F.col("first")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash"), "again")
    key = ["doc_id", "text_hash"]
    inner, _, back = carried(documents, "doc_id", "text")
    kept = inner.withColumn("text_hash", F.xxhash64("text")).join(shipped(gone, gone.count(), 32), key, "left_anti")
    if again.isEmpty():
        return back(kept)
    again = shipped(again, again.count(), 32)
    repeated = kept.join(again, key, "left_semi").dropDuplicates(key)
    return back(kept.join(again, key, "left_anti").unionByName(repeated))
