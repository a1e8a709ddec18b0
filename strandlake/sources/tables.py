"""Reading and writing what stages leave for each other and for other programs.

Parquet is the canonical form; the text forms are for programs that expect them.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.sequence import SATURATED
from ..operators import count, runs
from ..operators.filter import Indexes
from ..operators.kmers import PACKED

SETS, VALID = ("nn", "tn", "tm"), {"seq": ("nn", "tn", "tm"), "k2i": ("nn", "tn"), "i2p": ("tm",)}


def dump(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dump_indexes(ix: Indexes, path: str) -> None:
    dump(ix.seq, f"{path}/seq", "set")
    dump(ix.k2i, f"{path}/k2i", "set")
    dump(ix.i2p, f"{path}/i2p")


def restore_indexes(spark: SparkSession, path: str) -> Indexes:
    of = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Indexes(of("seq", "id string, seq string, set string"), of("k2i", "kmer string, id string, set string"), of("i2p", "id string, dir string, pos int"))


def write_counts_csv(rows: DataFrame, path: str) -> None:
    """kmer,n,t without a header."""
    rows.select("kmer", "n", "t").write.mode("overwrite").csv(path, header=False)


def annotation(reads: DataFrame, annotated: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """(id, seq, kmers): the map of places to [n, t] of each read.

    ``annotated`` gives (keep, at, n, t) of reads' places.  Reads that share an id, as mates
    may, are told apart by their sequence; equal reads get equal maps.
    """
    keyed = reads.withColumn("_read", F.xxhash64("seq"))
    entry = F.struct(F.col("at").cast("string"), F.array("n", "t"))
    found = annotated(keyed.dropDuplicates(["id", "_read"]), ("id", "_read")).groupBy("id", "_read").agg(F.map_from_entries(F.collect_list(entry)).alias("kmers"))
    out = keyed.join(found, ["id", "_read"], "left")
    return out.select("id", "seq", F.coalesce("kmers", F.create_map().cast("map<string,array<bigint>>")).alias("kmers"))


def annotation_text(reads: DataFrame, cfg: Config) -> DataFrame:
    """(id, seq, kmers): the same of reads (id, kind, seq, counted), as text in order of places, ``at:n:t at:n:t ..``."""
    if cfg.k <= PACKED:
        return runs.annotated(reads, cfg.k, SATURATED, count.known_from(cfg), lines=True)
    table = count.root_table(reads.filter("counted"), cfg)
    rows = annotation(reads, lambda df, keep: count.annotated(df, table, cfg, keep))
    entry = F.transform(F.map_entries("kmers"), lambda e: F.struct(e.key.cast("int").alias("at"), e.value.alias("v")))
    text = F.transform(F.array_sort(entry), lambda e: F.concat_ws(":", e["at"].cast("string"), e["v"].cast("array<string>")))
    return rows.select("id", "seq", F.concat_ws(" ", text).alias("kmers"))


def write_annotation(rows: DataFrame, path: str) -> None:
    """JSON lines: {"id": .., "seq": .., "kmers": {"place": [n, t]}}."""
    rows.write.mode("overwrite").json(path)


def plain_lines(ix: Indexes, most: int) -> dict[str, DataFrame]:
    """(line) of the space-separated forms: ``id seq``, ``kmer n id ..``, ``id a0 a1 b0 b1``."""
    out = {}
    for s in SETS:
        out[f"seq-{s}"] = ix.seq.filter(F.col("set") == s).select(F.concat_ws(" ", "id", "seq").alias("line"))
    for s in VALID["k2i"]:
        lists = ix.k2i.filter(F.col("set") == s).groupBy("kmer").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") <= most)
        out[f"k2i-{s}"] = lists.select(F.concat_ws(" ", "kmer", F.size("ids").cast("string"), F.concat_ws(" ", "ids")).alias("line"))
    word = lambda d, w: F.coalesce(F.bit_or(F.when((F.col("dir") == d) & (F.floor(F.col("pos") / 64) == w), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int")))), F.lit(0))
    unsigned = lambda c: F.expr(f"cast(case when {c} < 0 then cast({c} as decimal(20, 0)) + 18446744073709551616 else {c} end as string)")
    words = ix.i2p.groupBy("id").agg(*[word(d, w).alias(f"{d}{w}") for d in "ab" for w in (0, 1)])
    out["i2p-tm"] = words.select(F.concat_ws(" ", "id", *[unsigned(f"{d}{w}") for d in "ab" for w in (0, 1)]).alias("line"))
    return out


def write_plain(ix: Indexes, path: str, most: int, pid: int = 0) -> None:
    for name, lines in plain_lines(ix, most).items():
        lines.write.mode("overwrite").text(f"{path}/index-{name}.{pid}.txt")


def read_plain(spark: SparkSession, path: str) -> Indexes:
    """The text forms of all partitions that are there."""

    def parts(kind: str, s: str) -> DataFrame:
        lines = spark.read.text(f"{path}/index-{kind}-{s}.*.txt")
        return lines.select(F.split(F.trim("value"), " +").alias("p"), F.lit(s).alias("set"))

    from ..functions.sequence import positions_of

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    seq = union([parts("seq", s).select("set", F.col("p")[0].alias("id"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("seq")) for s in VALID["seq"]])
    k2i = union([parts("k2i", s).select("set", F.col("p")[0].alias("kmer"), F.explode(F.expr("slice(p, 3, greatest(size(p) - 2, 0))")).alias("id")) for s in VALID["k2i"]])
    signed = lambda i: F.expr(f"cast(case when cast(p[{i}] as decimal(20, 0)) > 9223372036854775807 then cast(p[{i}] as decimal(20, 0)) - 18446744073709551616 else cast(p[{i}] as decimal(20, 0)) end as bigint)")
    rows = parts("i2p", "tm")
    sides = [rows.select(F.col("p")[0].alias("id"), F.lit(d).alias("dir"), F.explode(positions_of(F.array(signed(i), signed(i + 1)))).alias("pos")).withColumn("pos", F.col("pos").cast("int")) for d, i in (("a", 1), ("b", 3))]
    return Indexes(seq, k2i, union(sides))


def write_fastq(records: DataFrame, path: str) -> None:
    records.select("record").write.mode("overwrite").text(path)


def write_groups_json(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").json(path)


def write_sets(sets: DataFrame, path: str) -> None:
    """``lead n id ..``"""
    sets.select(F.concat_ws(" ", "lead", F.col("n").cast("string"), F.concat_ws(" ", "ids")).alias("line")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- msgpack of groups


def packed(x) -> bytes:
    """The few msgpack forms that a group needs: strings, whole numbers, arrays, maps."""
    if isinstance(x, str):
        raw = x.encode()
        n = len(raw)
        head = bytes([0xA0 | n]) if n < 32 else struct.pack(">BB", 0xD9, n) if n < 256 else struct.pack(">BH", 0xDA, n) if n < 65536 else struct.pack(">BI", 0xDB, n)
        return head + raw
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        return struct.pack(">BB", 0xCC, x) if 0 <= x < 256 else struct.pack(">BH", 0xCD, x) if 0 <= x < 65536 else struct.pack(">BI", 0xCE, x) if 0 <= x < 1 << 32 else struct.pack(">Bq", 0xD3, x)
    n = len(x)
    small, middle = (0x80, 0xDE) if isinstance(x, dict) else (0x90, 0xDC)
    head = bytes([small | n]) if n < 16 else struct.pack(">BH", middle, n) if n < 65536 else struct.pack(">BI", middle + 1, n)
    body = io.BytesIO()
    for item in x.items() if isinstance(x, dict) else x:
        for part in item if isinstance(x, dict) else (item,):
            body.write(packed(part))
    return head + body.getvalue()


def packed_groups(groups: DataFrame) -> DataFrame:
    """(lead, packed): [[id, seq], [positions a, b], [kmers a, b], [reads n, t]] of each group."""
    import pyarrow as pa

    from ..session import ship

    ship(groups.sparkSession)

    def kmers(rows) -> list:
        return [[r["kmer"], r["kept_n"], r["kept_t"], r["dropped_n"], r["dropped_t"]] for r in rows]

    def pack(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [
                packed([[r["lead"]["id"], r["lead"]["seq"]], [r["pos_a"], r["pos_b"]], [kmers(r["kmers_a"]), kmers(r["kmers_b"])], [[[x["id"], x["seq"]] for x in r[c]] for c in ("reads_n", "reads_t")]])
                for r in rows
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r["lead"]["id"] for r in rows], pa.string()), pa.array(out, pa.binary())], ["lead", "packed"])

    return groups.mapInArrow(pack, "lead string, packed binary")
