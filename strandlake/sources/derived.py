"""Reads made from the synthetic ``documents`` table, for tests and benchmarks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread

#: Fixed values of the projection: letters and digits, the bases and the quality they become.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
BASES = "ACGTACGTACGTACGTACGTACGTACNNNNNNNNNN"
QUALITY = "IIIIIIIII!!IIIII!IIIIII!I!##########"
#: Bytes of a chunk, rows of a batch, documents that are made Python objects at once.
CHUNK, ROWS, DOCUMENTS = 100, 5_000, 200


def _tables(bases: str) -> tuple[bytes, bytes]:
    """Tables of bytes that make bases and qualities of letters of both cases and digits."""
    every = (SYMBOLS + SYMBOLS.upper()).encode()
    of = lambda row: bytes.maketrans(every, (row * 2).encode())
    return of(bases), of(QUALITY)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, seq, qual) in chunks of 100 characters; kind is the document id's parity."""
    docs = spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text"))
    turned = F.coalesce(F.expr("(doc_id div 2) % 2 = 1"), F.lit(False))
    docs = docs.filter("text is not null").select(F.expr("concat('d', doc_id, '.')").alias("name"), F.expr("cast(doc_id % 2 as int)").alias("kind"), turned.alias("turned"), F.col("text").cast("binary").alias("text"))
    ship(spark)
    other = bytes(set(range(256)) - set((SYMBOLS + SYMBOLS.upper()).encode()))
    tables = {False: _tables(BASES), True: _tables(BASES.translate(str.maketrans("ACGT", "TGCA")))}

    def chunks(batches):
        schema = pa.schema([("id", pa.string()), ("kind", pa.int32()), ("seq", pa.string()), ("qual", pa.string())])
        rows: list[list] = [[], [], [], []]
        for batch in batches:
            docs_ = (row for i in range(0, len(batch), DOCUMENTS) for row in zip(*(c.to_pylist() for c in batch.slice(i, DOCUMENTS).columns), strict=True))
            for name, kind, turn, text in docs_:
                text = text.translate(None, other)
                base, qual = (text.translate(t) for t in tables[turn])
                for j, at in enumerate(range(0, len(text), CHUNK)):
                    b, q = base[at : at + CHUNK], qual[at : at + CHUNK]
                    for column, x in zip(rows, (name and f"{name}{j}", kind, *((b[::-1], q[::-1]) if turn else (b, q))), strict=True):
                        column.append(x)
                    if len(rows[0]) >= ROWS:
                        yield _batch(rows, schema)
                        rows = [[], [], [], []]
        if rows[0]:
            yield _batch(rows, schema)

    return docs.mapInArrow(chunks, "id string, kind int, seq string, qual string")


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), text(rows[2]), text(rows[3])], schema=schema)
