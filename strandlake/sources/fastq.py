"""FASTQ as a Spark data source: ``spark.read.format("fastq").load("a.fq.gz b.fq")``.

Plain files are cut into ranges of ``split_bytes`` (64 MB) that start at the first
record behind their first byte; gzip files, several members or not, are read whole, one
task to a file.  Records may span lines, and may lack qualities (then ``qual`` is null).
In a file that is cut, every record has four lines; ``split_bytes`` 0 cuts none.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.kmers import both_kinds
from ..session import ship
from . import files

SCHEMA = "id string, seq string, qual string"
SPLIT_BYTES = 64 << 20


def records(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str | None]]:
    """(id, seq, qual) from lines without their ends."""
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (b"@", b">"):
            line = next(lines, None)
            continue
        name = (line[1:].split(None, 1) or [b""])[0].decode()
        parts: list[bytes] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (b"@", b">", b"+"):
            parts.append(line)
            line = next(lines, None)
        seq = b"".join(parts)
        qual: bytes | None = None
        if line is not None and line[:1] == b"+":
            qual = b""
            line = next(lines, None)
            while line is not None and len(qual) < len(seq):
                qual += line
                line = next(lines, None)
        yield name, seq.decode(), None if qual is None else qual.decode()


def _lines(f: io.BufferedIOBase) -> Iterator[bytes]:
    for line in f:
        yield line.rstrip(b"\r\n")


def _resync(f: io.BufferedIOBase) -> tuple[int, list[bytes]]:
    """The place of the first four-line record at or behind the next line, and its first lines."""
    window: list[tuple[int, bytes]] = []
    at = f.tell()
    while True:
        line = f.readline()
        if not line:
            return at, []
        window.append((at, line))
        at += len(line)
        window = window[-4:]
        # "@" may also begin a quality line, but then the line two ahead is no "+" line of its own record.
        if len(window) == 4 and window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and len(window[1][1].rstrip()) == len(window[3][1].rstrip()):
            return window[0][0], [x for _, x in window]


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def read_range(part: Range) -> Iterator[tuple[str, str, str | None]]:
    raw = files.opened(part.path)
    with raw:
        if part.end < 0:
            head = raw.read(2)
            raw.seek(0)
            f = gzip.open(raw) if head == b"\x1f\x8b" else io.BufferedReader(raw) if not isinstance(raw, io.BufferedReader) else raw
            yield from records(_lines(f))
            return
        raw.seek(max(0, part.begin - 1))
        if part.begin:
            raw.readline()  # to the end of the line that the byte before belongs to
        at, _ = _resync(raw)
        raw.seek(at)
        while at < part.end:
            four = [raw.readline() for _ in range(4)]
            if not four[0]:
                return
            at += sum(map(len, four))
            name = (four[0][1:].split(None, 1) or [b""])[0]
            yield name.decode(), four[1].rstrip(b"\r\n").decode(), four[3].rstrip(b"\r\n").decode()


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = files.expand(options.get("path", ""))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            size = files.size_of(path)
            with files.opened(path) as f:
                packed = f.read(2) == b"\x1f\x8b"
            if packed or not self.split or size <= self.split:
                out.append(Range(path, 0, -1))
            else:
                out += [Range(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator:
        yield from files.batches(read_range(partition))


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def fastq(spark: SparkSession, paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    ship(spark)
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("split_bytes", str(split_bytes)).load(paths)


def reads(spark: SparkSession, normal: str, tumor: str, input_format: str = "fastq", **options) -> DataFrame:
    """(id, seq, qual, kind) of both inputs."""
    from .bam import bam

    one = {"fastq": fastq, "bam": bam}[input_format]
    return both_kinds(one(spark, normal, **options), one(spark, tumor, **options))
