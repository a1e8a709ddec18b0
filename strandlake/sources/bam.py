"""BAM as a Spark data source, decoded here: BGZF blocks, records, 4-bit bases.

Secondary and supplementary alignments are left out, reads of the reverse strand are
turned back, and mates get /1 or /2 behind their name.  With a linear index (.bai) a
file is cut at its offsets into ``splits`` tasks; without one it is read whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from . import files

SCHEMA = "id string, seq string, qual string"
#: Fixed values of the format.
_CODES = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _CODES for b in _CODES]
REVERSE, FIRST, SECOND, SECONDARY, SUPPLEMENTARY = 16, 64, 128, 256, 2048
_TURN = str.maketrans("ACGTMRWSYKVHDBN=", "TGCAKYWSRMBDHVN=")


class Blocks:
    """The unpacked stream of a BGZF file, from a virtual offset on."""

    def __init__(self, f, voffset: int = 0):
        self.f, self.data, self.at = f, b"", 0
        self.begin = self.next = voffset >> 16
        if voffset:
            self._load()
            self.at = voffset & 0xFFFF

    def _load(self) -> bool:
        self.begin = self.next
        self.f.seek(self.begin)
        head = self.f.read(12)
        if len(head) < 12:
            self.data, self.at = b"", 0
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF file")
        extra = self.f.read(struct.unpack("<H", head[10:12])[0])
        at, size = 0, 0
        while at < len(extra):
            a, b, n = struct.unpack("<BBH", extra[at : at + 4])
            if (a, b) == (66, 67):
                size = struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
            at += 4 + n
        body = self.f.read(size - 12 - len(extra))
        self.data, self.at, self.next = zlib.decompress(body[:-8], -15), 0, self.begin + size
        return True

    def tell(self) -> int:
        """Virtual offset of the next byte."""
        if self.at >= len(self.data):
            return self.next << 16
        return self.begin << 16 | self.at

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.at >= len(self.data):
                if not self._load():
                    break
                continue
            part = self.data[self.at : self.at + n]
            out.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(out)


def skip_header(blocks: Blocks) -> None:
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        blocks.read(struct.unpack("<i", blocks.read(4))[0] + 4)


def restored(name: str, flag: int, seq: str, qual: str) -> tuple[str, str, str]:
    if flag & REVERSE:
        seq, qual = seq.translate(_TURN)[::-1], qual[::-1]
    return name + ("/1" if flag & FIRST else "/2" if flag & SECOND else ""), seq, qual


def alignments(blocks: Blocks, end: int = -1) -> Iterator[tuple[str, int, str, str]]:
    """(name, flag, seq, qual) of records that begin before a virtual offset."""
    while end < 0 or blocks.tell() < end:
        head = blocks.read(4)
        if len(head) < 4:
            return
        body = blocks.read(struct.unpack("<i", head)[0])
        name_len, n_cigar, flag, size = body[8], *struct.unpack("<HHi", body[12:20])
        name = body[32 : 32 + name_len - 1].decode()
        at = 32 + name_len + 4 * n_cigar
        packed = body[at : at + (size + 1) // 2]
        seq = "".join([_PAIRS[x] for x in packed])[:size]
        at += len(packed)
        scores = body[at : at + size]
        qual = "" if scores[:1] == b"\xff" else bytes(x + 33 for x in scores).decode()
        yield name, flag, seq, qual


class Chunk(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def read_chunk(part: Chunk) -> Iterator[tuple[str, str, str]]:
    with files.opened(part.path) as f:
        blocks = Blocks(f, part.begin)
        if not part.begin:
            skip_header(blocks)
        for name, flag, seq, qual in alignments(blocks, part.end):
            if not flag & (SECONDARY | SUPPLEMENTARY):
                yield restored(name, flag, seq, qual)


def linear_offsets(data: bytes) -> list[int]:
    """Distinct virtual offsets of an index, ascending."""
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAM index")
    at, out = 8, set()
    for _ in range(struct.unpack("<i", data[4:8])[0]):
        bins, at = struct.unpack("<i", data[at : at + 4])[0], at + 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack("<i", data[at + 4 : at + 8])[0]
        n, at = struct.unpack("<i", data[at : at + 4])[0], at + 4
        out |= set(struct.unpack(f"<{n}Q", data[at : at + 8 * n]))
        at += 8 * n
    return sorted(out - {0})


def chunks(path: str, splits: int) -> list[Chunk]:
    index = next((x for x in (path + ".bai", path.removesuffix(".bam") + ".bai") if files.exists(x)), None)
    if splits <= 1 or index is None:
        return [Chunk(path, 0, -1)]
    with files.opened(index) as f:
        offsets = linear_offsets(f.read())
    size = files.size_of(path)
    cuts: list[int] = []
    for i in range(1, splits):
        behind = [o for o in offsets[1:] if o >> 16 >= size * i // splits]
        if behind and (not cuts or behind[0] > cuts[-1]):
            cuts.append(behind[0])
    return [Chunk(path, a, b) for a, b in zip([0, *cuts], [*cuts, -1])]


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.splits = files.expand(options.get("path", "")), int(options.get("splits", "1"))

    def partitions(self) -> list[InputPartition]:
        return [c for p in self.paths for c in chunks(p, self.splits)]

    def read(self, partition: Chunk) -> Iterator:
        yield from files.batches(read_chunk(partition))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def bam(spark: SparkSession, paths: str, splits: int = 1) -> DataFrame:
    ship(spark)
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splits", str(splits)).load(paths)
