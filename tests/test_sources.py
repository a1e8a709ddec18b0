"""Readers and writers on files made here."""

import gzip
import struct
import zlib

from strandlake.config import Config
from strandlake.operators import filter as index, group
from strandlake.sources import bam, fastq, files, tables


def records(n, seed=0):
    return [(f"r{i}", "ACGTN"[(i + seed) % 5] * (20 + i % 7), "@+I!5"[i % 5] * (20 + i % 7)) for i in range(n)]


def as_fastq(rows):
    return "".join(f"@{i} more\n{s}\n+\n{q}\n" for i, s, q in rows).encode()


def got(df):
    return sorted((r.id, r.seq, r.qual) for r in df.collect())


def test_fastq_plain_gzip_and_ranges(spark, tmp_path):
    rows = records(300)
    (tmp_path / "a.fq").write_bytes(as_fastq(rows))
    half = as_fastq(rows[:100])
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(half) + gzip.compress(as_fastq(rows[100:])))  # two members
    assert got(fastq.fastq(spark, str(tmp_path / "a.fq"))) == sorted(rows)
    assert got(fastq.fastq(spark, str(tmp_path / "b.fq.gz"))) == sorted(rows)
    for size in (1000, 777, 61):
        df = fastq.fastq(spark, str(tmp_path / "a.fq"), split_bytes=size)
        assert df.rdd.getNumPartitions() > 5 and got(df) == sorted(rows)
    both = got(fastq.fastq(spark, f"{tmp_path}/*.fq {tmp_path}/b.fq.gz"))
    assert len(both) == 600


def test_fastq_shapes(spark, tmp_path):
    (tmp_path / "c.fq").write_bytes(b"\n@a x\nAC\nGT\n+a\nII\n@I\n>b\nACGT\n@c\nAC\r\n+\r\nII\r\n@d\n\n+\n\n")
    rows = {r.id: (r.seq, r.qual) for r in fastq.fastq(spark, str(tmp_path / "c.fq")).collect()}
    assert rows["a"] == ("ACGT", "II@I") and rows["b"] == ("ACGT", None) and rows["c"] == ("AC", "II")
    (tmp_path / "e.fq").write_bytes(b"")
    assert fastq.fastq(spark, str(tmp_path / "e.fq")).count() == 0


def bgzf(data, size=200):
    out, at = b"", []
    for i in range(0, len(data), size):
        part = data[i : i + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        at.append((len(out), i))
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out, at


def as_bam(rows, size=200):
    data = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 4) + b"chr\0" + struct.pack("<i", 1000)
    starts = []
    for name, flag, seq, qual in rows:
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        scores = bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)
        body = struct.pack("<iiBBHHHiiii", 0, 0, len(name) + 1, 0, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", 4) + packed + scores
        starts.append(len(data))
        data += struct.pack("<i", len(body)) + body
    packed, at = bgzf(data, size)
    virtual = [[(f << 16 | s - i) for f, i in at if i <= s][-1] for s in starts]
    return packed + bgzf(b"")[0], virtual


def test_bam_flags(spark, tmp_path):
    rows = [("a", 64, "AACGT", "ABCDE"), ("a", 128 | 16, "AACGN", "ABCDE"), ("s", 256, "AC", "II"), ("p", 2048, "AC", "II"), ("u", 0, "ACG", "")]
    (tmp_path / "x.bam").write_bytes(as_bam(rows)[0])
    assert got(bam.bam(spark, str(tmp_path / "x.bam"))) == [("a/1", "AACGT", "ABCDE"), ("a/2", "NCGTT", "EDCBA"), ("u", "ACG", "")]


def test_bam_in_chunks(spark, tmp_path):
    rows = [(f"r{i}", 0, "ACGTACGTAC"[: 3 + i % 7], "I" * (3 + i % 7)) for i in range(200)]
    packed, virtual = as_bam(rows)
    (tmp_path / "x.bam").write_bytes(packed)
    index_ = b"BAI\x01" + struct.pack("<i", 1) + struct.pack("<i", 1) + struct.pack("<Ii", 4681, 1) + struct.pack("<QQ", 0, 1) + struct.pack("<i", 20) + struct.pack("<20Q", *virtual[::10])
    (tmp_path / "x.bam.bai").write_bytes(index_)
    df = bam.bam(spark, str(tmp_path / "x.bam"), splits=4)
    assert df.rdd.getNumPartitions() == 4
    assert got(df) == sorted((n, s, q) for n, _, s, q in rows)
    both = fastq.reads(spark, str(tmp_path / "x.bam"), str(tmp_path / "x.bam"), "bam")
    assert both.groupBy("kind").count().count() == 2


def test_paths(tmp_path, monkeypatch):
    for n in "ab":
        (tmp_path / f"{n}.fq").write_text("")
    monkeypatch.setenv("HERE", str(tmp_path))
    assert files.expand("$HERE/*.fq  s3://x/y.fq") == [f"{tmp_path}/a.fq", f"{tmp_path}/b.fq", "s3://x/y.fq"]
    assert files.expand(f"file://{tmp_path}/*.fq file://{tmp_path}/c*") == [f"file://{tmp_path}/a.fq", f"file://{tmp_path}/b.fq", f"file://{tmp_path}/c*"]
    assert files.expand("$(ls) ") == ["$(ls)"]


def small_indexes(rows):
    return index.Indexes(
        rows([("nn", "a", "ACGT"), ("tn", "b", "GGTT"), ("tm", "b", "GGTT")], "set string, id string, seq string"),
        rows([("nn", "ACGT", "a"), ("tn", "GGTT", "b"), ("tn", "GGTT", "c")], "set string, kmer string, id string"),
        rows([("b", "a", 0), ("b", "a", 63), ("b", "b", 70)], "id string, dir string, pos int"),
    )


def test_plain_indexes_round_trip(spark, rows, tmp_path):
    ix = small_indexes(rows)
    lines = {n: sorted(r.line for r in df.collect()) for n, df in tables.plain_lines(ix, 10).items()}
    assert lines["k2i-tn"] == ["GGTT 2 b c"] and lines["i2p-tm"] == [f"b {1 | 1 << 63} 0 0 64"] and lines["seq-nn"] == ["a ACGT"]
    assert sorted(r.line for r in tables.plain_lines(ix, 1)["k2i-tn"].collect()) == []
    tables.write_plain(ix, str(tmp_path), 10)
    back = tables.read_plain(spark, str(tmp_path))
    same = lambda a, b: sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))
    assert same(ix.seq, back.seq) and same(ix.k2i, back.k2i) and same(ix.i2p, back.i2p)
    tables.dump_indexes(ix, str(tmp_path / "p"))
    again = tables.restore_indexes(spark, str(tmp_path / "p"))
    assert same(ix.seq, again.seq) and same(ix.k2i, again.k2i) and same(ix.i2p, again.i2p)


def unpack(data, at=0):
    b = data[at]
    if b < 0x80:
        return b, at + 1
    if 0xA0 <= b < 0xC0:
        n = b & 31
        return data[at + 1 : at + 1 + n].decode(), at + 1 + n
    if 0x90 <= b < 0xA0 or b in (0xDC, 0xDD):
        n, at = (b & 15, at + 1) if b < 0xA0 else (int.from_bytes(data[at + 1 : at + 3], "big"), at + 3)
        out = []
        for _ in range(n):
            x, at = unpack(data, at)
            out.append(x)
        return out, at
    size = {0xCC: 1, 0xCD: 2, 0xCE: 4}.get(b)
    if size:
        return int.from_bytes(data[at + 1 : at + 1 + size], "big"), at + 1 + size
    size = {0xD9: 1, 0xDA: 2}[b]
    n = int.from_bytes(data[at + 1 : at + 1 + size], "big")
    return data[at + 1 + size : at + 1 + size + n].decode(), at + 1 + size + n


def test_msgpack():
    for x in (5, 200, 300, 70000, "a", "b" * 40, "c" * 300, [1, ["x"] * 20, []]):
        assert unpack(tables.packed(x)) == (x, len(tables.packed(x)))
    assert tables.packed({"a": 1}) == b"\x81\xa1a\x01"


def test_packed_groups(spark, rows):
    from tests.test_stages import hand_made

    ix, _ = hand_made(spark, rows)
    out = {r.lead: unpack(bytes(r.packed))[0] for r in tables.packed_groups(group.groups(ix, Config(k=4))).collect()}
    assert out["L1"][0][0] == "L1" and out["L1"][1] == [list(range(7)), []] and len(out["L1"][2][0]) == 7
