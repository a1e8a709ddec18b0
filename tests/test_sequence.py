from pyspark.sql import functions as F

from strandlake.config import Config, load
from strandlake.functions import sequence as S
from strandlake.operators import kmers

import pytest


def one(spark, rows, **columns):
    return rows([(1,)], "x int").select(*[c.alias(n) for n, c in columns.items()]).first()


def test_bases_and_codes(spark, rows):
    lit = F.lit
    r = one(
        spark, rows, rc=S.reverse_complement(lit("AACGN")), code=S.encode(lit("TACG")), back=S.decode(lit(198).cast("long"), 4), rcc=S.reverse_complement_code(S.encode(lit("AACG")), 4),
        root=S.root(lit("TTGC")), o1=S.orientation(lit("TTGC")), o0=S.orientation(lit("GCAA")), pal=S.orientation(lit("ACGT")), lq=S.low_quality(lit("!45I#")), clean=S.clean(lit("acgtRn-")),
        kmer=S.kmer_of(lit("GCAA"), lit("A"), lit("C"), lit(1)), part=S.partition_code(lit("GTCAGT")), bin=S.log2_bin(lit(9)), sat=S.saturated(lit(70000)),
        ids=S.id_set(lit(" a  b a c ")), long=S.decode(S.encode(lit("T" * 30)), 30), gb=S.table_gb(lit(1 << 30), 8, 64),
    )
    assert (r.rc, r.code, r.back, r.root, r.o1, r.o0, r.pal, r.lq) == ("NCGTT", 198, "TACG", "GCAA", 1, 0, 0, 3)
    assert r.rcc == int("".join("0123"["ACGT".index(b)] for b in "CGTT"), 4)
    assert (r.clean, r.kmer, r.bin, r.sat, r.ids, r.long, r.gb) == ("ACGTNNN", "ATTGCC", 3, 65535, ["a", "b", "c"], "T" * 30, 73.0)
    g, t, c, a = 3, 2, 1, 0
    assert r.part == g | a << 2 | t << 4 | g << 6 | c << 8 | t << 10


def test_bitmaps(spark, rows):
    # A 30-base read, k = 12: places 0 and 2 ahead, 3 on the other strand.
    data = rows([("r", "a", 0), ("r", "a", 2), ("r", "b", 3), ("s", "a", 63), ("s", "a", 64)], "id string, dir string, pos int")
    from strandlake.operators.filter import bitmaps

    got = {(r["id"], r["dir"], r["word"]): r["bits"] for r in bitmaps(data).collect()}
    assert got == {("r", "a", 0): 5, ("r", "b", 0): 8, ("s", "a", 0): -(1 << 63), ("s", "a", 1): 1}
    words = F.array(F.lit(-(1 << 63)), F.lit(1).cast("long"))
    r = one(spark, rows, p=S.positions_of(words), h=S.hex_words(words), w=S.words_of_hex(S.hex_words(words)), e=S.positions_of(F.array().cast("array<bigint>")))
    assert r.p == [63, 64] and r.h == "8000000000000000 1" and r.w == [-(1 << 63), 1] and r.e == []


@pytest.mark.parametrize("positions, ok", [(list(range(7)), True), ([0, 1, 2, 3, 4, 5, 10], False), ([0, 1, 2, 3, 4, 5, 9], True), ([1, 20, 21, 22, 23, 24, 25, 26], True), ([0, 1, 2], False), ([], False)])
def test_window(spark, rows, positions, ok):
    r = rows([(positions,)], "p array<int>").select(S.dense(F.col("p"), 7, 10).alias("d")).first()
    assert r.d is ok


def test_quality_at_the_limit(spark, rows):
    data = rows([("a", 0, "ACGT", "!" * 2 + "I" * 18), ("b", 0, "ACGT", "!" * 3 + "I" * 17), ("c", 0, "ACGT", None), ("d", 0, "ACGT", ""), ("e", 0, "ACGT", "!" * 1 + "I" * 8)], "id string, kind int, seq string, qual string")
    assert {r["id"] for r in kmers.quality_filtered(data).collect()} == {"a", "c", "d"}
    assert kmers.quality_filtered(data, check=False).count() == 5


def test_segments_and_kmers(spark, rows):
    data = rows([("a", 0, "ACGTNNACGTACNAC", None), ("b", 1, "AC", None), ("c", 1, "NNNN", None), ("d", 1, "", None)], "id string, kind int, seq string, qual string")
    got = sorted((r["id"], r["start"], r["segment"]) for r in kmers.segments(data, 4).collect())
    assert got == [("a", 0, "ACGT"), ("a", 6, "ACGTAC")]
    assert sorted((r["at"], r["kmer"]) for r in kmers.kmers(data, 4).collect()) == [(0, "ACGT"), (6, "ACGT"), (7, "CGTA"), (8, "GTAC")]
    places = data.filter("id = 'a'").selectExpr("seq", "explode(array(0, 8, 13)) at").select(kmers.segment_place(F.col("seq"), F.col("at")).alias("p"))
    assert [r.p for r in places.collect()] == [0, 2, 0]


def test_config(tmp_path):
    f = tmp_path / "a.conf"
    f.write_text("[core]\nk = 20\ncheck-quality = false\noutput = /o\n# note\n; note\n[count]\noutput = /c\nenable-cache = false\n[filter]\nmax-reads = 7\n")
    cfg = load(str(f))
    assert (cfg.k, cfg.check_quality, cfg.enable_cache, cfg.max_reads, cfg.stem_len) == (20, False, False, 7, 18)
    assert (cfg.path("count"), cfg.path("merge"), cfg.with_output("/x").path("count")) == ("/c", "/o", "/x")
    assert (cfg.export_min, cfg.export_max, cfg.max_normal_b, cfg.min_tumor_b, cfg.window_min, cfg.window_len) == (29, 31, 1, 4, 7, 10)
    for bad in ({"input_format": "sam"}, {"index_format": "x"}, {"conversion_mode": "x"}, {"k": 2}, {"min_tumor_a": 0}, {"pid": 1}):
        with pytest.raises(ValueError):
            Config(**bad)
