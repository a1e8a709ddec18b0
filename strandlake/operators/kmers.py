"""Reads to k-mers.

Up to ``PACKED`` bases a k-mer is a long, two bits a base, and so is its stem or root;
longer ones are strings.  Both sort alike, and every step but this one and the decoding
at the end works on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

NORMAL, TUMOR = 0, 1
#: Bases of a long, and places that a block of a read covers.
PACKED, BLOCK = 31, 16


def both_kinds(normal: DataFrame, tumor: DataFrame) -> DataFrame:
    return normal.withColumn("kind", F.lit(NORMAL)).unionByName(tumor.withColumn("kind", F.lit(TUMOR)))


def quality_filtered(reads: DataFrame, check: bool = True) -> DataFrame:
    """Reads with at most a tenth of low-quality bases, their bases cleaned."""
    kept = reads.filter(S.passes_quality(F.col("qual"))) if check else reads
    return kept.withColumn("seq", S.clean(F.col("seq")))


def segments(reads: DataFrame, k: int) -> DataFrame:
    """(id, kind, start, segment): maximal stretches without N of at least k bases."""
    at_n = F.expr("filter(sequence(1, length(seq)), i -> substring(cast(seq as binary), i, 1) = X'4E')")
    starts = F.when(F.contains("seq", F.lit("N")), F.concat(F.array(F.lit(0)), at_n)).otherwise(F.array(F.lit(0)))
    rows = reads.select("id", "kind", F.inline(F.arrays_zip(starts.alias("start"), F.split("seq", "N").alias("segment"))).alias("start", "segment"))
    return rows.filter(F.length("segment") >= k)


def _bits(digits: Column, base: int) -> Column:
    return F.conv(digits, base, 10).cast("long")


def _up(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _down(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def _packed(reads: DataFrame, k: int, keep: tuple[str, ...]) -> DataFrame:
    """Blocks of a read are coded once; a k-mer is a shift and a mask of its block's codes."""
    wide = PACKED if k <= BLOCK else PACKED + BLOCK
    digits = F.translate("seq", "ACGTN", "01230")
    marks = F.when(F.contains("seq", F.lit("N")), F.translate("seq", "ACGTN", "00001"))
    rows = reads.filter(F.length("seq") >= k).select(*keep, F.length("seq").alias("_len"), digits.cast("binary").alias("_digits"), marks.cast("binary").alias("_marks"))
    rows = rows.select(*keep, "_len", "_digits", "_marks", F.explode(F.sequence(F.lit(0), F.col("_len") - k, F.lit(BLOCK))).alias("_from"))
    part = lambda c: F.rpad(F.expr(f"cast(substring({c}, _from + 1, {wide}) as string)"), wide, "0")
    rows = rows.select(*keep, "_len", "_from", part("_digits").alias("_part"), F.when(F.col("_marks").isNotNull(), _bits(part("_marks"), 2)).alias("_n"))
    one, two = F.expr(f"left(_part, {PACKED})"), F.expr(f"right(_part, {BLOCK})")
    every = lambda bases: F.lit((1 << 2 * bases) - 1).cast("long")
    words = [_bits(one, 4).alias("_a"), (every(PACKED) - _bits(F.reverse(one), 4)).alias("_ra")]
    if wide > PACKED:
        words += [_bits(two, 4).alias("_b"), (every(BLOCK) - _bits(F.reverse(two), 4)).alias("_rb")]
    rows = rows.select(*keep, "_len", "_from", "_n", *words)
    names = [c for c in rows.columns if c != "_len"]
    rows = rows.select(*names, F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK - 1), F.col("_len") - k - F.col("_from")))).alias("_off"))
    off, mask = F.col("_off"), every(k)
    rows = rows.filter(F.col("_n").isNull() | (_down(F.col("_n"), F.lit(wide - k) - off).bitwiseAND((1 << k) - 1) == 0))
    ahead, behind = _down(F.col("_a"), 2 * (PACKED - k - off)), _down(F.col("_ra"), 2 * off)
    if wide > PACKED:
        over = off + (k - PACKED)
        ahead = F.when(over <= 0, ahead).otherwise(_up(F.col("_a"), 2 * over).bitwiseOR(_down(F.col("_b"), 2 * (BLOCK - over))))
        behind = behind.bitwiseOR(_up(F.col("_rb"), 2 * (PACKED - off)))
    return rows.select(*keep, (F.col("_from") + off).alias("at"), ahead.bitwiseAND(mask).alias("kmer"), behind.bitwiseAND(mask).alias("rc"))


def _strings(reads: DataFrame, k: int, keep: tuple[str, ...]) -> DataFrame:
    # Bytes are cut at their place; a string would be walked from its start.
    raw = reads.filter(F.length("seq") >= k).select(*keep, F.col("seq").cast("binary").alias("_raw"), F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("at"))
    rows = raw.select(*keep, "at", F.expr(f"cast(substring(_raw, at + 1, {k}) as string)").alias("kmer")).filter(~F.contains("kmer", F.lit("N")))
    return rows.select(*keep, "at", "kmer", S.reverse_complement(F.col("kmer")).alias("rc"))


def occurrences(reads: DataFrame, k: int, keep: tuple[str, ...] = ("id", "kind")) -> DataFrame:
    """One row for each place ``at`` of a read whose k bases hold no N: (keep, at, kmer, rc).

    ``rc`` is the reverse complement; both are keys (``text`` makes strings of them).  A
    narrow step: the rows of a read stay in its partition.
    """
    return (_packed if k <= PACKED else _strings)(reads, k, keep)


def text(key: Column, length: int, k: int) -> Column:
    """The bases of a key of ``length`` bases that belongs to k-mers."""
    return S.decode(key, length) if k <= PACKED else key


def key(bases: Column, k: int) -> Column:
    """The key of a k-mer's (or its root's) bases."""
    return S.encode(bases) if k <= PACKED else bases


def stem(kmer: Column, k: int) -> Column:
    """The stem's key from a k-mer's."""
    return _down(kmer, F.lit(2)).bitwiseAND((1 << 2 * (k - 2)) - 1) if k <= PACKED else S.stem(kmer, k)


def root(kmer: Column, rc: Column, k: int) -> Column:
    """The root's key: the lesser stem of a k-mer and its reverse complement."""
    return F.least(stem(kmer, k), stem(rc, k))


def own(kmer: Column, rc: Column, k: int) -> Column:
    """Whether the stem is its own reverse complement."""
    return stem(kmer, k) == stem(rc, k)


def orientation(kmer: Column, rc: Column, k: int) -> Column:
    """0 if the stem is its own root, palindromes included, else 1."""
    return (stem(rc, k) < stem(kmer, k)).cast("int")


#: Shifts and masks that swap neighbouring groups of bits, from one base to 16.
_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def with_complement(rows: DataFrame, kmer: str, rc: str, k: int) -> DataFrame:
    """``rows`` with the key of the reverse complement of ``kmer``."""
    if k > PACKED:
        return rows.withColumn(rc, S.reverse_complement(F.col(kmer)))
    # A step for each swap: nested in one expression they would double its size each time.
    rows = rows.withColumn(rc, F.bitwise_not(F.col(kmer)))
    for n, mask in _SWAPS:
        m = F.lit(mask)
        rows = rows.withColumn(rc, _down(F.col(rc), F.lit(n)).bitwiseAND(m).bitwiseOR(_up(F.col(rc).bitwiseAND(m), F.lit(n))))
    return rows.withColumn(rc, _down(F.col(rc), F.lit(64 - 2 * k)).bitwiseAND((1 << 2 * k) - 1))


def kmers(reads: DataFrame, k: int, keep: tuple[str, ...] = ("id", "kind")) -> DataFrame:
    """(keep, at, kmer) with the k-mers as strings."""
    return occurrences(reads, k, keep).select(*keep, "at", text(F.col("kmer"), k, k).alias("kmer"))


def with_root(rows: DataFrame, k: int) -> DataFrame:
    """Occurrences with their root's key."""
    return rows.withColumn("root", root(F.col("kmer"), F.col("rc"), k))


def segment_place(seq, at):
    """A place counted from the start of its segment."""
    return at - F.length(F.regexp_extract(F.left(seq, at), "^.*N", 0))
