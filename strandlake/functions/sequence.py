"""Column functions over bases, k-mers, quality strings and position sets.  JVM-side only.

``A C G T`` is both the alphabetical and the code order, so the least of two strings
is the least of their codes.  Anything outside ACGT counts as N.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counters stop here; the characters of phred scores under 20.
SATURATED = 65535
LOW_QUALITY = "[!-4]+"


def clean(seq: Column) -> Column:
    # Most reads are clean: one look instead of two copies.
    return F.when(seq.rlike("^[ACGTN]*$"), seq).otherwise(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def low_quality(qual: Column) -> Column:
    """Bases with a phred score under 20: characters before '5'."""
    return F.length(qual) - F.length(F.regexp_replace(qual, LOW_QUALITY, ""))


def passes_quality(qual: Column) -> Column:
    """At most a tenth of low-quality bases, rounded down; no quality string always passes."""
    return F.coalesce(low_quality(qual) <= F.floor(F.length(qual) / 10), F.lit(True))


def stem(kmer: Column, k: int) -> Column:
    return F.substring(kmer, 2, k - 2)


def first_base(kmer: Column) -> Column:
    return F.substring(kmer, 1, 1)


def last_base(kmer: Column) -> Column:
    return F.substring(kmer, -1, 1)


def root(stem_: Column) -> Column:
    return F.least(stem_, reverse_complement(stem_))


def orientation(stem_: Column) -> Column:
    """0 if the stem is its own root, palindromes included, else 1."""
    return (reverse_complement(stem_) < stem_).cast("int")


def kmer_of(root_: Column, first: Column, last: Column, order: Column) -> Column:
    return F.concat(first, F.when(order == 1, reverse_complement(root_)).otherwise(root_), last)


def encode(seq: Column) -> Column:
    """Two bits a base, at most 31 bases."""
    return F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def reverse_complement_code(code: Column, length: int) -> Column:
    return encode(reverse_complement(decode(code, length)))


def partition_code(sixmer: Column) -> Column:
    """12 bits of a 6-mer.  Fixed values: A0 C1 T2 G3, the shift of each base."""
    shifts = (0, 4, 8, 2, 6, 10)
    digits = F.translate(sixmer, "ACTG", "0123")
    return sum((F.shiftleft(F.substring(digits, i + 1, 1).cast("int"), s) for i, s in enumerate(shifts)), F.lit(0))


def saturated(count: Column) -> Column:
    return F.least(count, F.lit(SATURATED))


def log2_bin(x: Column) -> Column:
    return F.floor(F.log2(x)).cast("int")


def bit(position: Column) -> Column:
    """A position's bit in its word of 64; the top bit is the sign."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position % 64).cast("int"))


def positions_of(words: Column) -> Column:
    """Ascending positions whose bits are set in an array of 64-bit words."""
    every = F.sequence(F.lit(0), F.size(words) * 64 - 1)
    set_ = lambda p: F.call_function("getbit", words[F.floor(p / 64).cast("int")], (p % 64).cast("int")) == 1
    return F.when(F.size(words) > 0, F.filter(every, set_)).otherwise(F.array().cast("array<int>"))


def hex_words(words: Column) -> Column:
    return F.concat_ws(" ", F.transform(words, lambda w: F.lower(F.hex(w))))


def words_of_hex(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), " +"), lambda w: F.conv(w, 16, -10).cast("long"))


def dense(positions: Column, least: int, span: int) -> Column:
    """Whether some ``least`` consecutive ascending positions lie within ``span`` bases."""
    n = F.size(positions)
    starts = F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)))
    near = F.exists(starts, lambda i: F.get(positions, i + least - 1) - F.get(positions, i) < span)
    return F.when(n >= least, near).otherwise(F.lit(False))


def id_set(text: Column) -> Column:
    """Distinct ids of a space-separated list."""
    return F.array_distinct(F.filter(F.split(F.trim(text), " +"), lambda x: x != ""))


def leads_possible(seq: Column) -> Column:
    return (F.length(seq) > 0) & ~F.contains(seq, F.lit("N"))


def directed(seq: Column, direction: Column) -> Column:
    return F.when(direction == "b", reverse_complement(seq)).otherwise(seq)


def table_gb(entries: Column, key_bytes: int, value_bytes: int) -> Column:
    return entries.cast("double") * (key_bytes + value_bytes + 1) / float(1 << 30)
