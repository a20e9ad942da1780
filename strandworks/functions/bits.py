"""Alleles of a window packed into bits: SNP j of a window of up to 62 SNPs is bit j of one bigint, of a
wider one bit j % 62 of word j div 62 of an array<bigint>. All words of a table have the same number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SNPs of a word.
WORD = 62


def words_for(snps: int) -> int | None:
    """Number of words for windows of up to so many SNPs; None where one bigint does."""
    return None if snps <= WORD else -(-snps // WORD)


def is_wide(df: DataFrame, column: str = "bits") -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def pack(allele: Column, j: Column, words: int | None = None) -> Column:
    """Aggregate: the alleles (0/1, null as 0) of a group as bits, or as so many words."""
    if words is None:
        return F.sum(_bit(allele, j))
    word = F.floor(j / WORD)
    return F.array(*[F.coalesce(F.sum(F.when(word == w, _bit(allele, j % WORD))), F.lit(0).cast("long")) for w in range(words)])


def pack_mask(allele: Column, j: Column, words: int | None = None) -> Column:
    """Aggregate: bits of the SNPs whose allele is not null."""
    return pack(allele.isNotNull().cast("long"), j, words)


def _bit(value: Column, j: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(0)) * F.pow(F.lit(2.0), j).cast("long")


def count_bits(of, *columns: Column, wide: bool = False) -> Column:
    """Number of bits in of(columns), two or three, word by word where they are wide. Any bits beyond a word's 62 must be 0."""
    if not wide:
        return F.bit_count(of(*columns)).cast("long")
    if len(columns) == 2:
        counts = F.zip_with(*columns, lambda x, y: F.bit_count(of(x, y)).cast("long"))
    else:
        two = F.zip_with(*columns[:2], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        counts = F.zip_with(two, columns[2], lambda s, z: F.bit_count(of(s["x"], s["y"], z)).cast("long"))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)


def hamming(a: Column, b: Column, wide: bool = False) -> Column:
    return count_bits(lambda x, y: x.bitwiseXOR(y), a, b, wide=wide)


def hamming_missing(h: Column, r: Column, mask: Column, wide: bool = False) -> Column:
    """Mismatches among the sites of ``mask``."""
    return count_bits(lambda x, y, m: x.bitwiseXOR(y).bitwiseAND(m), h, r, mask, wide=wide)


def bit(bits: str, j: str, wide: bool = False) -> Column:
    """Allele at SNP j of packed bits."""
    if not wide:
        return F.expr(f"shiftright({bits}, cast({j} as int)) & 1")
    return F.expr(f"shiftright({bits}[cast({j} div {WORD} as int)], cast({j} % {WORD} as int)) & 1")


def order(bits: str, wide: bool = False) -> Column:
    """What sorts packed alleles as numbers: the last SNP counts most."""
    return F.reverse(bits) if wide else F.col(bits)


def alleles(bits: str, size: Column, wide: bool = False) -> Column:
    """Array of the alleles of the first ``size`` SNPs."""
    places = F.sequence(F.lit(0), size.cast("int") - 1)
    if not wide:
        return F.transform(places, lambda j: F.call_function("shiftright", F.col(bits), j).bitwiseAND(F.lit(1)))
    word = lambda j: F.element_at(F.col(bits), (F.floor(j / WORD) + 1).cast("int"))
    return F.transform(places, lambda j: F.call_function("shiftright", word(j), (j % WORD).cast("int")).bitwiseAND(F.lit(1)))
