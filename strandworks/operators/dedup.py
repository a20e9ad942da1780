"""Distinct haplotypes of a window with their multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions import bits as B

KEY = ["chrom", "window"]


def allele_counts(windowed: DataFrame) -> DataFrame:
    return windowed.groupBy(*KEY, "snp").agg(F.sum("allele").alias("count"))


def packed(windowed: DataFrame, words: int | None = None) -> DataFrame:
    """(chrom, window, hap, sample, bits, mask): one row per haplotype and window; arrays of ``words`` if given."""
    a, j = F.col("allele"), F.col("j")
    return windowed.groupBy(*KEY, "hap", "sample").agg(B.pack(a, j, words).alias("bits"), B.pack_mask(a, j, words).alias("mask"))


def unique(packed_: DataFrame) -> DataFrame:
    """(chrom, window, u_idx, bits, n_u). A stable partition per SNP sorts by the last SNP first, which
    is the numeric order of the packed bits."""
    n = packed_.groupBy(*KEY, "bits").agg(F.count("*").alias("n_u"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(B.order("bits", B.is_wide(n)))) - 1
    return n.select(*KEY, rank.cast("long").alias("u_idx"), "bits", "n_u")


def assign_haplotypes(packed_: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clusters of distinct haplotypes back to all: (chrom, window, hap, sample, cluster)."""
    return packed_.join(assigned.select(*KEY, "bits", "cluster"), [*KEY, "bits"]).select(*KEY, "hap", "sample", "cluster")
