"""Cluster membership of new samples against stored medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions import bits as B

KEY = ["chrom", "window"]


def align(windows: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, window, ok): whether each reference window opens at the same position in the new data.

    Chromosome names are compared whole, or by their trailing digits if either has them."""
    digits = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")), c)
    new = windows.select(digits(F.col("chrom")).alias("d"), F.col("window").alias("w"), F.col("start").alias("s"))
    ref = reference.withColumn("d", digits(F.col("chrom")))
    df = ref.join(new, (ref["d"] == new["d"]) & (ref["window"] == new["w"]), "left")
    return df.select(ref["chrom"], ref["window"], F.coalesce(F.col("s") == F.col("start"), F.lit(False)).alias("ok"))


def phased(packed: DataFrame, medians: DataFrame) -> DataFrame:
    """(chrom, window, hap, sample, cluster, d): nearest median without the missing sites, the highest
    cluster of equals. Equal haplotypes are compared once."""
    kinds = packed.select(*KEY, "bits", "mask").distinct()
    m = medians.select(*KEY, "cluster", F.col("bits").alias("median"))
    d = B.hamming_missing(F.col("bits"), F.col("median"), F.col("mask"), B.is_wide(packed))
    best = F.min(F.struct(d.alias("d"), (-F.col("cluster")).alias("c"))).alias("b")
    near = kinds.join(m, KEY).groupBy(*KEY, "bits", "mask").agg(best)
    return packed.join(near, [*KEY, "bits", "mask"]).select(*KEY, "hap", "sample", (-F.col("b.c")).alias("cluster"), "b.d")


def geno_states(genotypes: DataFrame, words: int | None = None) -> DataFrame:
    """(chrom, window, sample, hom, hom_mask, het): alleles and sites of homozygous calls, heterozygous
    sites. genotypes: windowed rows with dosage 0, 1, 2 or null."""
    hom, j = F.col("dosage").isin(0, 2), F.col("j")
    return genotypes.groupBy(*KEY, "sample").agg(
        B.pack(F.when(hom, F.col("dosage") / 2), j, words).alias("hom"),
        B.pack(F.when(hom, F.lit(1)), j, words).alias("hom_mask"),
        B.pack(F.when(F.col("dosage") == 1, F.lit(1)), j, words).alias("het"),
    )


def unphased(states: DataFrame, medians: DataFrame, compat: bool = False) -> DataFrame:
    """(chrom, window, sample, c1, c2, t): the pair of medians with the least 2 * d1 + d2.

    The first haplotype takes the first median's alleles at heterozygous sites, the second their
    complement. Of equal pairs the first in (c1, c2) order wins; with ``compat`` the last one, where a
    single-precision copy of 0.33 * t would have been rounded up.

    t is at least 2 * d1 plus the least d2 of any second median, which is no less than that without the
    heterozygous sites. So the pair of the two nearest medians bounds t from above, and only medians
    that can still reach it are paired: a few for each genotype instead of all squared.
    """
    wide = B.is_wide(states, "hom")
    genotype = [*KEY, "hom", "hom_mask", "het"]
    kinds = states.select(*genotype).distinct()
    m = medians.select(*KEY, "cluster", "bits")
    d = B.hamming_missing(F.col("hom"), F.col("bits"), F.col("hom_mask"), wide)
    apart = lambda a, b: B.count_bits(lambda x, y, h: F.bitwise_not(x.bitwiseXOR(y)).bitwiseAND(h), a, b, F.col("het"), wide=wide)
    near = kinds.join(m, KEY).withColumn("d", d)
    # every genotype's medians by their homozygous distance, as one array
    row = near.groupBy(*genotype).agg(F.sort_array(F.collect_list(F.struct("d", "cluster", "bits"))).alias("m"))
    first = F.col("m")[0]
    # a pair that exists: the nearest median with itself or with any other one
    bound = F.array_min(F.transform("m", lambda y: 2 * first["d"] + y["d"] + apart(first["bits"], y["bits"])))
    row = row.withColumn("least", first["d"]).withColumn("bound", bound)
    one = row.select(*genotype, "m", "least", "bound", F.explode("m").alias("x")).where(2 * F.col("x.d") + F.col("least") <= F.col("bound"))
    t = lambda y: 2 * F.col("x.d") + y["d"] + apart(F.col("x.bits"), y["bits"])
    c1 = F.col("x.cluster")
    keyed = lambda y: F.struct(t(y).alias("t"), c1.alias("x"), y["cluster"].alias("y"), c1.alias("c1"), y["cluster"].alias("c2"))
    if compat:
        last = lambda t: (t > 0) & ((F.lit(0.33) * t).cast("float").cast("double") > F.lit(0.33) * t)
        sign = lambda y: F.when(last(t(y)), F.lit(-1)).otherwise(F.lit(1))
        keyed = lambda y: F.struct(t(y).alias("t"), (sign(y) * c1).alias("x"), (sign(y) * y["cluster"]).alias("y"), c1.alias("c1"), y["cluster"].alias("c2"))
    reach = F.filter("m", lambda y: 2 * F.col("x.d") + y["d"] <= F.col("bound"))
    best = one.select(*genotype, F.array_min(F.transform(reach, keyed)).alias("b")).groupBy(*genotype).agg(F.min("b").alias("b"))
    return states.join(best, genotype).select(*KEY, "sample", "b.c1", "b.c2", "b.t")
