"""Phenotypes of simulated studies, and allele-frequency bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polygenic_score(genotypes: DataFrame, effects: DataFrame, site: list[str], unit: str = "sample") -> DataFrame:
    """(unit, score): sum of dosage times effect over the sites of ``effects``."""
    return genotypes.join(effects, site).groupBy(unit).agg(F.sum(F.col("dosage") * F.col("b")).alias("score"))


def scaled(df: DataFrame, value: str, target: float) -> DataFrame:
    """Centre, and scale to a standard deviation of sqrt(target) (population formula)."""
    s = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    x = (F.col(value) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")) * F.lit(target**0.5)
    return df.crossJoin(F.broadcast(s)).withColumn(value, x).drop("__m", "__s")


def phenotype(scores: DataFrame, noise: DataFrame, h2: float, unit: str = "sample") -> DataFrame:
    """(unit, g, y): breeding values of variance h2, and with noise of variance 1 - h2."""
    g = scaled(scores.select(unit, F.col("score").alias("g")), "g", h2)
    e = scaled(noise.select(unit, "e"), "e", 1 - h2)
    return g.join(e, unit).select(unit, "g", (F.col("g") + F.col("e")).alias("y"))


def maf_bins(afreq: DataFrame, bins: int = 10) -> DataFrame:
    """(…, maf, bin): equal-width bins of the minor allele frequency over its range, from 1."""
    df = afreq.withColumn("maf", F.least(F.col("freq"), 1 - F.col("freq")))
    r = df.agg(F.min("maf").alias("lo"), F.max("maf").alias("hi"))
    b = F.least(F.lit(bins), F.floor((F.col("maf") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1)
    return df.crossJoin(F.broadcast(r)).withColumn("bin", F.when(F.col("hi") > F.col("lo"), b).otherwise(F.lit(1)).cast("long")).drop("lo", "hi")


def stratified_sample(binned: DataFrame, order: Column, share: float = 0.1, bins: int = 10) -> DataFrame:
    """The first ceil(rows * share / bins) rows of every bin in a given (hashed) order."""
    n = binned.agg(F.ceil(F.count("*") * share / bins).alias("take"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(order, "id"))
    return binned.withColumn("rank", rank).crossJoin(F.broadcast(n)).where("rank <= take").drop("rank", "take")
