"""Deterministic haplotype tables derived from the ``embeddings`` test table.

``vec_id`` is the haplotype, ``vec_id div 2`` the sample, dimension j the SNP; eight founders in four
populations switch every 16 SNPs, with a few flipped alleles. Integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.functions import bits as B

N_SNPS, SIZE, K = 64, 8, 3
#: SNPs and window of the wide tables: one chromosome, two windows of 128 and 192.
WIDE_SNPS, WIDE = 320, 128


def _founder_bit(founder: str) -> str:
    return f"if(({founder} * 131 + j * 17 + {founder} * j * 37 + {founder} * {founder} * j * 11) % 23 < 9, 1L, 0L)"


def _axis(df: DataFrame, wide: bool = False) -> DataFrame:
    df = df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit((WIDE_SNPS if wide else N_SNPS) - 1)))).withColumn("j", F.col("j").cast("long"))
    return df.withColumns({
        "chrom": F.lit("chr3") if wide else F.expr("if(j < 32, 'chr1', 'chr2')"),
        "snp": F.col("j") if wide else F.expr("j % 32"),
        "pos": F.expr("1000 + j * 137 + (j * j * 13) % 101"),
    })


def haplotypes(spark: SparkSession, sf_dir: str, missing: bool = False, wide: bool = False) -> DataFrame:
    """(chrom, snp, pos, hap, sample, allele); with ``missing`` some alleles are null, ``wide`` is one long chromosome."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("hap"), F.col("label").cast("long").alias("label"))
    df = _axis(base.withColumn("sample", F.expr("hap div 2")), wide)
    df = df.withColumn("founder", F.expr("(label % 4) * 2 + ((hap * 31 + (j div 16) * 17 + hap div 7) % 2)"))
    df = df.withColumn("f", F.expr(_founder_bit("founder")))
    allele = F.expr("if((hap * 53 + j * 29 + hap * j * 7) % 97 < 2, 1 - f, f)")
    if missing:
        allele = F.when(F.expr("(hap * 11 + j * 5) % 41 <> 0"), allele)
    return df.select("chrom", "snp", "pos", "hap", "sample", allele.alias("allele"))


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy variant: the allele is the sign of the embedding."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("hap"), F.posexplode("embedding").alias("j", "x"))
    return base.select(F.expr("if(j < 32, 'chr1', 'chr2')").alias("chrom"), F.expr("cast(j % 32 as long)").alias("snp"), F.expr("1000L + j * 137 + (j * j * 13) % 101").alias("pos"), "hap", F.expr("hap div 2").alias("sample"), F.expr("if(x > 0, 1L, 0L)").alias("allele"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, pop): 0 is unlabelled, else the population of the sample's even haplotype, from 1."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 2 = 0")
    return base.select(F.expr("vec_id div 2").alias("sample"), F.expr("if((vec_id div 2) % 3 = 0, cast(label as long) % 4 + 1, 0L)").alias("pop"))


def founder_medians(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """(chrom, window, cluster, bits): distinct strings, in each window of SIZE (or WIDE) SNPs, of the founders that
    the table's haplotypes descend from."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.explode(F.expr("array(0L, 1L)")).alias("i"), F.expr("cast(label as long) % 4").alias("pop"))
    founders = own.select((F.col("pop") * 2 + F.col("i")).alias("founder")).distinct()
    df = _axis(founders, wide).withColumn("f", F.expr(_founder_bit("founder")))
    window = F.expr(f"least(snp div {WIDE}, {WIDE_SNPS // WIDE - 1})" if wide else f"snp div {SIZE}")
    words = B.words_for(WIDE_SNPS - WIDE) if wide else None
    df = df.withColumn("window", window.cast("long")).withColumn("o", F.expr(f"snp - window * {WIDE if wide else SIZE}"))
    df = df.groupBy("chrom", "window", "founder").agg(B.pack(F.col("f"), F.col("o"), words).alias("bits"))
    first = df.groupBy("chrom", "window", "bits").agg(F.min("founder").alias("founder"))
    w = Window.partitionBy("chrom", "window").orderBy("founder")
    return first.select("chrom", "window", (F.row_number().over(w) - 1).cast("long").alias("cluster"), "bits")


def p_fixed(medians: DataFrame) -> DataFrame:
    """(chrom, window, cluster, k, p) for K sources."""
    df = medians.select("chrom", "window", "cluster").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(K - 1)))).withColumn("k", F.col("k").cast("long"))
    raw = F.expr("cast(1 + (window * 7 + cluster * 13 + k * 29) % 17 as double)")
    return df.withColumn("p", raw / F.sum(raw).over(Window.partitionBy("chrom", "window", "k")))


def q_fixed(samples: DataFrame) -> DataFrame:
    """(sample, k, q) for K sources."""
    df = samples.select("sample").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(K - 1)))).withColumn("k", F.col("k").cast("long"))
    raw = F.expr("cast(1 + (sample * 5 + k * 11) % 7 as double)")
    return df.withColumn("q", raw / F.sum(raw).over(Window.partitionBy("sample")))
