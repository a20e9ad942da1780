"""Interchange formats: VCF text, PLINK, packed assignment and median files, fixed-column text.

Canonical storage is Parquet; these are adapters. Text is parsed in the JVM; binary files, one row of
bytes each, are decoded by numpy inside ``mapInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the formats: magic bytes, dosage of a PLINK code, fixed columns of text files.
MAGIC = bytes([7, 9, 13])
PLINK_MAGIC = bytes([108, 27, 1])
PLINK_DOSAGE = (2, None, 1, 0)
WIN_SCHEMA = "chrom string, start long, end long, length long, size long, k long"
BIM_SCHEMA = "chrom string, id string, cm long, pos long, a1 string, a2 string"
FAM_SCHEMA = "fid string, iid string, pat long, mat long, sex long, pheno long"


# --- VCF ------------------------------------------------------------------------------------------

def vcf_lines(haplotypes: DataFrame) -> DataFrame:
    """(value): phased VCF records of (chrom, snp, pos, hap, sample, allele)."""
    gt = haplotypes.groupBy("chrom", "snp", "pos", "sample").agg(F.sort_array(F.collect_list(F.struct("hap", F.coalesce(F.col("allele").cast("string"), F.lit(".")).alias("a")))).alias("v"))
    gt = gt.select("chrom", "snp", "pos", "sample", F.expr("concat_ws('|', transform(v, x -> x.a))").alias("gt"))
    row = gt.groupBy("chrom", "snp", "pos").agg(F.sort_array(F.collect_list(F.struct("sample", "gt"))).alias("v"))
    return row.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.format_string("snp%d", "snp"), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.expr("array_join(transform(v, x -> x.gt), '\t')")).alias("value"))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(chrom, pos, sample, gt, phased) of text lines without headers. Multi-allelic records raise: split or
    filter them before, as dropping them would shift the windows."""
    df = lines.where("not startswith(value, '#')").select(F.split("value", "\t").alias("c"))
    alt = F.expr("if(contains(c[4], ','), raise_error(concat('multi-allelic record at ', c[0], ':', c[1])), c[0])")
    df = df.select(alt.alias("chrom"), F.expr("cast(c[1] as bigint)").alias("pos"), F.posexplode(F.expr("slice(c, 10, size(c) - 9)")).alias("sample", "gt"))
    gt = F.split("gt", ":")[0]
    return df.select("chrom", "pos", F.col("sample").cast("long").alias("sample"), gt.alias("gt"), F.contains(gt, F.lit("|")).alias("phased"))


def vcf_haplotypes(lines: DataFrame) -> DataFrame:
    """(chrom, pos, hap, sample, allele): two haplotypes of each phased call, '.' as null."""
    df = parse_vcf(lines).select("chrom", "pos", "sample", F.posexplode(F.split("gt", r"[|/]")).alias("i", "a"))
    return df.select("chrom", "pos", (2 * F.col("sample") + F.col("i")).alias("hap"), "sample", F.expr("try_cast(nullif(a, '.') as bigint)").alias("allele"))


def is_phased(lines: DataFrame) -> DataFrame:
    """(chrom, phased): whether the first sample's call of a file's first record is."""
    first = F.min_by("phased", F.struct("pos", "sample"))
    return parse_vcf(lines).groupBy("chrom").agg(first.alias("phased"))


def checked_labels(lines: DataFrame, sources: int) -> DataFrame:
    """(sample, pop) of (sample, value) lines: integers from 0 (none) to the number of sources."""
    pop = F.expr("try_cast(trim(value) as bigint)")
    bad = pop.isNull() | ~pop.between(0, sources)
    return lines.select("sample", F.when(bad, F.raise_error(F.concat(F.lit("not a population label: "), F.coalesce("value", F.lit("null"))))).otherwise(pop).cast("long").alias("pop"))


def genotypes(haplotypes: DataFrame) -> DataFrame:
    """(chrom, snp, pos, sample, dosage): null if either allele is."""
    keys = ["chrom", "snp", "pos", "sample"]
    full = F.count("allele") == F.count("*")
    return haplotypes.groupBy(*keys).agg(F.when(full, F.sum("allele")).alias("dosage"))


# --- PLINK ----------------------------------------------------------------------------------------

def plink_encode(genotypes_: DataFrame, row: list[str]) -> DataFrame:
    """(row…, byte_idx, byte): four samples to a byte, low bits first."""
    code = F.when(F.col("dosage").isNull(), 1).when(F.col("dosage") == 2, 0).when(F.col("dosage") == 1, 2).otherwise(3)
    df = genotypes_.withColumn("byte_idx", F.expr("sample div 4"))
    return df.groupBy(*row, "byte_idx").agg(F.sum(code * F.pow(F.lit(4), F.col("sample") % 4).cast("long")).alias("byte"))


def plink_decode(bed: DataFrame, row: list[str], samples: int) -> DataFrame:
    df = bed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("sample", F.col("byte_idx") * 4 + F.col("i"))
    dosage = F.expr("element_at(array(2L, null, 1L, 0L), cast(1 + (shiftright(byte, 2 * i) & 3) as int))")
    return df.where(F.col("sample") < samples).select(*row, "sample", dosage.alias("dosage"))


def plink_cluster_alleles(z: DataFrame, medians: DataFrame) -> DataFrame:
    """(chrom, window, cluster, sample, dosage): every cluster allele of every sample, zeros included."""
    grid = medians.select("chrom", "window", "cluster").join(z.select("chrom", "window", "sample").distinct(), ["chrom", "window"])
    count = z.groupBy("chrom", "window", "cluster", "sample").agg(F.count("*").alias("n"))
    return grid.join(count, ["chrom", "window", "cluster", "sample"], "left").select("chrom", "window", "cluster", "sample", F.coalesce("n", F.lit(0)).cast("long").alias("dosage"))


def plink_bim(meta: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per cluster allele: id {chrom}_W{window}_K{cluster}_B{size}, counted from 1."""
    df = sizes.join(meta, ["chrom", "window"])
    id_ = F.format_string("%s_W%d_K%d_B%d", "chrom", F.col("window") + 1, F.col("cluster") + 1, "size")
    return df.select("chrom", id_.alias("id"), F.lit(0).cast("long").alias("cm"), F.col("start").alias("pos"), F.lit("K").alias("a1"), F.lit("0").alias("a2"))


def plink_fam(samples: DataFrame, duplicate_fid: bool = False) -> DataFrame:
    zero = F.lit(0).cast("long")
    return samples.select((F.col("iid") if duplicate_fid else F.lit("0")).alias("fid"), "iid", zero.alias("pat"), zero.alias("mat"), zero.alias("sex"), F.lit(-9).cast("long").alias("pheno"))


# --- packed files ---------------------------------------------------------------------------------

def encode_assignments(z: DataFrame) -> DataFrame:
    """(chrom, content): magic, then the clusters of window 0 by haplotype, of window 1, …; one file for
    each chromosome, so a row of that size."""
    rows = z.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("window", "hap", "cluster"))).alias("v"))
    hex_ = F.expr("array_join(transform(v, x -> lpad(hex(x.cluster), 2, '0')), '')")
    return rows.select("chrom", F.unhex(F.concat(F.lit(MAGIC.hex()), hex_)).alias("content"))


def decode_assignments(files: DataFrame, haplotypes: int) -> DataFrame:
    """(chrom, window, hap, sample, cluster) of (chrom, content)."""

    def run(it):
        for pdf in it:
            for chrom, content in zip(pdf["chrom"], pdf["content"], strict=True):
                if bytes(content[:3]) != MAGIC:
                    raise ValueError("not an assignment file")
                c = np.frombuffer(content, np.uint8, offset=3).astype(np.int64)
                i = np.arange(len(c))
                yield pd.DataFrame({"chrom": chrom, "window": i // haplotypes, "hap": i % haplotypes, "sample": i % haplotypes // 2, "cluster": c})

    return files.select("chrom", "content").mapInPandas(run, "chrom string, window long, hap long, sample long, cluster long")


def encode_medians(medians: DataFrame, size: int) -> DataFrame:
    """(chrom, content): magic, then the medians of each window, a byte per SNP."""
    df = medians.withColumn("a", F.expr(f"array_join(transform(sequence(0, {size - 1}), j -> concat('0', cast(shiftright(bits, j) & 1 as string))), '')"))
    rows = df.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("window", "cluster", "a"))).alias("v"))
    return rows.select("chrom", F.unhex(F.concat(F.lit(MAGIC.hex()), F.expr("array_join(transform(v, x -> x.a), '')"))).alias("content"))


def decode_medians(files: DataFrame, windows: DataFrame) -> DataFrame:
    """(chrom, window, cluster, j, allele); windows: (chrom, window, size, k). A window's place in the
    file is the sum of k * size of those before it."""
    before = Window.partitionBy("chrom").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    w = windows.withColumn("offset", F.coalesce(F.sum(F.col("k") * F.col("size")).over(before), F.lit(0)) + 4)
    df = w.join(files, "chrom").withColumn("cluster", F.explode(F.expr("sequence(0L, k - 1)"))).withColumn("j", F.explode(F.expr("sequence(0L, size - 1)")))
    at = F.expr("cast(offset + cluster * size + j as int)")
    return df.select("chrom", "window", "cluster", "j", F.conv(F.hex(F.substring("content", at, F.lit(1))), 16, 10).cast("long").alias("allele"))


def encode_loglik(ll: DataFrame) -> DataFrame:
    """(chrom, content): magic, then each window's matrix row by row, four bytes a value."""

    def run(it):
        for pdf in it:
            for chrom, v in zip(pdf["chrom"], pdf["v"], strict=True):
                yield pd.DataFrame({"chrom": [chrom], "content": [MAGIC + np.array([x["ll"] for x in v], "<f4").tobytes()]})

    rows = ll.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("window", "c1", "c2", "ll"))).alias("v"))
    return rows.mapInPandas(run, "chrom string, content binary")


def decode_loglik(files: DataFrame, windows: DataFrame) -> DataFrame:
    """(chrom, window, c1, c2, ll); windows: (chrom, window, k)."""
    shape = windows.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("window", "k"))).alias("w"))

    def run(it):
        for pdf in it:
            for chrom, content, w in zip(pdf["chrom"], pdf["content"], pdf["w"], strict=True):
                if bytes(content[:3]) != MAGIC:
                    raise ValueError("not a log-likelihood file")
                values, at = np.frombuffer(content, "<f4", offset=3).astype(float), 0
                for x in w:
                    k = x["k"]
                    c = np.arange(k * k)
                    yield pd.DataFrame({"chrom": chrom, "window": x["window"], "c1": c // k, "c2": c % k, "ll": values[at : at + k * k]})
                    at += k * k

    return files.join(shape, "chrom").select("chrom", "content", "w").mapInPandas(run, "chrom string, window long, c1 long, c2 long, ll double")


# --- text -----------------------------------------------------------------------------------------

def to_lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value"))


def parse_lines(lines: DataFrame, schema: str, sep: str = "\t") -> DataFrame:
    """Rows of fixed columns; lines that start with # are headers."""
    return lines.where("not startswith(value, '#')").select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def filelist_union(tables: list[DataFrame]) -> DataFrame:
    """All files with their number, as one table; every file must have the first one's samples."""
    out = None
    for i, df in enumerate(tables):
        df = df.withColumn("file", F.lit(i).cast("long"))
        if out is not None and not same_samples(tables[0], df):
            raise ValueError(f"file {i} has other samples than the first one")
        out = df if out is None else out.unionByName(df)
    return out


def same_samples(a: DataFrame, b: DataFrame) -> bool:
    ids = [x.select("sample").distinct() for x in (a, b)]
    return ids[0].exceptAll(ids[1]).union(ids[1].exceptAll(ids[0])).limit(1).count() == 0
