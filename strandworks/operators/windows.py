"""Windows over the SNP axis. All take (chrom, snp, pos) rows, one per SNP, snp counted from 0 in a
chromosome, and return (chrom, window, snp, pos, j) with j the place inside the window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snps_of(haplotypes: DataFrame) -> DataFrame:
    return haplotypes.select("chrom", "snp", "pos").distinct()


def _m() -> "F.Column":
    return (F.max("snp").over(Window.partitionBy("chrom")) + 1).cast("long")


def _checked(df: DataFrame) -> DataFrame:
    return df.withColumn("w", F.when(F.col("w") >= 1, F.col("w")).otherwise(F.raise_error(F.lit("a chromosome has fewer SNPs than a window"))))


def fixed(snps: DataFrame, size: int) -> DataFrame:
    """Tumbling windows of ``size`` SNPs; the last one takes the remainder."""
    df = _checked(snps.withColumn("m", _m()).withColumn("w", F.expr(f"m div {size}")))
    df = df.withColumn("window", F.expr(f"least(snp div {size}, w - 1)"))
    return df.select("chrom", "window", "snp", "pos", F.expr(f"snp - window * {size}").alias("j"))


def sliding(snps: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of ``size`` SNPs every ``step``; the last one runs to the end."""
    if not 0 < step <= size:
        raise ValueError("step must be in 1..size")
    if size == 1:
        return fixed(snps, 1)
    df = _checked(snps.withColumn("m", _m()).withColumn("w", F.expr(f"cast(ceil((m - {size}) / {step}) as bigint)")))
    df = df.withColumn("hi", F.expr(f"least(snp div {step}, w - 1)"))
    df = df.withColumn("lo", F.expr(f"least(greatest(0L, cast(ceil((snp - {size} + 1) / {step}) as bigint)), w - 1)"))
    df = df.where("lo <= hi").withColumn("window", F.explode(F.expr("sequence(lo, hi)")))
    return df.select("chrom", "window", "snp", "pos", F.expr(f"snp - window * {step}").alias("j"))


def by_length(snps: DataFrame, length: int) -> DataFrame:
    """Greedy windows of at most ``length`` base pairs from their first SNP, ends included.

    Where a window opens depends on where the last one did, so each chromosome's SNP axis (not its
    haplotypes) is walked in order.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("snp", ignore_index=True)
        window, start, opened, out = -1, None, 0, []
        for k, p in enumerate(pdf["pos"].tolist()):
            if start is None or p > start + length:
                window, start, opened = window + 1, p, k
            out.append((window, k - opened))
        pdf["window"], pdf["j"] = [x for x, _ in out], [x for _, x in out]
        return pdf[["chrom", "window", "snp", "pos", "j"]]

    return snps.select("chrom", "snp", "pos").groupBy("chrom").applyInPandas(walk, "chrom string, window long, snp long, pos long, j long")


def custom(snps: DataFrame, starts: DataFrame) -> DataFrame:
    """Windows that open at the given (chrom, start) SNPs and run to the next start or the end."""
    order = Window.partitionBy("chrom").orderBy("start")
    marks = starts.select("chrom", F.col("start").alias("start"), (F.row_number().over(order) - 1).cast("long").alias("window"))
    upto = Window.partitionBy("chrom").orderBy("snp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = snps.join(marks, (snps["chrom"] == marks["chrom"]) & (snps["snp"] == marks["start"]), "left").select(snps["*"], "window", "start")
    df = df.withColumns({"window": F.last("window", True).over(upto), "start": F.last("start", True).over(upto)}).where("window is not null")
    return df.select("chrom", "window", "snp", "pos", F.expr("snp - start").alias("j"))


def meta(windows: DataFrame, k: DataFrame | None = None) -> DataFrame:
    """(chrom, window, start, end, length, size[, k])."""
    df = windows.groupBy("chrom", "window").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("size"))
    df = df.select("chrom", "window", "start", "end", (F.col("end") - F.col("start")).alias("length"), "size")
    return df if k is None else df.join(k, ["chrom", "window"])


def attach(haplotypes: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of haplotypes with their window and place; the SNP axis is the small side."""
    return haplotypes.join(windows.select("chrom", "snp", "window", "j"), ["chrom", "snp"])
