"""Allele counts of calls that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "chrom string, snp long, pos long, hap long, sample long, allele long"


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet files of haplotype calls."""
    return spark.readStream.schema(CALLS).parquet(path)


def running_counts(calls: DataFrame) -> DataFrame:
    """(chrom, snp, n, ones): calls and alternative alleles seen so far; one row of state per SNP."""
    return calls.where("allele is not null").groupBy("chrom", "snp").agg(F.count("*").alias("n"), F.sum("allele").alias("ones"))


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Replace the table at ``path`` with every micro-batch's totals."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
