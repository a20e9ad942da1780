"""Sharding by extendible hashing: only buckets over the byte limit split on another hash bit.

DataFrame operations only. The hash is 60 bits of md5 over the key, so a bucket is a prefix of
bits. One pass makes a narrow (hash, bytes) table; it is summed per *fine* prefix (a few bits more
than an even split would need), the sums are rolled up to every shorter prefix, and each fine prefix
takes the shortest prefix that fits. Fine buckets that still do not fit go through the same step
with further bits, so a stubborn corner of the hash space never deepens the rest of the directory.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import hash60, materialize, numbered, small_join, staying, table

BITS = 60
#: Bits of one directory level at most: 65,536 prefixes, whose table is a few MB.
LEVEL_BITS = 16
#: Byte limit of a shard in the registered query and the pipeline.
SHARD_BYTES = 16 << 20


def _prefix(hash_col, bits):
    return F.expr(f"shiftright({hash_col}, {BITS} - ({bits}))")


def _level(sizes: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """(fine, depth, leaf, shard_bytes, shard_docs, settled) for the prefixes of base + bits bits."""
    fine = materialize(
        sizes.groupBy(_prefix("__h", base + bits).alias("fine")).agg(
            F.sum("__b").alias("b"), F.count("*").alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi")
        ),
        "shard-fine",
    )
    nodes = fine.select("*", F.explode(F.sequence(F.lit(base), F.lit(base + bits))).alias("depth")).withColumn(
        "leaf", F.expr(f"shiftright(fine, {base + bits} - depth)")
    )
    sums = materialize(
        nodes.groupBy("depth", "leaf").agg(
            F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ).where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).drop("lo", "hi"),
        "shard-sums",
    )
    best = small_join(nodes.select("fine", "depth", "leaf"), sums, ["depth", "leaf"], "inner").groupBy("fine").agg(
        F.min(F.struct("depth", "leaf", "shard_bytes", "shard_docs")).alias("s")
    )
    return materialize(
        small_join(fine.select("fine"), materialize(best, "shard-best"), ["fine"], "left").select("fine", "s.*"), "shard-level"
    )


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = SHARD_BYTES) -> DataFrame:
    """Append n_bytes, shard_id, shard_depth, shard_bytes, oversized to every row; keeps all columns.

    shard_id is ``b`` and the bits of the bucket's prefix (``b`` alone: the whole hash space fits).
    Rows of one key always share a shard. Null texts have 0 bytes; a null key hashes as the empty
    string. A bucket that holds a single hash value (one key, or copies of it) cannot split: it is
    kept whole and, if it is beyond the limit, marked ``oversized``; so is a text beyond the limit, of
    which only the length is read. Repeated rows count each with their bytes. An empty table stays empty.
    Input columns with the names of the appended ones are replaced.
    """
    keep = staying(docs, ["n_bytes", "shard_id", "shard_depth", "shard_bytes", "oversized"])
    docs, at = numbered(docs)
    docs = docs.withColumns({"__h": hash60(F.col(at(key))), "n_bytes": F.coalesce(F.octet_length(F.col(at(text))), F.lit(0)).cast("long")})
    sizes = materialize(docs.select("__h", F.col("n_bytes").alias("__b")), "shard-sizes")
    total = sizes.agg(F.coalesce(F.sum("__b"), F.lit(0))).first()[0]
    bits = min(LEVEL_BITS, max(3, math.ceil(math.log2(max(1, total / max_bytes))) + 4))
    out = docs.withColumn("__s", F.lit(None).cast("struct<depth:int,leaf:bigint,shard_bytes:bigint,shard_docs:bigint>"))
    base, left = 0, sizes
    while True:
        level = _level(left, base, bits, max_bytes)
        settled = level.where("depth is not null").select(
            F.col("fine").alias("__fine"), F.struct("depth", "leaf", "shard_bytes", "shard_docs").alias("__t")
        )
        out = (
            small_join(out.withColumn("__fine", _prefix("__h", base + bits)), settled, ["__fine"])
            .withColumn("__s", F.coalesce("__s", "__t"))
            .drop("__t", "__fine")
        )
        open_ = level.where("depth is null").select(F.col("fine").alias("__fine"))
        if open_.limit(1).count() == 0:
            break
        left = materialize(
            small_join(left.withColumn("__fine", _prefix("__h", base + bits)), open_, ["__fine"], "left_semi").drop("__fine"),
            "shard-left",
        )
        base, bits = base + bits, min(8, BITS - base - bits)
    s = F.col("__s")
    return out.select(
        *[F.col(at(c)).alias(c) for c in keep],
        "n_bytes",
        F.concat(F.lit("b"), F.when(s.depth > 0, F.lpad(F.bin(s.leaf), s.depth, F.lit("0"))).otherwise(F.lit(""))).alias("shard_id"),
        s.depth.alias("shard_depth"),
        s.shard_bytes.alias("shard_bytes"),
        (s.shard_bytes > max_bytes).alias("oversized"),
    )


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: shard_id, shard_depth, docs and bytes."""
    return sharded.groupBy("shard_id", "shard_depth").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard; rows of a shard meet in one task, which holds at most the byte limit."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their shard (doc_id, n_bytes, shard_id, shard_depth, shard_bytes, oversized)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).drop("text")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
nodes AS (
  SELECT depth, h >> ({BITS} - depth) AS leaf, sum(n_bytes) AS shard_bytes, min(h) AS lo, max(h) AS hi
  FROM d, (SELECT unnest(range(0, 41)) AS depth) GROUP BY ALL),
fit AS (SELECT * FROM nodes WHERE shard_bytes <= {SHARD_BYTES} OR lo = hi),
ranked AS (
  SELECT d.doc_id, d.n_bytes, f.depth, f.leaf, f.shard_bytes,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY f.depth) AS r
  FROM d JOIN fit f ON f.leaf = d.h >> ({BITS} - f.depth))
SELECT doc_id, n_bytes, 'b' || CASE WHEN depth > 0 THEN lpad(bin(leaf), CAST(depth AS INTEGER), '0') ELSE '' END AS shard_id,
       CAST(depth AS INTEGER) AS shard_depth, CAST(shard_bytes AS BIGINT) AS shard_bytes,
       shard_bytes > {SHARD_BYTES} AS oversized
FROM ranked WHERE r = 1
"""
