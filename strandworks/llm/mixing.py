"""Mixing sources to target weights by Pareto order sampling.

Targets: every source gets its share of the total by weight, stops at ``max_copies`` times its size,
and the excess is shared again by weight: water-filling, solved in closed form over a table of one
row per source. Inside a source the expected copies of a document rise with its length class (again
water-filled, over one row per source and class). The whole part is allotted for certain; the
fraction p is its inclusion probability, and documents are taken in the order of random odds over
inclusion odds, u/(1-u) : p/(1-p), until the source's remaining words are used up.

The order is never sorted in whole: words are summed per (source, slice of the order), the slices are
accumulated, the one slice in which a source's target falls is sliced again, and only the slice of that
one in which the target falls is sorted, some 1 in 16 million of the order. What remains is a cut per
source, so the decision on each document is a comparison beside its text, without moving it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.llm.common import free_name, hash60, materialize, n_words, numbered, small_join, staying, table

#: Share of all words to take, weights by rank of the source, most copies of a document.
TOTAL, WEIGHTS, MAX_COPIES = 1.5, (5, 2, 1), 2
#: A document of b-bit length weighs LENGTH_BASE + b: longer documents repeat a little more often.
LENGTH_BASE = 16
#: Slices of the order, and of the slice that holds the cut; a power of two, so that both lie alike.
SLICES = 4096


def water_fill(items: DataFrame, group: list[str], weight: str, cap: str, total, order: list[str]) -> DataFrame:
    """Append ``fill``: ``total`` of each group shared by weight, never above cap, the rest reshared.

    ``total`` is a column of the group's total, at most the sum of its caps. Items of weight 0 get 0.
    In the order of cap over weight the capped items come first; the level is that of the first
    item that stays under its cap.
    """
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight))
    w = Window.partitionBy(*group).orderBy(ratio.asc_nulls_last(), *order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    df = items.withColumn("__t", total)
    df = df.withColumn("__c", F.coalesce(F.sum(cap).over(before), F.lit(0)))
    df = df.withColumn("__w", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    df = df.withColumn("__level", F.when(F.col("__w") > 0, (F.col("__t") - F.col("__c")) / F.col("__w")))
    df = df.withColumn("__free", F.coalesce(F.col("__level") <= ratio, F.lit(False)))
    df = df.withColumn("__level", F.max(F.when(F.col("__free"), F.col("__level"))).over(whole))
    fill = F.when(F.col(weight) <= 0, F.lit(0.0)).when(F.col("__free"), F.col("__level") * F.col(weight)).otherwise(F.col(cap))
    return df.withColumn("fill", fill.cast("double")).drop("__t", "__c", "__w", "__level", "__free")


def _pareto(u, p):
    return (u / (1 - u)) * ((1 - p) / p)


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *,
    total: float = TOTAL, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7,
) -> DataFrame:
    """Append size, source_size, target, copies and taken to every row; keeps all columns and rows.

    ``copies`` (0 .. max_copies) is how often the mix holds the document, ``taken`` its words times
    copies. Sources are weighed in code point order, null last. Null and word-less texts have size 0
    and are not taken. The random number of a document comes from its key and ``seed``, so reruns
    agree; rows that share key and length class are taken or left together, so a source's taken words
    end within half a document (or half such a group) of its target. A very long text is one row whose
    words are counted in the JVM. An empty table stays empty. Input columns named like appended ones are replaced.
    """
    keep = staying(docs, ["size", "source_size", "target", "copies", "taken"])
    base, at = numbered(docs)
    base = base.withColumn("size", n_words(F.col(at(text))))
    base = base.withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col(at(source))), F.lit("~")))
    base = base.withColumn("__null", F.col(at(source)).isNull())
    base = base.withColumn("__bits", F.length(F.bin("size")))
    base = base.withColumn("__u", (F.shiftright(hash60(F.concat(F.coalesce(F.col(at(key)).cast("string"), F.lit("")), F.lit(f":{seed}"))), 8) + 0.5) / F.lit(float(1 << 52)))
    narrow = materialize(base.select(F.col(at(key)).alias("__k"), "__s", "__null", "size", "__bits", "__u"), "mix-sizes")

    classes = materialize(narrow.groupBy("__s", "__null", "__bits").agg(F.sum("size").alias("words")), "mix-classes")
    sources = classes.groupBy("__s", "__null").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("__null", "__s")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = sources.withColumn("__weight", weight).withColumn("__cap", F.lit(max_copies) * F.col("source_size"))
    sources = water_fill(sources, [], "__weight", "__cap", F.lit(total) * F.sum("source_size").over(Window.partitionBy()), ["__s"])
    sources = materialize(sources.select("__s", "source_size", F.col("fill").alias("target")), "mix-sources")

    plan = small_join(classes.drop("__null"), sources, ["__s"])
    plan = plan.withColumn("__weight", F.col("words") * (LENGTH_BASE + F.col("__bits"))).withColumn("__cap", F.lit(max_copies) * F.col("words"))
    plan = water_fill(plan, ["__s"], "__weight", "__cap", F.col("target"), ["__bits"])
    plan = plan.withColumn("__lambda", F.when(F.col("words") > 0, F.col("fill") / F.col("words")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("__whole", F.least(F.floor("__lambda"), F.lit(max_copies)).cast("long"))
    plan = plan.withColumn("__p", F.col("__lambda") - F.col("__whole"))
    plan = plan.withColumn("__rest", F.col("target") - F.sum(F.col("__whole") * F.col("words")).over(Window.partitionBy("__s")))
    plan = materialize(plan.select("__s", "__bits", "source_size", "target", "__whole", "__p", "__rest"), "mix-plan")

    def ordered(df: DataFrame) -> DataFrame:
        df = small_join(df, plan, ["__s", "__bits"])
        df = df.withColumn("__q", F.when((F.col("__p") > 0) & (F.col("size") > 0), _pareto(F.col("__u"), F.col("__p"))))
        return df.withColumn("__slice", F.floor(F.col("__q") / (1 + F.col("__q")) * (SLICES * SLICES)))

    def last_slice(rows: DataFrame, slice_, words: str) -> DataFrame:
        """(source, __cut, __before): the last slice that begins within the source's words, and the words before it."""
        slices = rows.groupBy("__s", slice_.alias("__n")).agg(F.sum("size").alias("words"), F.first("__rest").alias("__rest"), F.first(F.expr(words)).alias("__from"))
        before = F.col("__from") + F.coalesce(F.sum("words").over(Window.partitionBy("__s").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        m = slices.withColumn("__before", before).where("__before <= __rest").groupBy("__s").agg(F.max(F.struct("__n", "__before")).alias("m"))
        return m.select("__s", F.col("m.__n").alias("__cut"), F.col("m.__before").alias("__before"))

    ranked = ordered(narrow).where("__q is not null")
    coarse = F.expr(f"__slice div {SLICES}")
    last = materialize(last_slice(ranked, coarse, "0L"), "mix-coarse")
    inside = small_join(ranked, last, ["__s"], "inner").where(coarse == F.col("__cut"))
    last = materialize(last_slice(inside, F.col("__slice"), "__before"), "mix-slices")
    # rows of one key and class have one place in the order, so they are one row of it
    inside = small_join(ranked, last, ["__s"], "inner").where("__slice = __cut").groupBy("__s", "__q", "__k", "__before", "__rest").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("__s").orderBy("__q", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("__mid", F.col("__before") + upto - F.col("size") / 2).where("__mid <= __rest")
    ends = inside.groupBy("__s").agg(F.max(F.struct("__q", F.col("__k").cast("string").alias("k"))).alias("__end"))
    cuts = materialize(small_join(last, materialize(ends, "mix-ends"), ["__s"]).select("__s", "__cut", F.col("__end.__q").alias("__endq")), "mix-cuts")

    out = small_join(ordered(base), cuts, ["__s"])
    more = (F.col("__slice") < F.col("__cut")) | ((F.col("__slice") == F.col("__cut")) & (F.col("__q") <= F.col("__endq")))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("__whole") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.select(*[F.col(at(c)).alias(c) for c in keep], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as its copies say; rows of no copies (null and word-less texts
    among them) are left out. Repeated rows are repeated each by its own copies."""
    i = free_name(mixed, "__i")
    return mixed.where("copies > 0").withColumn(i, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(i)


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with size, source_size, target and the words that the mix takes of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).drop("text", "source")


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 15) AS BIGINT) // 256 + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::BIGINT AS t,
              coalesce(sum(cap) OVER b, 0)::BIGINT AS c0, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS w0
       FROM s2 WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (t - c0) / w0 AS lv, (t - c0) / w0 <= cap::DOUBLE / w AS fr FROM s3),
s AS (SELECT source, source_size, CASE WHEN fr THEN max(lv) FILTER (WHERE fr) OVER () * w ELSE cap END::DOUBLE AS target FROM s4),
k0 AS (SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
k1 AS (SELECT k0.*, source_size, target, words * (16 + bits) AS w, 2 * words AS cap FROM k0 JOIN s ON k0.source IS NOT DISTINCT FROM s.source),
k2 AS (SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS c0, (sum(w) OVER (PARTITION BY source) - coalesce(sum(w) OVER b, 0))::BIGINT AS w0
       FROM k1 WHERE words > 0
       WINDOW b AS (PARTITION BY source ORDER BY cap::DOUBLE / w, bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k3 AS (SELECT *, (target - c0) / w0 AS lv, (target - c0) / w0 <= cap::DOUBLE / w AS fr FROM k2),
k4 AS (SELECT *, CASE WHEN fr THEN max(lv) FILTER (WHERE fr) OVER (PARTITION BY source) * w ELSE cap END::DOUBLE / words AS lam FROM k3),
k5 AS (SELECT *, least(floor(lam), 2)::BIGINT AS whole, lam - least(floor(lam), 2)::BIGINT AS p FROM k4),
k AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source)::BIGINT AS rest FROM k5),
o AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, whole, rest,
             CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
      LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND length(bin(d.size)) = k.bits),
c AS (SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM o)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN whole + CASE WHEN q IS NOT NULL AND upto - size / 2 <= rest THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies,
       (CASE WHEN size > 0 THEN whole + CASE WHEN q IS NOT NULL AND upto - size / 2 <= rest THEN 1 ELSE 0 END ELSE 0 END * size)::BIGINT AS taken
FROM c
"""
