"""Filter interaction audit: what every order of a set of filters removes at every step, by part and label.

A document is a mask of the filters that it fails. A table that is made once gives, for every mask and
every order, the step at which the document is removed, so that no order is ever run: each task looks its
documents up, counts by part, order and step, and the tasks' arrays of counts are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import materialize, small_join, table

#: The filters by letter; bit i of a mask is the i-th one. A: few words, B: few distinct words, C: many capitals,
#: D: symbols, E: the text of a smaller id.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Limits of the filters: words, distinct words and capitals in a hundred.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS, CAPITALS = b"#$%&*|", bytes(range(65, 91))
_INNER_BYTES = bytes(range(0x80, 0xC0))  # all but the first byte of a code point


def first_failures(filters: str = FILTERS) -> np.ndarray:
    """[mask, order]: the step (from 0) at which the order removes a document of that mask; the number of
    filters, if it removes none."""
    orders = np.array([[filters.index(x) for x in order] for order in permutations(filters)])
    fails = (np.arange(1 << len(filters))[:, None, None] >> orders) & 1  # mask, order, step
    return np.where(fails.any(2), fails.argmax(2), len(filters))


def text_mask(text: bytes) -> int:
    """The filters but E that a text fails."""
    words = text.split()  # of bytes: at the six ASCII white spaces
    points = len(text.translate(None, _INNER_BYTES))
    few = len(words) < LEAST_WORDS
    poor = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points
    odd = len(text.translate(None, SYMBOLS)) < len(text)
    return few | poor << 1 | loud << 2 | odd << 3


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: the filters that it fails.

    A null text is empty, a null part the empty string. E compares the texts of the whole table by a 256-bit
    digest: a row fails it if an equal text has a smaller id. A null id is smaller than none and has no smaller
    one; rows of one id and text pass or fail E together. Texts of any length are judged whole, one at a time.
    An empty table gives no rows; other columns are left out.

    The first id of every text meets the rows on the id, so a text with very many copies is no hot key; the
    ids of copies are combined in each task before they are shuffled.
    """
    fields = [T.StructField("mask", T.IntegerType()), T.StructField("text", T.BinaryType())]  # the digest takes the text's place

    def kernel(texts: list[bytes | None]) -> dict:
        plain = [t or b"" for t in texts]
        return {"mask": [text_mask(t) for t in plain], "text": [hashlib.sha256(t).digest() for t in plain]}

    own = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[part], F.lit("")).alias("part"), docs[text].alias("text"))
    rows = append_columns(own, "text", fields, kernel).select("doc_id", "part", "mask", F.col("text").alias("digest"))
    rows = materialize(rows, "filter-masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.groupBy("doc_id").agg(F.collect_list("digest").alias("firsts"))  # an id that repeats has several texts
    copy = F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("firsts", F.col("digest")), F.lit(False))
    return rows.join(first, "doc_id", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def audit(rows: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every
    part, order and step, zeros included, of rows (part, mask, good, toxic).

    kept: rows after the step; removed: rows that it removes; redundant: rows that fail its filter but were
    removed before; unique_fails: rows that fail its filter only; good_lost and toxic_lost: removed rows with
    that flag (null: without); shapley: rows that its filter removes, over all orders. Repeated rows count each.
    """
    n, n_orders = len(FILTERS), len(ORDERS)
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    schema = "part string, place int, " + ", ".join(f"{c} long" for c in counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = first_failures()  # mask, order
        orders = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
        masks_ = np.arange(1 << n)
        # [mask, order x step] of what a document of that mask counts as
        fails = ((masks_[:, None, None] >> orders) & 1).reshape(1 << n, -1)
        steps = np.arange(n)
        gone = np.repeat(table_, n, 1)  # the step of its removal beside every step
        at = np.tile(steps, n_orders)
        kept, before = gone > at, (gone < at) & (fails == 1)
        alone = masks_[:, None] == (1 << orders).reshape(1, -1)
        sums: dict[str, np.ndarray] = {}
        cells = n_orders * (n + 1)
        for batch in batches:
            part, mask, good, toxic = (batch.column(c) for c in range(4))
            code = part.dictionary_encode()
            label = code.indices.to_numpy(zero_copy_only=False)
            mask = mask.to_numpy(zero_copy_only=False)
            flags = [np.ones(len(mask), bool)] + [f.fill_null(False).to_numpy(zero_copy_only=False) for f in (good, toxic)]
            for k, name in enumerate(code.dictionary.to_pylist()):
                here = label == k
                out = sums.setdefault(name, np.zeros((len(counts), n_orders * n), np.int64))
                by_mask = np.bincount(mask[here], minlength=1 << n)
                for row, flag in zip((1, 4, 5), flags, strict=True):
                    # the step of removal of every row in every order, counted by order and step
                    found = np.bincount(mask[here & flag], minlength=1 << n)
                    place = np.arange(n_orders) * (n + 1) + table_
                    removed = np.bincount(place.ravel(), np.repeat(found, n_orders), cells).astype(np.int64)
                    out[row] += removed.reshape(n_orders, n + 1)[:, :n].ravel()
                for row, what in ((0, kept), (2, before), (3, alone)):
                    out[row] += by_mask @ what.astype(np.int64)
        for name, out in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * out.shape[1], pa.string()), pa.array(np.arange(out.shape[1]), pa.int32()), *map(pa.array, out)], names=["part", "place", *counts])

    partial = rows.select(F.coalesce("part", F.lit("")).alias("part"), "mask", F.col("good").cast("boolean").alias("good"), F.col("toxic").cast("boolean").alias("toxic")).mapInArrow(run, schema)
    total = partial.groupBy("part", "place").agg(*[F.sum(c).alias(c) for c in counts])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.expr(f"place div {n}") + 1).cast("int"))
    out = total.withColumn("filter_order", order).withColumn("step", (F.col("place") % n + 1).cast("int"))
    by_filter = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return out.withColumn("shapley", F.sum("removed").over(by_filter)).select("part", "filter_order", "step", *counts, "shapley")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``good`` (a label row of their id says quality 1) and ``toxic`` (one says toxic 1); without labels
    neither. Repeated labels count once, null ids and values never."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return small_join(rows.select("doc_id", "part", "mask"), materialize(flags, "filter-labels"), ["doc_id"])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all documents, by language."""
    return audit(labelled(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS dd,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': dd, 'E': e} AS fails, a::INT + b::INT + c::INT + dd::INT + e::INT AS n_fails,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
r AS (SELECT part, filter_order, n, n_fails, good, toxic, list_transform(string_split(filter_order, ''),
  lambda y: CASE y WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS hit FROM m, o),
g AS (SELECT *, coalesce(list_position(hit, true), 6) AS gone FROM r),
c AS (SELECT part, filter_order, step::INT AS step, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN hit[step] AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN hit[step] AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN gone = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, substring(filter_order, step, 1))::BIGINT AS shapley FROM c
"""
