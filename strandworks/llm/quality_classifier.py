"""Quality classifier: boosted histogram trees over statistics of a document's whole text.

The trees are fitted on the driver on a bounded sample of labelled rows (at most about TRAIN_ROWS,
picked by a hash of the id, so every run picks the same), then broadcast: a few hundred kB whatever
the corpus holds. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm import gbt
from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import hash60, materialize, small_join, table
from strandworks.llm.quality_rules import SPACE, SYMBOLS, UPPER, repeat_words

#: Labelled rows that the trees are fitted on, at most about; the rest of the labels is not used.
TRAIN_ROWS = 20_000
DIGITS, LOWER = b"0123456789", bytes(range(97, 123))
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CONTINUED = bytes(range(0x80, 0xC0))
HIGH = bytes(range(0x80, 0x100))
ENDS = (b".", b"!", b"?", b":", b";", b'"')


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a text; of an empty text all are 0."""
    b = text or b""
    words = b.split()
    n, size = len(words), max(1, len(b))
    count = lambda chars: len(b) - len(b.translate(None, chars))
    chars = max(1, len(b) - count(CONTINUED))
    solid = max(1, chars - count(SPACE))
    lines = [x for x in b.split(b"\n") if x.strip()]
    distinct = set(words)
    some = max(1, n)
    same = sum(map(eq, words, words[1:]))
    marked = sum(len(w) > 2 and not w[-2:].translate(None, PUNCTUATION) for w in distinct)
    return [
        float(np.log1p(n)),
        solid / some if n else 0.0,
        count(SYMBOLS) / some,
        count(UPPER) / solid,
        count(LOWER) / solid,
        count(DIGITS) / solid,
        count(HIGH) / size,
        b.count(b".") / some,
        b.count(b",") / some,
        b.count(b"!") / some,
        b.count(b"?") / some,
        b.count(b"|") / some,
        (b.count(b"@") + b.count(b"://")) / some,
        len(distinct) / some if n else 0.0,
        same / some,
        repeat_words(words) / some,
        float(np.log1p(len(lines))),
        n / max(1, len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(x.rstrip().endswith(ENDS) for x in lines) / max(1, len(lines)),
        sum(x[:1].isupper() for x in words) / some,
        sum(map(bytes.isupper, words)) / some,
        marked / max(1, len(distinct)),
        max(map(len, words), default=0) ** 0.5,
        sum(len(w) == 1 for w in words) / some,
    ]


#: Number of statistics.
WIDTH = len(statistics(None))


def features(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, WIDTH)


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int):
    """Features and labels of at most about ``limit`` labelled documents, the same on every run."""
    labels = labels.where(labels[label].isin(0, 1) & labels[key].isNotNull())
    labels = materialize(labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).groupBy("__k").agg(F.max("__y").alias("__y")), "quality-labels")
    n = labels.count()
    if n > limit:
        labels = labels.where(hash60(F.concat(F.lit("train"), F.col("__k").cast("string"))) < int((1 << 60) * limit / n))
    rows = small_join(docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")), labels, ["__k"], "inner", rows=min(n, limit) + 1)
    kernel = lambda texts: {"x": features(texts).tolist()}
    made = append_columns(rows, "__t", [T.StructField("x", T.ArrayType(T.DoubleType()))], kernel)
    got = made.groupBy("__k").agg(F.max("__y").alias("__y"), F.min("x").alias("x")).toPandas()
    got = got.assign(k=got["__k"].astype(str)).sort_values("k", kind="stable")
    return np.array(got["x"].tolist(), np.float64).reshape(-1, WIDTH), got["__y"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = TRAIN_ROWS) -> gbt.Trees:
    """Fit on the labelled documents (labels other than 0 and 1, and null ids, are ignored; of several
    labels of one id the largest counts, of several texts the one of least features)."""
    x, y = training_rows(docs, labels, key, text, label, limit)
    return gbt.fit(x, y, trees=80, depth=4)


def score(docs: DataFrame, model: gbt.Trees, text: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted; keeps all columns and rows. A null text scores as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kernel = lambda texts: {"score": shared.value.probability(features(texts)) if texts else []}
    out = append_columns(docs, text, [T.StructField("score", T.DoubleType())], kernel)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key) -> "F.Column":
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of the held-out third are never seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labels = labels.where(~held_out(labels["doc_id"]))
    model = train(docs, labels)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
