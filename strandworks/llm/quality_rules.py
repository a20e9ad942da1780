"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

One pass measures every text. Each measure is sketched as counts of log-linear bins (exact below 32,
then 32 bins per doubling: at most 1/32 off), so sketches merge by adding counts, in any order, and
are the same on every run. The quartiles of a group are drawn towards those of its language, and these
towards the corpus's, by PRIOR documents' weight each, so that a small group leans on the larger ones
and none jumps as it grows. The fences are joined back to the measured rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import materialize, small_join, staying, table

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: Base rules: fewest words, most words (in %) inside repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Weight of the quartiles one level up, in documents.
PRIOR = 50
#: Fence: the median and FENCE times the distance of the quartile on that side, which counts as half the distance of
#: the two quartiles at least (the median may coincide with one), and as the slack at least.
#: The slack is for measures that most documents of a group share, whose quartiles coincide.
FENCE = 12
#: Measure: numerator, denominator, scale, slack, also a lower fence.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, 25, False),
    "word_length": ("word_chars", "n_words", 100, 5, True),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 50, False),
    "upper": ("n_upper", "word_chars", 1000, 1, False),
}
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the text holds twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    # a quick look: equal windows have equal hashes, so no repeated hash is no repeated window
    mixed = rank * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # exact: ranks of windows of doubling length
    rank, length = rank.astype(np.int64), 1
    while length < window:
        step = min(length, window - length)
        pair = rank[: len(rank) - step] * (len(words) + 1) + rank[step:]
        rank, length = np.unique(pair, return_inverse=True)[1], length + step
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_texts(texts: list[bytes | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {f: [] for f in FIELDS}
    for b in texts:
        b = b or b""
        words = b.split()
        solid = b.translate(None, SPACE)
        lines = [x for x in b.split(b"\n") if x.strip()]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(solid.decode("utf-8", "replace")))
        out["n_symbols"].append(len(b) - len(b.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeat_words(words))
        out["n_lines"].append(len(lines))
        out["n_upper"].append(len(b) - len(b.translate(None, UPPER)))
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the base measures and base_failed; a null text counts as empty."""
    df = append_columns(docs, text, [T.StructField(f, T.LongType()) for f in FIELDS], measure_texts)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _bin(v: str) -> str:
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"{shift} * 1000 + shiftright({v}, {shift})"


def sketches(df: DataFrame) -> DataFrame:
    """Counts (__lang, __source, measure, bin, value, n) of the documents that passed the base rules.

    Two sketches merge by adding the counts of their bins; ``value`` is a bin's lower edge.
    """
    ok = df.where("not base_failed").select(
        "__lang",
        "__source",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("measure"), F.expr(f"cast({scale} * {a} div greatest({b}, 1) as bigint)").alias("v"))
            for name, (a, b, scale, _, _) in MEASURES.items()
        ])).alias("m"),
    ).select("__lang", "__source", "m.measure", "m.v")
    ok = ok.withColumn("bin", F.expr(_bin("v"))).withColumn("value", F.expr("shiftleft(bin % 1000, cast(bin div 1000 as int))"))
    return ok.groupBy("__lang", "__source", "measure", "bin", "value").agg(F.count("*").alias("n"))


def _key(c):
    return F.coalesce(F.concat(F.lit("="), c), F.lit("~"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """n, q1, q2, q3 of every measure for the given grouping of a sketch."""
    merged = sketch.groupBy(*by, "measure", "bin", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    df = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    return df.groupBy(*by, "measure").agg(
        F.first("all").alias("n"), *[F.min(F.when(4 * F.col("upto") >= i * F.col("all"), F.col("value"))).alias(f"q{i}") for i in (1, 2, 3)]
    )


def fences(sketch: DataFrame) -> DataFrame:
    """(__lang, __source) -> lo and hi of every measure, from quartiles weighed over the three levels."""
    own = quartiles(sketch, ["__lang", "__source"])
    lang = quartiles(sketch, ["__lang"]).select("__lang", "measure", F.struct("n", "q1", "q2", "q3").alias("__l"))
    all_ = quartiles(sketch, []).select("measure", F.struct("n", "q1", "q2", "q3").alias("__a"))
    df = own.join(lang, ["__lang", "measure"]).join(F.broadcast(all_), "measure")  # one row per measure
    drawn = lambda n, q, up: (n * q + PRIOR * up) / (n + PRIOR)
    df = df.withColumn("q", F.struct(*[
        drawn(F.col("n"), F.col(q), drawn(F.col("__l.n"), F.col(f"__l.{q}"), F.col(f"__a.{q}"))).alias(q) for q in ("q1", "q2", "q3")
    ]))
    slack = F.create_map(*[F.lit(x) for k, v in MEASURES.items() for x in (k, v[3])])[F.col("measure")]
    half = (F.col("q.q3") - F.col("q.q1")) / 2
    df = df.withColumn("hi", F.col("q.q2") + FENCE * F.greatest(F.col("q.q3") - F.col("q.q2"), half, slack))
    df = df.withColumn("lo", F.col("q.q2") - FENCE * F.greatest(F.col("q.q2") - F.col("q.q1"), half, slack))
    return df.groupBy("__lang", "__source").agg(
        *[F.max(F.when(F.col("measure") == k, F.struct("lo", "hi"))).alias(f"__f_{k}") for k in MEASURES]
    )


def judge(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Append kept to a measured table: false if base_failed or a measure lies outside its fence."""
    made = [*FIELDS, "base_failed"]
    rest = staying(df, [*made, "kept"])
    # the caller's columns are numbered, so that no name of this function can clash with them
    own = df.select(_key(df[lang]).alias("__lang"), _key(df[source]).alias("__source"), *[df[c].alias(f"c{i}") for i, c in enumerate(rest)], *made)
    sketch = materialize(sketches(own), "rules-sketch")
    limits = materialize(fences(sketch), "rules-fences")
    out = small_join(own, limits, ["__lang", "__source"])
    kept = ~F.col("base_failed")
    for k, (a, b, scale, _, lower) in MEASURES.items():
        v, f = F.expr(f"{scale} * {a} div greatest({b}, 1)"), F.col(f"__f_{k}")
        kept = kept & F.coalesce(v <= f.hi, F.lit(True))
        if lower:
            kept = kept & F.coalesce(v >= f.lo, F.lit(True))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *made, kept.alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", *, lang: str = "lang", source: str = "source") -> DataFrame:
    """Append the measures, base_failed and kept to every row; keeps all columns and rows.

    Null language and null source form groups of their own. A null text has no words and fails the
    base rules. The texts are measured twice, for the sketches and for the verdicts, rather than
    written in between; a very long text costs some ten times its bytes in the worker that measures it. Repeated
    rows are judged alike, each counted. An empty table stays empty. Columns with the names of the
    appended ones are replaced.
    """
    return judge(measured(docs, text), lang, source)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(materialize(measured(docs).drop("text"), "rules-measured")).drop("lang", "source")


def _sql() -> str:
    measures = " UNION ALL ".join(
        f"SELECT lang, source, '{k}' AS measure, {s} * {a} // greatest({b}, 1) AS v FROM base WHERE NOT base_failed" for k, (a, b, s, _, _) in MEASURES.items()
    )
    slack = " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in MEASURES.items())
    quart = lambda by: f"""(SELECT {by} measure, max(a)::BIGINT AS n, {', '.join(f'min(CASE WHEN 4 * u >= {i} * a THEN value END) AS q{i}' for i in (1, 2, 3))} FROM (
      SELECT *, sum(n) OVER (PARTITION BY {by} measure ORDER BY value) AS u, sum(n) OVER (PARTITION BY {by} measure) AS a FROM (
        SELECT {by} measure, value, sum(n) AS n FROM sk GROUP BY {by} measure, value)) GROUP BY {by} measure)"""  # noqa: E731
    tests = " AND ".join(
        f"coalesce({s} * {a} // greatest({b}, 1) <= max(hi) FILTER (WHERE measure = '{k}'), TRUE)"
        + (f" AND coalesce({s} * {a} // greatest({b}, 1) >= max(lo) FILTER (WHERE measure = '{k}'), TRUE)" if lower else "")
        for k, (a, b, s, _, lower) in MEASURES.items()
    )
    cols = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base0 AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.n - ln.u, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base0),
m AS ({measures}),
b AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS s FROM m),
sk AS (SELECT lang, source, measure, (v >> s) << s AS value, count(*) AS n FROM b GROUP BY ALL),
own AS {quart("lang, source,")}, lg AS {quart("lang,")}, al AS {quart("")},
q AS (SELECT o.lang, o.source, o.measure,
             [{", ".join(f"(o.n * o.q{i} + {PRIOR} * ((lg.n * lg.q{i} + {PRIOR} * al.q{i}) / (lg.n + {PRIOR}))) / (o.n + {PRIOR})" for i in (1, 2, 3))}] AS q
      FROM own o JOIN lg ON o.lang IS NOT DISTINCT FROM lg.lang AND o.measure = lg.measure JOIN al ON al.measure = o.measure),
f AS (SELECT lang, source, measure, q[2] + {FENCE} * greatest(q[3] - q[2], (q[3] - q[1]) / 2, CASE measure {slack} END) AS hi,
             q[2] - {FENCE} * greatest(q[2] - q[1], (q[3] - q[1]) / 2, CASE measure {slack} END) AS lo FROM q)
SELECT {cols}, NOT base_failed AND {tests} AS kept
FROM base LEFT JOIN f ON base.lang IS NOT DISTINCT FROM f.lang AND base.source IS NOT DISTINCT FROM f.source
GROUP BY {cols}
"""


OP6_SQL = _sql()
