"""Ranked lexical search: an inverted treap per term, all of a query's treaps walked together.

A term's treap holds its postings in search order of doc_id and heap order of impact (what the term adds
to a document's score): the root of a subtree bounds the impact in its whole stretch of ids. A query starts
with the roots of its terms. The sum of their impacts bounds every document of a stretch; a stretch that
cannot enter the k best is dropped unseen, the others are split at the document of their largest impact,
which is scored, and every treap is descended to the roots of the two halves.

Documents are read twice: once as text, which leaves the occurrences of the queries' terms in a written
table, once from there. Each task builds the treaps of a bounded stretch of its postings at a time and
carries the best so far, and with them the bound, to the next.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import materialize, table

#: Results of a query; postings of the treaps that a task holds at once; stretches that are split in one step.
K, CHUNK, STEP = 10, 2_000_000, 256
#: Queries are broadcast in blocks of about so many bytes of terms; every block is a pass.
QUERY_BYTES = 16 << 20
#: Constants of the score (fixed values): length normalisation in hundredths, and the scale of a saturated count.
BASE, SHARE, SATURATION, SCALE = 100, 90, 8, 10**9

#: Bytes of terms stay, with A-Z in lower case; all others become spaces.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters and anything beyond ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


class Treaps:
    """The treaps of a stretch of postings: term and doc (places in the sorted ids) of each, and its impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        key = term.astype(np.int64) << 32 | doc
        order = np.argsort(key)
        self.key, n = key[order], len(key)
        self.doc = np.append((self.key & 0xFFFFFFFF).astype(np.int32), -1)
        self.impact = np.append(impact[order], 0)  # node -1 is no node and adds nothing
        first = np.searchsorted(self.key, np.arange(n_terms + 1, dtype=np.int64) << 32)
        held = np.flatnonzero(np.diff(first))
        lower, upper = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        lower[first[held]], upper[first[held + 1] - 1] = -1, n
        # the nearest posting of no less impact before each, and of more behind it, by jumping pointers
        own = self.impact[:n]
        self._jump(lower, lambda at: own[lower[at]] < own[at], -1)
        self._jump(upper, lambda at: own[upper[at]] <= own[at], n)
        bound = np.iinfo(np.int64).max
        a = np.where(lower >= 0, own[lower], bound)
        b = np.where(upper < n, np.append(own, bound)[upper], bound)
        left = (lower >= 0) & (a < b)  # the parent is the smaller of the two
        right = (upper < n) & ~left
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        self.right[lower[left]] = np.flatnonzero(left)
        self.left[upper[right]] = np.flatnonzero(right)
        self.root = np.full(n_terms, -1, np.int32)
        tops = np.flatnonzero(~left & ~right)
        self.root[self.key[tops] >> 32] = tops

    @staticmethod
    def _jump(to: np.ndarray, passes, end: int) -> None:
        at = np.flatnonzero(to != end)
        while len(at := at[passes(at)]):
            to[at] = to[to[at]]
            at = at[to[at] != end]

    def impacts(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """[doc, term] of every term at every document, 0 where it does not occur."""
        wanted = terms[None, :].astype(np.int64) << 32 | docs[:, None]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.impact[at], 0)

    def _within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[stretch, term]: the roots of what the subtrees hold of the documents low..high-1 of each stretch."""
        shape, nodes = nodes.shape, nodes.ravel().copy()
        low, high = np.repeat(low, shape[1]), np.repeat(high, shape[1])
        at = np.flatnonzero(nodes >= 0)
        while len(at):
            own = nodes[at]
            d = self.doc[own]
            before, behind = d < low[at], d >= high[at]
            nodes[at] = np.where(before, self.right[own], np.where(behind, self.left[own], own))
            at = at[before | behind]
            at = at[nodes[at] >= 0]
        return nodes.reshape(shape)

    def search(self, terms: np.ndarray, ids: np.ndarray, k: int, scores: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of these documents and those given, best first, equal scores by id.

        ids: of the documents, ascending.
        """
        roots = self.root[terms]
        terms, nodes = terms[roots >= 0], roots[roots >= 0][None, :]
        low, high = np.zeros(1, np.int32), np.full(1, len(ids), np.int32)  # of the stretches
        bounds = self.impact[nodes].sum(1)
        while nodes.shape[1] and len(nodes):
            if len(scores) >= k:
                open_ = (bounds > scores[-1]) | ((bounds == scores[-1]) & (ids[np.minimum(low, len(ids) - 1)] < found[-1]))
            else:
                open_ = bounds > 0
            if not open_.all():
                nodes, low, high, bounds = nodes[open_], low[open_], high[open_], bounds[open_]
                if not len(nodes):
                    break
            take = np.zeros(len(nodes), bool)
            take[np.argpartition(-bounds, STEP)[:STEP] if len(nodes) > STEP else slice(None)] = True
            own, begin, end = nodes[take], low[take], high[take]
            docs = self.doc[own[np.arange(len(own)), self.impact[own].argmax(1)]]
            total = self.impacts(terms, docs).sum(1)
            scores, found = best(np.append(scores, total), np.append(found, ids[docs]), k)
            starts, stops = np.concatenate([begin, docs + 1]), np.concatenate([docs, end])
            halves = self._within(np.concatenate([own, own]), starts, stops)
            nodes, low, high = np.concatenate([nodes[~take], halves]), np.concatenate([low[~take], starts]), np.concatenate([high[~take], stops])
            bounds = np.concatenate([bounds[~take], self.impact[halves].sum(1)])
        return scores, found


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


def _query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms): the distinct terms of the rows of an id; items without terms are left out."""
    strings = T.StructField("text", T.ArrayType(T.BinaryType()))
    own = items.select(items[item_id].alias("item_id"), items[text].alias("text")).where("item_id is not null")
    rows = append_columns(own, "text", [strings], lambda texts: {"text": [sorted(set(terms_of(t))) for t in texts]})
    return rows.select("item_id", F.explode("text").alias("term")).distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """The queries in lists of about QUERY_BYTES."""
    block, size = [], 0
    for row in queries.orderBy("item_id").toLocalIterator():
        block.append((row.item_id, [bytes(t) for t in row.terms]))
        size += sum(map(len, row.terms)) + 64
        if size > QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): number of terms of every text, and the places and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("n", T.LongType()), T.StructField("text", ints), T.StructField("counts", ints)]

    def kernel(texts: list[bytes | None]) -> dict:
        known, n, places, counts = shared.value, [], [], []
        for t in texts:
            words = terms_of(t)
            n.append(len(words))
            hits = [(known[w], c) for w, c in Counter(words).items() if w in known]
            places.append([p for p, _ in hits])
            counts.append([c for _, c in hits])
        return {"n": n, "text": places, "counts": counts}

    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return append_columns(own, "text", fields, kernel).select("doc_id", "n", F.col("text").alias("terms"), "counts")


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _top_of_tasks(rows: DataFrame, queries: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for every query, by its place in the list."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        none = np.zeros(0, np.int64)
        tops = [(none, none)] * len(asked)
        held: list[tuple] = []

        def settle() -> None:
            ids, n, size, term, tf = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids))
            m = BASE - SHARE + (SHARE * n * n_docs) // n_terms
            impact = weight[term] * ((SCALE * tf) // (1000 * tf + SATURATION * np.repeat(m, size)))
            some = impact > 0
            if some.any():
                treaps = Treaps(term[some], np.repeat(place, size)[some], impact[some], len(weight))
                ids = ids[order]
                for i, own in enumerate(asked):
                    tops[i] = treaps.search(own, ids, k, *tops[i])
            held.clear()

        waiting = 0
        for batch in batches:
            ids, n, terms, counts = batch.columns
            size = np.diff(terms.offsets.to_numpy())
            held.append((ids.to_numpy(), n.to_numpy(), size, terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)))
            waiting += int(size.sum())
            if waiting >= CHUNK:
                settle()
                waiting = 0
        if held:
            settle()
        item = np.repeat(np.arange(len(asked)), [len(s) for s, _ in tops])
        scores, found = (np.concatenate([none, *[t[i] for t in tops]]) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(found), pa.array(scores)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, equal scores by
    ascending id. The score is that of the contract of ``op11_ranked_search``, in 64-bit integers.

    Null and empty texts have no terms: as documents they do not count, as items they have no rows. A row without
    an id is a document that counts but cannot be named, so it is not returned; items without an id are left out,
    rows of one item id are one item. Repeated rows of documents count and are returned each. An empty table on either
    side gives no rows. Ids are integers; other columns, whatever their names, are left out. Very long texts are
    counted whole, one at a time.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(_query_terms(items, item_id, item_text)):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        rows = materialize(postings(docs, vocabulary, doc_id, text).where("n > 0"), "search-postings")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(vocabulary), np.int64)
        for place, df in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row per term of the block
            weights[place] = _weight(n_docs, df)
        named = rows.where("doc_id is not null and size(terms) > 0")
        tops = _top_of_tasks(named, [np.array([vocabulary[t] for t in terms], np.int32) for _, terms in block], weights, n_docs, n_terms, k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType)]))
        tops = materialize(tops.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), "search-tops")
        out = tops if out is None else out.unionByName(tops)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
c AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""
