"""Benchmark decontamination with suffix arrays of the training texts.

Every piece of a partition (some MB of documents) is a shard. Its words become ids of the benchmark's
vocabulary; stretches of known words that are shorter than the shortest window cannot hold one and
are left out. The rest gets a suffix array by prefix doubling, and all suffixes of the benchmark are
searched in it at once, one more word per round, each round a binary search inside the range that the
words so far have left. A suffix's range at window length gives the hits, once for all suffixes that open with the same
window. The ranges of later rounds nest inside; the deepest one that holds a place of a document gives
the words that match verbatim from there, whatever else the shard holds. Shards are independent, so
nothing is shuffled and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import materialize, table

WINDOW = 10
#: The benchmark is broadcast in blocks of at most about so many bytes of text; each block is one pass.
BLOCK_BYTES = 16 << 20
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_WORD_BYTES).split()


class Benchmark:
    """Word ids of the items, one 0 after each, and where each window begins."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        ids, item, self.names = [], [], []
        self.size: list[int] = []
        for name, text in items:
            words = words_of(text)
            if words:
                ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
                item += [len(self.names)] * (len(words) + 1)
                self.names.append(name)
                self.size.append(min(window, len(words)))
        self.ids = np.array(ids or [0], np.int64)
        self.item = np.array(item or [0], np.int64)
        self.window = np.array(self.size or [1], np.int64)[self.item]
        self.shortest = min(self.size, default=0)
        ends = np.flatnonzero(self.ids == 0)
        self.longest = int(np.diff(ends, prepend=-1).max())


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``a`` (0 ends a suffix) in the order of their first ``depth`` values."""
    n = len(a)
    rank, length = np.unique(a, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        after[a == 0] = 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        length *= 2
        if new[-1] == n - 1:
            break
    return order


def search(a: np.ndarray, order: np.ndarray, bench: Benchmark):
    """(wlo, whi, ranges): every benchmark suffix's window as a range of the suffix array (empty if it does not
    occur), and (lo, hi, n) for each range of suffixes that share n words, a window at least, with the benchmark.

    A range that more words leave as it is comes once, with all of them, so ranges nest but never repeat.
    """
    m, n = len(bench.ids), len(order)
    padded = np.concatenate((a, np.zeros(1, a.dtype)))
    tests = np.concatenate((bench.ids, np.zeros(1, np.int64)))
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    wlo, whi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    ranges = [np.zeros((3, 0), np.int64)]
    active, d = np.flatnonzero(bench.ids), 0

    def leave(suffix: np.ndarray, d: int) -> None:
        suffix = suffix[bench.window[suffix] <= d]
        ranges.append(np.stack((lo[suffix], hi[suffix], np.full(len(suffix), d))))

    while len(active):
        word = tests[active + d]
        leave(active[word == 0], d)
        active, word = active[word > 0], word[word > 0]

        def bound(strict: bool, active=active, word=word, d=d):
            x, y = lo[active].copy(), hi[active].copy()
            while (open_ := x < y).any():
                mid = (x + y) >> 1
                at = np.minimum(order[np.minimum(mid, n - 1)] + d, n)
                less = (padded[at] < word) | (strict & (padded[at] == word))
                x = np.where(open_ & less, mid + 1, x)
                y = np.where(open_ & ~less, mid, y)
            return x

        x, y = bound(False), bound(True)
        found = x < y
        leave(active[~found | (x != lo[active]) | (y != hi[active])], d)
        active, x, y = active[found], x[found], y[found]
        lo[active], hi[active] = x, y
        d += 1
        done = active[bench.window[active] == d]
        wlo[done], whi[done] = lo[done], hi[done]
    return wlo, whi, np.concatenate(ranges, 1)


#: Places of ranges that are expanded at a time.
EXPANDED = 1 << 20


def longest_matches(n: int, ranges: np.ndarray) -> np.ndarray:
    """The words that each suffix of the array shares with the benchmark: those of the deepest range that holds it."""
    out = np.zeros(n, np.int64)
    ranges = np.unique(ranges, axis=1)
    lo, hi, words = ranges[:, np.argsort(ranges[2], kind="stable")]  # deeper ranges come later and replace
    part = np.cumsum(hi - lo) // EXPANDED
    for k in np.unique(part):
        some = part == k
        row, at = _expand(lo[some], hi[some])
        out[at] = words[some][row]
    return out


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the ranges lo..hi-1, one after the other."""
    n = hi - lo
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def find(texts: list[bytes | None], bench: Benchmark) -> list[tuple[int, list[tuple[int, int]], list[str], int]]:
    """(words, merged hit spans [start, end), items with occurring windows, longest match) of every text."""
    get = bench.vocabulary.get
    parts, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    out = [(n, [], [], 0) for n in counts]
    if not bench.shortest or not parts:
        return out
    ids = np.concatenate(parts)
    starts = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
    known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(known))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= bench.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return out
    _, place = _expand(begin, end + 1)  # with the 0 after each stretch
    a = ids[place]
    order = suffix_array(a, bench.longest)
    wlo, whi, ranges = search(a, order, bench)
    hit = np.flatnonzero(whi > wlo)
    if not len(hit):
        return out
    # suffixes of the benchmark that open with the same window have the same range: each window is expanded once
    windows, of = np.unique(np.stack((wlo[hit], whi[hit], bench.window[hit])), axis=1, return_inverse=True)
    row, at = _expand(windows[0], windows[1])
    where = place[order[at]]
    diff = np.zeros(len(ids) + 1, np.int64)
    np.add.at(diff, where, 1)
    np.add.at(diff, where + windows[2][row], -1)
    covered = np.concatenate(([0], (np.cumsum(diff[:-1]) > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(covered))
    spans: dict[int, list] = {}
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, s, "right") - 1)
        spans.setdefault(d, []).append((s - int(starts[d]), e - int(starts[d])))
    best = np.zeros(len(counts), np.int64)
    shared = longest_matches(len(order), ranges)
    some = np.flatnonzero(shared)
    np.maximum.at(best, np.searchsorted(starts, place[order[some]], "right") - 1, shared[some])
    # the items of a window, and of every set of windows that a text holds, are listed once
    own = np.unique(np.stack((of.ravel(), bench.item[hit])), axis=1)
    items_of = np.split(own[1], np.searchsorted(own[0], np.arange(1, windows.shape[1])))
    held = np.unique(np.stack((np.searchsorted(starts, where, "right") - 1, row)), axis=1)
    docs, first = np.unique(held[0], return_index=True)
    known: dict[bytes, list[str]] = {}
    items: dict[int, list] = {}
    for d, mine in zip(docs.tolist(), np.split(held[1], first[1:]), strict=True):
        key = mine.tobytes()
        if key not in known:
            known[key] = sorted({bench.names[i] for i in np.unique(np.concatenate([items_of[w] for w in mine])).tolist()})
        items[d] = known[key]
    return [(n, spans.get(d, []), items.get(d, []), longest) for d, (n, longest) in enumerate(zip(counts, best.tolist(), strict=True))]


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
]


def _blocks(bench: DataFrame, item: str, text: str):
    """Blocks of the benchmark, each of about BLOCK_BYTES at most."""
    bench = materialize(bench.select(bench[item].cast("string").alias("i"), bench[text].cast("binary").alias("t")), "bench")
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-(size + 32 * n) // BLOCK_BYTES))
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield blocks, sorted(((r.i if r.i is not None else "", bytes(r.t) if r.t is not None else None) for r in part.collect()), key=lambda x: x[0])


def matches(docs: DataFrame, bench: DataFrame, text: str = "text", *, item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Append n_words, hit_spans, hit_items, longest_match to every row; keeps all columns and rows.

    A span counts words, end exclusive; spans that touch or overlap are merged. Null and empty texts
    have no words and no hits; null and empty items are ignored; a null item_id is the empty string;
    rows of one item_id are one item. Every row is judged by itself: repeated rows get equal values, and
    items that share a window are all hit by it. Very long texts are searched whole, in memory proportional to
    them. Columns with the names of the appended ones are replaced. A benchmark beyond BLOCK_BYTES is searched
    block by block, the rows being written between passes.
    """
    out = docs
    for k, (blocks, items) in enumerate(_blocks(bench, item, item_text)):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items, window))

        def kernel(texts: list, shared=shared) -> dict:
            found = find(texts, shared.value)
            return {
                "n_words": [x[0] for x in found],
                "hit_spans": [[{"start": s, "end": e} for s, e in x[1]] for x in found],
                "hit_items": [x[2] for x in found],
                "longest_match": [x[3] for x in found],
            }

        before = [f"__{f.name}" for f in FIELDS]
        if k:
            out = out.withColumnsRenamed({f.name: f"__{f.name}" for f in FIELDS})
        out = append_columns(out, text, FIELDS, kernel)
        if k:
            out = out.withColumns({
                "hit_spans": _merged("concat(hit_spans, __hit_spans)"),
                "hit_items": F.sort_array(F.array_distinct(F.concat("hit_items", "__hit_items"))),
                "longest_match": F.greatest("longest_match", "__longest_match"),
            }).drop(*before)
        if blocks > 1:
            out = materialize(out, "bench-pass")
    return out


def _merged(spans: str):
    """Union of an array of spans."""
    return F.expr(
        f"aggregate(array_sort({spans}), cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> "
        "if(size(a) > 0 and element_at(a, -1).end >= x.start, concat(slice(a, 1, size(a) - 1), "
        "array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
    )


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", **names) -> DataFrame:
    """The rows without any benchmark window, with the columns of ``docs``; nulls, empties and repeats as in ``matches``:
    a text without words stays, repeated rows stay or go together, an empty benchmark removes nothing."""
    return matches(docs, bench, text, **names).where(F.size("hit_items") == 0).select(*docs.columns)


def op4_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return df.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(hit_spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
        "longest_match",
    )


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS k FROM
        (SELECT item, w, least({WINDOW}, len(w)) AS l, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS k FROM
        (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls)),
hits AS (SELECT doc_id, l, i, item FROM dw JOIN bw USING (l, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
bs AS (SELECT item, s, list_slice(w, s, len(w)) AS w, least({WINDOW}, len(w)) AS l FROM (SELECT item, w, unnest(range(1, len(w) + 1)) AS s FROM b)),
ext AS (SELECT h.doc_id, h.i, h.item, bs.w AS bw, list_slice(d.w, h.i, h.i + len(bs.w) - 1) AS dw
        FROM hits h JOIN bs ON bs.item = h.item AND bs.l = h.l AND len(bs.w) >= h.l JOIN d ON d.doc_id = h.doc_id
        WHERE array_to_string(bs.w[1:h.l], ' ') = array_to_string(d.w[h.i:h.i + h.l - 1], ' ')),
longest AS (SELECT doc_id, max(n) AS n FROM (
        SELECT doc_id, coalesce(list_min(list_filter(range(1, len(dw) + 1), lambda j: dw[j] <> bw[j])) - 1, len(dw)) AS n FROM ext) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, items.n IS NOT NULL AS contaminated, coalesce(longest.n, 0)::BIGINT AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
