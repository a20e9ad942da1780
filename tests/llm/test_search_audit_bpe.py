"""Ranked search, the filter audit and byte-level encoding against plain versions of the same."""

import base64
import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandworks.llm import byte_bpe, filter_audit, pretokens, queries, ranked_search, token_counts
from strandworks.llm.token_counts import PATTERN, VOCABULARY

DOCS = "doc_id long, text string"


# --- ranked search ---

def plain_search(docs, items, k=10):
    terms = [(i, ranked_search.terms_of((t or "").encode())) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(ranked_search.terms_of((text or "").encode()))
    out = []
    for item, asked in wanted.items():
        rows = []
        for i, t in terms:
            if not t or i is None:
                continue
            tf, m = Counter(t), 10 + (90 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in asked if w in tf)
            if s > 0:
                rows.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_terms():
    assert ranked_search.terms_of("A-b_C é9É x\x7fy".encode()) == ["a".encode(), b"b", b"c", "é9É x".encode(), b"y"]
    assert ranked_search.terms_of(None) == ranked_search.terms_of(b" .") == []


@pytest.mark.parametrize("chunk, step", [(2_000_000, 256), (50, 1), (300, 7)])
def test_search_equals_brute_force(spark, monkeypatch, chunk, step):
    monkeypatch.setattr(ranked_search, "CHUNK", chunk)
    monkeypatch.setattr(ranked_search, "STEP", step)
    r = random.Random(chunk)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 400}"
    docs = [(r.randint(0, 10**12), " ".join(word() for _ in range(r.randint(1, 60)))) for _ in range(400)]
    docs += [(i, docs[0][1]) for i in range(1000, 1060)]  # equal scores
    docs += [docs[5], docs[5]]  # repeated rows
    docs += [(7001, None), (7002, ""), (7003, " .;"), (None, "w1 w2 w3"), (7004, "w1 " * 5000)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 25)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "zzz"), (None, "w1"), (103, "w1"), (103, "w2 W2"), (104, docs[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(ranked_search.search(df, asked)) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == ranked_search.search(docs, items.limit(0)).count() == 0


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 150)
    docs = [(i, f"a b{i % 5} c{i % 7} d{i}") for i in range(50)]
    items = [(f"q{i}", f"a b{i} c{i} d{i} nothing") for i in range(9)]
    got = rows_of(ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id string, text string"), k=3))
    assert got == plain_search(docs, items, 3)


def test_treaps_are_heaps_in_search_order_and_prune():
    r = np.random.default_rng(3)
    n = 4000
    doc = np.tile(np.arange(n, dtype=np.int32), 3)
    term = np.repeat(np.arange(3, dtype=np.int32), n)
    impact = r.integers(1, 50, 3 * n)
    impact[:5] += 1000
    t = ranked_search.Treaps(term, doc, impact, 4)
    assert t.root[3] == -1

    def walk(node, low, high, bound):
        if node < 0:
            return 0
        assert low <= t.doc[node] < high and t.impact[node] <= bound
        return 1 + walk(t.left[node], low, t.doc[node], t.impact[node]) + walk(t.right[node], t.doc[node] + 1, high, t.impact[node])

    assert all(walk(t.root[k], 0, n, 10**9) == n for k in range(3))
    seen = []
    inner = t.impacts
    t.impacts = lambda terms, docs: (seen.extend(docs), inner(terms, docs))[1]
    none = np.zeros(0, np.int64)
    scores, found = t.search(np.arange(4, dtype=np.int32), np.arange(n), 5, none, none)
    assert sorted(found) == [0, 1, 2, 3, 4] and len(seen) == len(set(seen)) < n / 10
    assert (np.diff(scores) <= 0).all()


# --- filter audit ---

def plain_audit(rows, labels):
    """Every order applied to every row, one step after the other."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        docs.append((i, lang or "", fails))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                stay = [(i, f) for i, f in left if not f[x]]
                out[part, "".join(order), step] = [
                    len(stay), len(gone), sum(f[x] for _, f in mine) - sum(f[x] for _, f in left), sum(f[x] and sum(f.values()) == 1 for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                shapley[x] += len(gone)
                left = stay
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[x])
    return {k: tuple(v) for k, v in out.items()}


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00010, filter_audit.ORDERS.index("EDCBA")] == 3


@pytest.mark.parametrize("parts", [1, 5])
def test_audit_equals_brute_force(spark, parts):
    r = random.Random(9)
    text = lambda: " ".join(r.choice(["ab", "Cd", "EFG", "x$", "é", f"n{r.randint(0, 999)}"]) for _ in range(r.choice([3, 90, 100, 130])))
    plain = lambda: " ".join(f"n{r.randint(0, 99999)}" for _ in range(120))
    rows = [(i, text() if i % 3 else plain(), r.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(i, rows[7][1], "en") for i in range(200, 260)]  # a group of copies
    rows += [(300, None, "fr"), (301, "", "fr"), (302, "", None), (None, rows[7][1], "en"), (None, None, None), rows[7], rows[7], (7, "another text", "en"), (400, "w " * 300_000, "en"), (401, "ÄÖ " * 200, "de")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 250, 3)] + [(7, 0, 1), (7, 1, None), (8, None, None), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(i, t, g, "x") for i, t, g in rows], "doc_id long, text string, lang string, mask string").repartition(parts)
    got = filter_audit.audit(filter_audit.labelled(filter_audit.masks(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.labelled(filter_audit.masks(docs.limit(0)), labels)).count() == 0
    got = filter_audit.audit(filter_audit.labelled(filter_audit.masks(docs), labels)).collect()
    assert len(got) == 600 and sum(x.removed for x in got) == 120 and all(x.good_lost == 0 for x in got)


# --- byte-level encoding ---

RANKS = open(VOCABULARY, "rb").read()
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
CODEC = byte_bpe.codec(RANKS)
ODD = st.text(st.one_of(st.sampled_from("'stmdrevl  \n\t 　 aé9²中😀.,!_́‍"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_ids_are_the_library_s(texts):
    ids, counts = CODEC.encode([t.encode() for t in texts])
    assert ids.tolist() == [x for t in texts for x in LIBRARY.encode_ordinary(t)]
    assert counts.tolist() == [len(LIBRARY.encode_ordinary(t)) for t in texts]
    assert CODEC.decode(ids) == "".join(texts).encode()


@pytest.mark.parametrize("window, block", [(5, 2), (64, 8), (1000, 128)])
def test_windows_and_blocks(monkeypatch, window, block):
    monkeypatch.setattr(pretokens, "WINDOW", window)
    monkeypatch.setattr(pretokens, "BLOCK", block)
    r = random.Random(window)
    for _ in range(60):
        text = "".join(r.choice(["'s", "'ll", "'", " ", "  ", "\n", "a" * r.randint(1, 9), "12", "!!", "é", " " * 20, "x'"]) for _ in range(r.randint(0, 120)))
        ids, _ = CODEC.encode([text.encode(), b"", text.encode()])
        assert ids.tolist() == 2 * LIBRARY.encode_ordinary(text)


def test_encode_decode_and_spans(spark):
    texts = [None, "", "It's  a test\n\n of what we'll see", "中文 😀😀 naïve", "same", "same", "x" * 3000 + " y"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs)).withColumn("piece", byte_bpe.covering("ids", "ends", F.lit(3), F.lit(9))).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        data = (text or "").encode()
        assert row.text == text and row.ids == LIBRARY.encode_ordinary(text or "") and bytes(row.decoded) == data
        assert row.ends == np.cumsum([len(CODEC.bytes[i]) for i in row.ids]).tolist()
        part = b"".join(CODEC.bytes[i] for i in row.piece.ids)
        assert part[row.piece.skip : row.piece.skip + 6] == data[3:9]
    assert byte_bpe.encode(docs.limit(0), decoded=True).count() == 0
    assert [bytes(r.decoded) for r in byte_bpe.encode(docs, decoded=True).orderBy("doc_id").collect()] == [(t or "").encode() for t in texts]


def test_very_long_text(spark):
    text = "Some wórds, and 12345 others' ends aren't here.\n" * 200_000  # 10 MB
    row = byte_bpe.encode(spark.createDataFrame([(1, text)], DOCS), decoded=True).select(F.size("ids").alias("n"), F.sha2("decoded", 256).alias("d"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("i")).first()
    ids = LIBRARY.encode_ordinary(text)
    assert (row.n, row.d, row.i) == (len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode_ordinary(d.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert tuple(got[d.doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((d.text or "").encode()))


@settings(max_examples=100, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_new_trees_are_those_of_the_split_text(texts):
    count = token_counts.counter(RANKS)
    got = token_counts._leaves(texts, count).to_pylist()
    assert got == [token_counts._rows(token_counts.PieceTree(t, count)) for t in texts]
    assert [sum(x["tokens"] for x in tree) for tree in got] == [len(LIBRARY.encode_ordinary(t)) for t in texts]


def test_long_texts_and_doubtful_letters_in_trees(monkeypatch):
    count = token_counts.counter(RANKS)
    odd = sorted(token_counts._odd())
    text = "".join(f"it's {c}x{c}9 " for c in odd[::500]) + "plain words " * 50
    monkeypatch.setattr(pretokens, "WINDOW", 90)
    got = token_counts._leaves([text, "", text], count).to_pylist()
    assert got[0] == got[2] == token_counts._rows(token_counts.PieceTree(text, count)) and got[1] == []
    assert sum(x["tokens"] for x in got[0]) == len(LIBRARY.encode_ordinary(text))
