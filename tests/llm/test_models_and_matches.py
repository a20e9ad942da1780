"""Boosted trees, quality scores, page extraction, benchmark matches and token counts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.llm import decontaminate, gbt, html_extract, quality_classifier, token_counts

DOCS = "doc_id long, text string"


def test_trees_learn_and_flat_arrays_agree_with_a_walk():
    r = np.random.default_rng(0)
    x = r.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = gbt.fit(x[:1500], y[:1500], trees=40, depth=3)
    assert ((m.probability(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97

    def walk(row):
        out = m.bias
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf, strict=True):
            at = 0
            for _ in range(m.depth):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            out += leaf[at - (2**m.depth - 1)]
        return out

    assert np.allclose(m.logit(x[:20]), [walk(row) for row in x[:20]])
    assert gbt.fit(x, np.ones(2000)).probability(x[:2]).min() > 0.99
    assert gbt.fit(x[:0], y[:0]).probability(x[:1])[0] == 0.5


def test_quality_scores(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(80)) + ".") for i in range(0, 300, 2)]
    bad = [(i, " ".join(word() + "$$$" for _ in range(80))) for i in range(1, 300, 2)]
    docs = spark.createDataFrame(good + bad + [(900, None), (901, "")], DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 302 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert all(x.predicted == 1 - x.doc_id % 2 for x in got if 200 <= x.doc_id < 300)
    same = quality_classifier.train(docs.repartition(5), labels)
    assert np.array_equal(same.leaf, model.leaf)
    empty = quality_classifier.train(docs.limit(0), labels)
    assert quality_classifier.score(docs.limit(0), empty).count() == 0


def test_held_out(spark):
    import zlib

    got = spark.range(50).select("id", quality_classifier.held_out(F.col("id")).alias("h")).collect()
    assert all(x.h == (zlib.crc32(str(x.id).encode()) % 3 == 1) for x in got)


PAGE = """<html><head><title>no</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav><div class="ad-box">Buy now, it is cheap.</div>
<article><h1>A   title &amp; more</h1><p><b>First &lt;part&gt;<br>goes on and on, with several words in it.<p>Second&nbsp;one, long enough to be prose; it has words.</p>
<script>no()</script><ul><li>item one of the list</li><li>item two of the list</ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>First! What a great text.</p></div></section>
<form><label>Mail</label><input name=q><button>Go</button></form><footer>&copy; 2020 Some Site. All rights reserved.</footer>"""


def test_pages():
    model = html_extract.train()
    want = "A title & more\nFirst <part> goes on and on, with several words in it.\nSecond one, long enough to be prose; it has words.\nitem one of the list\nitem two of the list"
    assert html_extract.extract([PAGE, "", None], model) == [want, "", ""]
    for odd in ("<", "<p", "</p>", "<!--", "<p><p><div></p>x", "<a " * 2000, "<div>" * 3000 + "deep", '<p class="x', "&#xZZ; &amp", "<script>x"):
        html_extract.extract([odd], model)


def test_extraction_held_out_accuracy():
    model = html_extract.train()
    right = total = 0
    for page in html_extract.example_pages(120, seed=77):
        nodes, texts = html_extract.blocks_of(html_extract.parse(page))
        bad = [False] * len(nodes)
        for i, x in enumerate(nodes):
            bad[i] = i > 0 and bad[x.parent.index] or "data-b" in x.attrs
            x.attrs = x.attrs.replace(" data-b", "")
        kept = html_extract.keep(nodes, model.logit(html_extract.node_features(nodes, texts)))
        assert all(kept[x.parent.index] for i, x in enumerate(nodes) if i and kept[i])
        right += sum(kept[n.index] != bad[n.index] for n, _, _ in texts)
        total += len(texts)
    assert right / total > 0.98


def test_decoding_is_the_best_closed_set():
    r = random.Random(3)
    for _ in range(200):
        nodes = [html_extract.Node("html", "", None)]
        nodes[0].index = 0
        for i in range(1, 8):
            n = html_extract.Node("div", "", nodes[r.randrange(i)])
            n.index = i
            nodes.append(n)
        s = np.array([r.uniform(-1, 1) for _ in nodes])
        best = max(sum(s[i] for i in range(1, 8) if m >> i & 1) for m in range(1, 256, 2) if all(m >> nodes[i].parent.index & 1 for i in range(1, 8) if m >> i & 1))
        assert s[1:][html_extract.keep(nodes, s)[1:]].sum() == pytest.approx(best)


def test_main_text_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (3, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text) > 100
    assert html_extract.main_text(df.limit(0)).count() == 0


def words(t):
    return decontaminate.words_of((t or "").encode())


def brute(docs, items, w=10):
    out = {}
    for i, t in docs:
        d, hit, names = words(t), set(), set()
        for name, text in items:
            b = words(text)
            n = min(w, len(b))
            for k in range(len(b) - n + 1) if b else ():
                for p in range(len(d) - n + 1):
                    if d[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(name))
        out[i] = (len(d), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_benchmark_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # 300: several passes
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("ab") * r.randint(1, 3) for _ in range(n))
    items = [(i, text(r.choice([0, 3, 9, 10, 11, 25]))) for i in range(25)] + [(90, None), (91, "A-b, É!"), (3, text(12))]
    docs = []
    for i in range(60):
        parts = [text(r.randint(0, 12)) for _ in range(2)]
        if r.random() < 0.6:
            parts.insert(1, (r.choice(items)[1] or "").upper())
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "x a b É y")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, bench).collect()
    want = brute(docs, items)
    assert {x.doc_id: (x.n_words, sum(s.end - s.start for s in x.hit_spans), x.hit_items) for x in got} == want
    assert all(x.longest_match >= 1 if x.hit_items else x.longest_match == 0 for x in got)
    assert sorted(x.doc_id for x in decontaminate.decontaminate(df, bench).collect()) == sorted(i for i, v in want.items() if not v[2])
    assert decontaminate.matches(df, bench.limit(0)).where("size(hit_items) > 0").count() == 0
    assert decontaminate.matches(df.limit(0), bench).count() == 0


def test_suffix_array_and_longest_match():
    r = random.Random(2)
    a = np.array([r.choice([0, 1, 2, 3]) for _ in range(300)] + [0])
    order = decontaminate.suffix_array(a, 64)
    cut = [tuple(a[i : i + list(a[i:]).index(0)]) for i in order]
    assert cut == sorted(cut)
    b = decontaminate.Benchmark([("x", b"a b c d e f g h i j k l m")])
    assert [(x[0], x[2], x[3]) for x in decontaminate.find([b"z A b c d e f g h i j k l n", b"a b c", None], b)] == [(14, ["x"], 12), (3, [], 0), (0, [], 0)]


def test_longest_match_is_each_documents_own():
    quoted = [f"w{i}" for i in range(40)]
    b = decontaminate.Benchmark([("x", " ".join(quoted).encode())])
    cuts = [(0, 30), (0, 12), (5, 40), (5, 15), (20, 29)]
    texts = [" ".join(["no", *quoted[i:j], "no"]).encode() for i, j in cuts]
    together = decontaminate.find(texts, b)
    assert [x[3] for x in together] == [30, 12, 35, 10, 0]
    assert together == [decontaminate.find([t], b)[0] for t in texts]

    r = random.Random(4)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n)).encode()
    items = [(str(i), text(r.choice([3, 9, 10, 14, 30]))) for i in range(8)]
    texts = [b" c ".join([text(r.randint(0, 15)), items[r.randrange(8)][1][: 2 * r.randint(1, 30)]]) for _ in range(40)]

    def longest(d):
        out = 0
        for w in (decontaminate.words_of(t) for _, t in items):
            for i in range(len(d)):
                for j in range(len(w)):
                    n = 0
                    while i + n < len(d) and j + n < len(w) and d[i + n] == w[j + n]:
                        n += 1
                    out = max(out, n if n >= min(10, len(w)) else 0)
        return out

    got = decontaminate.find(texts, decontaminate.Benchmark(items))
    assert [x[3] for x in got] == [longest(decontaminate.words_of(t)) for t in texts]


def test_trees_of_pieces_count_like_full_encoding():
    count = token_counts.counter(open(token_counts.VOCABULARY, "rb").read())
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "1", "'s", "'", " the", "é", "!", "\t", "日本", "don't"]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, r.choice([3, 40, 900]))))
        tree = token_counts.PieceTree(t, count)
        for _ in range(r.randint(1, 6)):
            s = r.randint(0, len(t))
            e, new = min(len(t), s + r.choice([0, 1, 3, 50])), "".join(r.choice(parts) for _ in range(r.choice([0, 1, 8])))
            t = t[:s] + new + t[e:]
            tree.edit(s, e, new)
            assert tree.text() == t and tree.n_tokens == len(count.bpe.encode_ordinary(t)) and tree.n_chars == len(t)
        at = r.randint(0, len(t))
        pieces = token_counts._SPLIT.findall(t)
        upto = [p for k, p in enumerate(pieces) if sum(map(len, pieces[: k + 1])) <= at]
        assert tree.tokens_before(at) == sum(count.all(upto)) or at >= len(t)


def test_edited_counts_rows(spark):
    text = "The quick brown fox. " * 200
    edit = lambda *e: [dict(zip(("start", "end", "new"), x, strict=True)) for x in e]
    rows = [(1, text, edit((10, 14, "X"), (-5, 0, "A "), (10**6, 10**7, " end"))), (2, None, None), (3, "", edit((0, 5, "new"))), (4, "abc", [None]), (5, "a b", edit((None, None, None)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    got = {r.doc_id: r for r in token_counts.edited_counts(df.withColumn("n_tokens", F.lit("clash")), digest=True).collect()}
    count = token_counts.counter(open(token_counts.VOCABULARY, "rb").read()).bpe.encode_ordinary
    after = text[:10] + "X" + text[14:]
    after = "A " + after + " end"
    assert got[1].n_tokens == len(count(text)) and got[1].n_tokens_edited == len(count(after)) and got[1].edited_sha256 == hashlib.sha256(after.encode()).hexdigest()
    assert got[1].n_reencoded < 40 < got[1].n_pieces
    assert (got[2].n_tokens, got[2].n_tokens_edited, got[3].n_tokens_edited, got[4].n_tokens_edited) == (0, 0, 1, len(count("abc")))
    assert token_counts.edited_counts(df.limit(0)).count() == 0
    with pytest.raises(OSError):
        token_counts.edited_counts(df, vocabulary="/nowhere")


def test_stored_trees_take_batch_after_batch(spark, tmp_path, monkeypatch):
    count = token_counts.counter(open(token_counts.VOCABULARY, "rb").read()).bpe.encode_ordinary
    r = random.Random(9)
    parts = ["word ", "a", " ", "  ", "\n", "1", "'s", " the", "é", "!", "日本 ", "don't "]
    now = {i: "".join(r.choice(parts) for _ in range(r.choice([0, 5, 3000]))) for i in range(12)} | {100: None}
    docs = spark.createDataFrame(list(now.items()), "doc_id long, text string").withColumns({"c0": F.lit("own"), "__text": F.lit(1)})
    token_counts.trees(docs).write.parquet(str(tmp_path / "store0"))
    for batch in range(3):
        wanted = []
        for i, t in now.items():
            if t is None or i % 3 == batch:
                continue  # most documents keep their trees untouched
            s, e, new = sorted([r.randint(0, len(t)), r.randint(0, len(t)) if batch else 0]) + ["".join(r.choice(parts) for _ in range(r.choice([0, 4, 600])))]
            now[i] = t[:s] + new + t[e:]
            wanted.append((i, [(s, e, new)]))
        edits = spark.createDataFrame(wanted, "doc_id long, edits array<struct<start:int,end:int,new:string>>")
        store = spark.read.parquet(str(tmp_path / f"store{batch}")).drop("n_reencoded").join(edits, "doc_id", "left")
        token_counts.edited(store).write.parquet(str(tmp_path / f"store{batch + 1}"))
        got = {x.doc_id: x for x in spark.read.parquet(str(tmp_path / f"store{batch + 1}")).withColumn("n", token_counts.total("tree", "tokens")).collect()}
        assert {i: x.text for i, x in got.items()} == now
        assert all(x.n == len(count(now[i] or "")) and x.c0 == "own" for i, x in got.items())
        assert all(got[i].n_reencoded == 0 for i in now if i % 3 == batch)


def test_items_that_open_alike_are_searched_once():
    """Thousands of items and texts with one opening: work by window, not by pairs of items and places."""
    import resource
    import time

    opening = " ".join(f"o{i}" for i in range(10))
    items = [(f"i{i:04d}", f"{opening} a{i} b{i}".encode()) for i in range(3000)]
    texts = [f"{opening} c{i} a{i}".encode() for i in range(3000)]
    bench = decontaminate.Benchmark(items)
    before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    got = decontaminate.find(texts, bench)
    assert time.perf_counter() - t < 6 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    names = [i for i, _ in items]
    assert all(x == (12, [(0, 10)], names, 10) for x in got)
    assert all(x[2] is got[0][2] for x in got)  # the list of a set of windows is made once


def test_repeated_rows_and_a_very_long_text_get_their_own_hits(spark):
    quoted = " ".join(f"q{i}" for i in range(12))
    long = "word " * 1_000_000 + quoted + " tail" * 500_000
    docs = spark.createDataFrame([(1, quoted), (1, quoted), (2, long), (3, "clean")], DOCS)
    bench = spark.createDataFrame([(1, quoted), (1, quoted), (2, quoted + " more")], "item_id long, text string")
    got = sorted((x.doc_id, x.n_words, [tuple(s) for s in x.hit_spans], x.hit_items, x.longest_match) for x in decontaminate.matches(docs, bench).collect())
    one = (1, 12, [(0, 12)], ["1", "2"], 12)
    assert got == [one, one, (2, 1_500_012, [(1_000_000, 1_000_012)], ["1", "2"], 12), (3, 1, [], [], 0)]
