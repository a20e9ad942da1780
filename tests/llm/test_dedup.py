"""Near-duplicates, repeated passages and lines against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandworks.llm import components, line_dedup, minhash, pfp_dedup

SCHEMA = "doc_id long, text string"


def texts(seed, n, words=40, vocabulary=3000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i and r.random() < 0.6:
            w = list(r.choice(out))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"w{r.randrange(vocabulary)}"
        else:
            w = [f"w{r.randrange(vocabulary)}" for _ in range(r.choice([3, words, words, 4 * words]))]
        out.append(w)
    return [" ".join(w) for w in out]


def union(pairs, nodes):
    p = {n: n for n in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(data):
    sets = {i: set(minhash.shingles((t or "").encode()).tolist()) for i, t in data}
    ids = [i for i in sets if sets[i]]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, union(pairs, list(sets))


def test_shingles_are_those_of_lower_case_words():
    a = minhash.shingles(b"A b\tC d e F")
    assert len(a) == 2 and set(a) == set(minhash.shingles("a B c D E f".encode()))
    assert len(minhash.shingles(b"a b")) == 1 and len(minhash.shingles(None)) == len(minhash.shingles(b" \n")) == 0
    assert minhash.shingles("É b".encode())[0] != minhash.shingles("é b".encode())[0]


@pytest.mark.parametrize("limit", [24, 2])
def test_components_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(minhash, "LIST", limit)  # 2: nearly every list goes the way of the long ones
    data = list(enumerate(texts(1, 160))) + [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (504, " ")]
    sets, want = brute_components(data)
    got = minhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)
    stay = minhash.deduplicate(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(r.doc_id for r in stay) == sorted(i for i, c in want.items() if i == c)


def test_pairs_down_to_the_cut_of_the_index(spark):
    # the last words make the least shingles, so that leaving them out costs the sketch far more than the set
    r = random.Random(3)
    w = [f"w{r.randrange(10**6)}" for _ in range(380)]
    while len(w) < 380 + 21:
        w.append(min((f"w{r.randrange(10**6)}" for _ in range(400)), key=lambda x: minhash.shingles(" ".join([*w[-4:], x]).encode())[0]))
    a, b = " ".join(w), " ".join(w[:380])
    sa, sb = (minhash.shingles(t.encode())[: minhash.SKETCH] for t in (a, b))
    assert len(set(sa) & set(sb)) == 27 and len(w) * 0.85 < 380
    got = minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b)], SCHEMA)).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 1}


def test_long_lists_do_without_estimates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST", 1)
    monkeypatch.setattr(minhash, "ESTIMATE", 1.1)
    data = list(enumerate(texts(1, 80)))
    got = minhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert {x.doc_id: x.component_id for x in got} == brute_components(data)[1]


def test_repeated_rows_null_keys_and_empty(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], SCHEMA)
    got = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id] == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert sorted((r.doc_id or 0) for r in minhash.deduplicate(df).collect()) == [0, 1]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [24, 1])
def test_several_texts_under_one_id(spark, monkeypatch, limit):
    monkeypatch.setattr(minhash, "LIST", limit)
    r = random.Random(8)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(90)]
    data = []
    for i in range(1, 13):
        one, other = text(), text()
        data += [(i, one), (i, other), (100 + i, one[:-3]), (200 + i, other[:-3])]
    # an empty text of the same id; an id whose second text belongs to a lesser one
    one, other = text(), text()
    data += [(50, []), (50, one), (51, one[:-3]), (60, other[:-3]), (70, text()), (70, other)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in data], SCHEMA)
    got = {(x.doc_id, x.n_shingles): x.component_id for x in minhash.near_duplicates(df).collect()}
    home = {50: 50, 51: 50, 60: 60, 70: 60}
    assert got == {(i, max(0, len(w) - 4)): home.get(i, i % 100) for i, w in data}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_cut(data, k=50):
    first = {}
    bytes_ = {i: (t or "").encode() for i, t in data}
    for i in sorted(bytes_):
        for p in range(len(bytes_[i]) - k + 1):
            first.setdefault(bytes_[i][p : p + k], i)
    out = {}
    for i, b in bytes_.items():
        gone = [False] * len(b)
        for p in range(len(b) - k + 1):
            if first[b[p : p + k]] < i:
                gone[p : p + k] = [True] * k
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block, hot", [(4 << 20, 16384), (700, 16384), (700, 40), (4 << 20, 1)])
def test_substrings_against_brute_force(spark, block, hot):
    r = random.Random(6)
    passage = ["".join(r.choice("abc é") for _ in range(r.choice([49, 50, 60, 300]))) for _ in range(6)]
    data = []
    for i in range(60):
        parts = [r.choice(passage) if r.random() < 0.5 else "".join(r.choice("defgh ") for _ in range(r.randint(0, 80))) for _ in range(r.randint(0, 5))]
        data.append((i, "".join(parts)))
    data += [(100, None), (101, ""), (102, "a" * 200), (103, "a" * 49), (104, "a" * 120 + "b"), (105, "ab" * 90), (106, "x" + "ab" * 80)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in pfp_dedup.remove_repeats(spark.createDataFrame(data, SCHEMA), block=block, hot=hot).collect()}
    assert got == brute_cut(data)


def test_one_sentence_in_every_document(spark, monkeypatch):
    r = random.Random(7)
    sentence = "all rights are kept by the author of these pages and by no other body"
    data = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 70))) + sentence + "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 70)))) for i in range(250)]
    data += [(300, "ab" * 6000), (301, "b" + "ab" * 6000), (302, "a" * 9000), (303, "x" + "a" * 9000)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in pfp_dedup.remove_repeats(df, block=3000, hot=64).collect()}
    assert got == brute_cut(data)


def test_long_runs_are_cut_into_phrases():
    p = pfp_dedup.Piece([b"a" * 50_000, b"ab" * 20_000])
    assert p.windows.max() <= pfp_dedup.RUN and p.windows.sum() == 50_000 - 49 + 40_000 - 49
    ends = p.start + p.windows
    assert all(e == s or d != n for e, s, d, n in zip(ends, p.start[1:], p.doc, p.doc[1:], strict=False))


def test_substrings_odd_rows(spark):
    t = "0123456789" * 6 + "abc"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None)], SCHEMA)
    got = sorted((x.doc_id or 0, x.n_removed, x.kept) for x in pfp_dedup.remove_repeats(df, keep_text=True).collect())
    assert got == [(0, 0, b""), (0, 63, b""), (1, 0, t.encode()), (1, 0, t.encode())]
    assert pfp_dedup.remove_repeats(df.limit(0)).count() == 0


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutate(r, s, n):
    b = list(s)
    for _ in range(n):
        k, w = r.randrange(len(b) + 1), r.random()
        if w < 0.33 or not b or k == len(b):
            b.insert(k, r.choice("abé"))
        elif w < 0.66:
            del b[k]
        else:
            b[k] = r.choice("abé")
    return "".join(b)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    r = random.Random(tau)
    pairs = [(a, mutate(r, a, r.randint(0, 5))) for a in ("".join(r.choice("abé~") for _ in range(r.randint(0, 40))) for _ in range(300))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.banded_distance("a", "b", tau).alias("d")).collect()
    assert all(min(x.d, tau + 1) == min(edits(x.a, x.b), tau + 1) for x in got)


def near(x, y, tau=2):
    """Whether two different lines are linked: an edit for every three characters of the shorter one, tau at most."""
    limit = min(tau, min(len(x), len(y)) // 3)
    return x != y and abs(len(x) - len(y)) <= limit and edits(x, y) <= limit


@pytest.mark.parametrize("tau, hot", [(2, 6), (3, 64)])
def test_lines_of_every_length(spark, monkeypatch, tau, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)  # a low one: most lists are cut again
    r = random.Random(5)
    lines = set()
    for n in [*range(1, 16), 18, 21, 24, 27, 40]:
        for _ in range(4):
            x = "".join(r.choice("abcdeé") for _ in range(n))
            lines |= {x, *(mutate(r, x, k).strip() for k in (1, 1, 2, 2, 3))}
    lines = sorted(x for x in lines if x)
    want = {i: sum(near(x, y, tau) for y in lines) for i, x in enumerate(lines)}
    got = line_dedup.line_duplicates(spark.createDataFrame(list(enumerate(lines)), SCHEMA), tau=tau).collect()
    assert {x.doc_id: x.n_links for x in got} == want
    assert any(want[i] for i, x in enumerate(lines) if len(x) < 6) and any(want[i] for i, x in enumerate(lines) if len(x) > 20)


def test_lines_of_a_template(spark, monkeypatch):
    seen = []
    plain = line_dedup._pairs
    monkeypatch.setattr(line_dedup, "HOT", 16)
    monkeypatch.setattr(line_dedup, "_pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    r = random.Random(6)
    lines = sorted({f"Posted by the user on the old forum, no. {k:08d}" for k in r.sample(range(20_000), 150)} | {f"{r.randrange(24):02d}:{r.randrange(60):02d} the service answered in {r.randrange(90)} ms" for _ in range(100)})
    want = {i: sum(near(x, y) for y in lines) for i, x in enumerate(lines)}
    got = line_dedup.line_duplicates(spark.createDataFrame(list(enumerate(lines)), SCHEMA)).collect()
    assert {x.doc_id: x.n_links for x in got} == want
    links, tried = sum(want.values()) / 2, sum(x.count() for x in seen)
    assert links > 100 and tried < 0.5 * len(lines) ** 2 / 2, (links, tried)


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(24, 50))).strip() for _ in range(15)]
    data = []
    for i in range(50):
        lines = [mutate(r, r.choice(base), r.randint(0, 3)) if r.random() < 0.7 else r.choice(["short", "", "  "]) for _ in range(r.randint(0, 4))]
        data.append((i, "\n".join(lines)))
    data += [(100, None), (101, "\n\n"), (102, "short\nshort"), (103, "short ")]
    strip = lambda s: s.strip(" \t\r\x0b\x0c")
    places = [(i, k, strip(x)) for i, t in data for k, x in enumerate((t or "").split("\n")) if strip(x)]
    first = {}
    for i, k, x in places:
        first.setdefault(x, (i, k))
    links = defaultdict(set)
    for x in first:
        links[x] = {y for y in first if near(x, y)}
    want = {i: [0, 0, 0, []] for i, _ in data}
    for i, k, x in places:
        w = want[i]
        gone = first[x] < (i, k) or any(first[y] < first[x] for y in links[x])
        w[0] += 1
        w[1] += gone
        w[2] += len(links[x])
        w[3] += [k] * gone
    df = spark.createDataFrame(data, SCHEMA)
    found = line_dedup.line_duplicates(df)
    assert {x.doc_id: [x.n_lines, x.n_dropped, x.n_links, x.dropped_lines] for x in found.collect()} == want
    kept = {x.doc_id: x.text for x in line_dedup.without_dropped(df, found).collect()}
    assert kept[102] == ("" if first["short"] < (102, 0) else "short") and kept[100] is None
    assert line_dedup.line_duplicates(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], SCHEMA).withColumns({"n": F.lit(1), "id": F.lit(2), "component_id": F.lit(3)})
    assert minhash.deduplicate(df).columns == df.columns
    assert pfp_dedup.remove_repeats(df).count() == line_dedup.line_duplicates(df).count() == 1
