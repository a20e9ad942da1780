"""The registered queries as they are: against their SQL on the smallest test tables, else against brute force."""

import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from strandworks.llm import line_dedup, queries, token_counts

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@here
@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[key](spark, SF)
    rel = con.execute(queries.ORACLES[key])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    plain = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(plain(r) for r in df.collect()) == sorted(plain([r[i] for i in at]) for r in rel.fetchall())


@here
def test_quality_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality_classifier"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in labels)
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) / len(labels) > 0.9


@here
def test_page_query(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op3_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    right = 0
    for r in got:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        right += r.text == "\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)
    assert right >= 0.98 * len(got)


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_line_query_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    base = ["".join(r.choice("abcdeñ ") for _ in range(r.randint(24, 90))).strip() for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 4)):
            s = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                s[r.randrange(len(s))] = r.choice("xyzé")
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    places = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    first = {}
    for i, k, x in places:
        first.setdefault(x, (i, k))
    near = lambda x, y: x != y and edits(x, y) <= min(line_dedup.TAU, min(len(x), len(y)) // line_dedup.PER_EDIT)
    links = {x: [y for y in first if abs(len(x) - len(y)) < 3 and near(x, y)] for x in first}
    want = defaultdict(lambda: (0, 0, 0))
    for i, k, x in places:
        a, b, c = want[i]
        want[i] = (a + 1, b + (first[x] < (i, k) or any(first[y] < first[x] for y in links.get(x, []))), c + len(links.get(x, [])))
    got = queries.QUERIES["op7_line_edit_join"](spark, str(tmp_path)).collect()
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.n_links) for x in got} == {i: want[i] for i, _ in rows}
    assert sum(x.n_links for x in got) > 20


@here
def test_token_query_against_full_encoding(spark):
    count = token_counts.counter(open(token_counts.VOCABULARY, "rb").read()).bpe.encode_ordinary
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op10_token_counts"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r.doc_id]
        n = len(t)
        after = t[: n // 4] + "[REDACTED]" + t[n // 4 + 12 :]
        after = after[: n // 2] + after[n // 2 + 40 :]
        after = after[: 3 * n // 4] + f' "{t[:20]}"' + after[3 * n // 4 :]
        assert (r.n_tokens, r.n_tokens_edited) == (len(count(t)), len(count(after)))
