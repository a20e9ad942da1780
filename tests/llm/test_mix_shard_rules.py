"""Mixing, sharding and quality rules on small tables, odd rows included."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from strandworks.llm import mixing, quality_rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(seed=1, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        src = r.choice(["a", "a", "a", "a", "b", "c", None])
        text = r.choice([None, "", " ", " ".join(r.choice(["x", "yy", "zzz é"]) for _ in range(r.choice([1, 5, 60, 300])))])
        out.append((i, text, r.choice(["en", None]), src))
    return out + [out[5], out[5], (None, "some words here", "en", "a")]


def words(t):
    return len((t or "").encode().split())


def test_mix_meets_targets(spark):
    data = corpus()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["size"] == words(r.text) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        size[r.source] += r["size"]
        target[r.source] = r.target
        taken[r.source] += r.taken
    total, weights, caps = 1.5 * sum(size.values()), dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True)), {s: 2 * x for s, x in size.items()}
    want, free, left = {}, set(size), total
    while True:  # share, stop at the cap, share the rest again
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > caps[s]}
        if not full:
            want |= {s: level * weights[s] for s in free}
            break
        for s in full:
            want[s] = caps[s]
            left -= caps[s]
        free -= full
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 600
    again = mixing.mix(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(again)


def test_mix_copies_follow_order_not_luck(spark):
    r = mixing.mix(spark.createDataFrame([(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(200)], SCHEMA))
    assert {x.copies for x in r.collect()} <= {0, 1, 2}
    assert mixing.repeated(r).count() == r.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("op", [mixing.mix, sharding.assign_shards, quality_rules.quality_rules])
def test_empty_table_and_clashing_columns(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(1, "some words " * 20, "en", "a", 7, 8)]
    df = spark.createDataFrame(data, SCHEMA + ", extra long, size long").withColumns({"n_words": F.lit("x"), "target": F.lit(0), "n_bytes": F.lit(0), "kept": F.lit(3)})
    r = op(df).collect()
    assert len(r) == 1 and r[0].extra == 7


def test_mix_all_empty(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], SCHEMA)).collect()
    assert [(x.copies, x.taken, x.source_size) for x in got] == [(0, 0, 0)] * 2


def test_shards_fit_and_split_only_where_needed(spark):
    r = random.Random(2)
    data = [(i, "x" * r.choice([0, 10, 100, 900]), "en", "a") for i in range(500)] + [(7, "y" * 5000, "en", "a"), (None, None, None, None)]
    got = sharding.assign_shards(spark.createDataFrame(data, SCHEMA), max_bytes=4000).collect()
    assert len(got) == len(data)
    by = defaultdict(list)
    for x in got:
        assert x.n_bytes == len((x.text or "").encode())
        by[x.shard_id].append(x)
    for shard, rows in by.items():
        total = sum(x.n_bytes for x in rows)
        assert {x.shard_bytes for x in rows} == {total} and len(shard) == rows[0].shard_depth + 1
        assert total <= 4000 and not rows[0].oversized or len({x.doc_id for x in rows}) == 1
        parent = sum(x.n_bytes for x in got if x.shard_id.startswith(shard[:-1]))
        assert parent > 4000 or shard == "b"
    assert not any(a != b and b.startswith(a) for a in by for b in by)
    d = sharding.directory(spark.createDataFrame(got)).collect()
    assert sum(x.docs for x in d) == len(data)


def test_shards_deeper_than_one_level(spark):
    data = [(i, "x", "en", "a") for i in range(3000)]
    got = sharding.assign_shards(spark.createDataFrame(data, SCHEMA), max_bytes=1)
    assert got.select("shard_id").distinct().count() == 3000 and got.where("oversized").count() == 0


def brute_repeat(ws, k=8):
    seen = defaultdict(list)
    for i in range(len(ws) - k + 1):
        seen[tuple(ws[i : i + k])].append(i)
    return len({p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + k)})


def test_measures_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        ws = [r.choice("ab") * r.randint(1, 2) for _ in range(r.choice([0, 3, 8, 9, 30, 120]))]
        assert quality_rules.repeat_words([w.encode() for w in ws]) == brute_repeat(ws)
    m = quality_rules.measure_texts([None, "é# a\n\n a\né# a b".encode()])
    assert m["n_words"] == [0, 5] and m["word_chars"] == [0, 9] and m["n_symbols"] == [0, 2] and m["n_dup_lines"] == [0, 0]


def test_rules_keep_clean_and_reject_symbols(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    data = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 3}") for i in range(300)]
    data += [(1000 + i, " ".join(word() + "***" for _ in range(60)), "en", f"s{i % 3}") for i in range(20)]
    got = {x.doc_id: x.kept for x in quality_rules.quality_rules(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def test_rules_equal_sql_with_odd_rows(spark, tmp_path):
    data = [x for x in corpus(5, 300) if x[0] is not None]
    data = list({x[0]: x for x in data}.values())
    df = spark.createDataFrame(data, SCHEMA)
    con = duckdb.connect()
    pdf = df.toPandas()
    con.register("documents", pdf)
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, n_words, n_repeat_words, kept FROM ({quality_rules.OP6_SQL})").fetchall()}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = quality_rules.op6_quality_rules(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in got} == want


def odd_columns(spark, names):
    """A table whose extra columns have the names that the operators use inside."""
    df = spark.createDataFrame([(i, "some words and more of them " * (5 + i), "en", "a" if i % 3 else None) for i in range(9)] + [(8, "some words and more of them " * 13, "en", "a")], SCHEMA)
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


@pytest.mark.parametrize(
    "op, names",
    [
        (mixing.mix, ["__s", "__u", "__bits", "__p", "__slice", "__k", "__null", "__cut", "c0", "c1", "fill", "words"]),
        (lambda d: mixing.repeated(mixing.mix(d)), ["__i", "__s", "c2"]),
        (sharding.assign_shards, ["__h", "__s", "__fine", "__t", "c0", "fine", "leaf"]),
        (quality_rules.quality_rules, ["__lang", "__source", "__f_upper", "__bytes", "c0", "c1", "n", "q1"]),
    ],
)
def test_internal_names_do_not_clash(spark, op, names):
    df = odd_columns(spark, names)
    got = op(df).collect()
    assert got and all(r[n] == f"own {n}" for r in got for n in names)
    assert {r.doc_id for r in got} <= set(range(9))
    if op is not None and len(names) > 3:
        assert len(got) == 10


def test_rules_leave_the_caller_s_columns(spark):
    df = odd_columns(spark, ["language"]).withColumn("Kept", F.lit(5))
    got = quality_rules.quality_rules(df, lang="language").collect()
    assert {r.lang for r in got} == {"en"} and all(isinstance(r.kept, bool) for r in got)


def test_fences_come_from_the_groups(spark):
    """Groups of unlike spread get unlike fences on the side where they differ; the slack decides only without spread."""
    r = random.Random(8)
    sizes = {"narrow": (5, 5), "wide": (2, 12), "long": (8, 11), "short": (2, 4)}
    data = []
    for i in range(1200):
        source = list(sizes)[i % 4]
        word = lambda: ("A" if r.random() < 0.02 * (i % 4) else "a") + "".join(r.choices("bcdefgh", k=r.randint(*sizes[source]) - 1))  # noqa: B023, E731
        data.append((i, " ".join(word() for _ in range(40 + r.randint(0, 40))), "en", source))
    df = spark.createDataFrame(data, SCHEMA)
    own = quality_rules.measured(df).withColumns({"__lang": F.col("lang"), "__source": F.col("source")})
    sketch = quality_rules.sketches(own)
    made = {r["__source"]: r for r in quality_rules.fences(sketch).collect()}
    quart = {(q["__source"], q.measure): q for q in quality_rules.quartiles(sketch, ["__lang", "__source"]).collect()}
    for k in ("word_length", "upper"):
        assert len({made[s][f"__f_{k}"].hi for s in sizes}) == 4
    for k in ("symbols", "dup_lines"):
        assert {made[s][f"__f_{k}"].hi for s in sizes} == {quality_rules.FENCE * quality_rules.MEASURES[k][3]}
    slack = quality_rules.MEASURES["word_length"][3]
    spread = [s for s in sizes if quart[s, "word_length"].q3 - quart[s, "word_length"].q2 > slack]
    assert "wide" in spread and "narrow" not in spread
    assert made["wide"]["__f_word_length"].hi - quart["wide", "word_length"].q2 > made["narrow"]["__f_word_length"].hi - quart["narrow", "word_length"].q2


def test_small_groups_lean_on_larger_ones(spark):
    # symbols in a tenth of the words are usual for this language, so a new source with them stays
    data = [(i, " ".join("ab*" if k % 5 == i % 5 else f"w{i}x{k}" for k in range(60)), "de", "big") for i in range(200)]
    data += [(1000 + i, " ".join("ab*" if k % 5 == 0 else f"w{i}x{k}" for k in range(60)), "de", f"new{i}") for i in range(3)]
    data += [(2000, " ".join(f"w{k}****" for k in range(60)), "de", "bad")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[1000 + i] for i in range(3)) and not got[2000]


def test_mix_cuts_inside_one_place_of_the_order(spark):
    # a third of the rows share one key and length, so they share one place in the order
    data = [(i, "w " * (5 + i % 7), "en", "a") for i in range(400)] + [(-1, "w " * 9, "en", "a")] * 200 + [(i, "v " * 8, "en", "b") for i in range(900, 960)]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len({(r.copies, r.taken) for r in got if r.doc_id == -1}) == 1
    for s in "ab":
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= (200 * 9 if s == "a" else 8)


@pytest.mark.parametrize("op", [mixing.mix, sharding.assign_shards, quality_rules.quality_rules])
def test_very_long_text(spark, op):
    long = ("many words of one long text " * 200_000)[:5_000_000]
    df = spark.createDataFrame([(1, long, "en", "a"), (2, "short text " * 20, "en", "a")], SCHEMA)
    got = {r.doc_id: r for r in op(df).drop("text").collect()}
    assert len(got) == 2
    if op is sharding.assign_shards:
        assert got[1].n_bytes == 5_000_000
    else:
        assert got[1]["size" if op is mixing.mix else "n_words"] == len(long.split())
