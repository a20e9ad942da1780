"""The pipeline on a small corpus with planted rows, each stage against brute force; guards of the entry module."""

import random
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from strandworks.llm import minhash
from strandworks.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(900)]
    clean = lambda n=70: [r.choice(vocabulary) for _ in range(n)]
    docs, bench = [], [" ".join(clean(20)) for _ in range(5)]
    for i in range(240):
        docs.append((i, " ".join(clean()), f"s{i % 4}"))
    for i in range(240, 270):  # near copies: one word in seventy differs
        w = docs[i - 240][1].split()
        w[40] = "other"
        docs.append((i, " ".join(w), "s0"))
    docs += [(i, docs[i - 200][1], "s1") for i in range(270, 280)]  # exact copies
    docs += [(i, " ".join(clean(40) + bench[i % 5].title().split() + clean(9)), "s2") for i in range(280, 290)]
    docs += [(i, " ".join(x + "$$$" for x in clean()), "s3") for i in range(290, 300)]
    docs += [(300, None, None), (301, "", "s0"), (302, "too short", "s0")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in docs], bench


def test_stages(spark, tmp_path):
    rows, bench = planted()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs.collect()
        if name != "shard":
            assert docs.columns == columns
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in seen[name])
    ids = {k: Counter(r.doc_id for r in v) for k, v in seen.items()}
    assert set(ids["quality_rules"]) == set(range(290))
    # one of each component, found by brute force
    sets = {r.doc_id: set(minhash.shingles(r.text.encode()).tolist()) for r in seen["quality_rules"]}
    low = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low[i] = min(low[i], low[j])
    assert ids["near_dedup"] == Counter(i for i in sets if low[i] == i) and len(ids["near_dedup"]) == 250
    assert set(ids["decontaminate"]) == set(range(240))
    size, taken = defaultdict(int), defaultdict(int)
    for r in seen["decontaminate"]:
        size[r.source] += 70
    for r in seen["mix_sources"]:
        taken[r.source] += 70
    assert max(ids["mix_sources"].values()) <= 2 and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 70 * 4
    assert ids["shard"] == ids["mix_sources"] and all(r.shard_id and r.shard_bytes <= 16 << 20 for r in seen["shard"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen["shard"]))


def test_entry_works_without_the_llm_folders(tmp_path):
    root = Path(__file__).parents[2]
    leave_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(root / "strandworks", tmp_path / "strandworks", ignore=leave_out)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_a_broken_package_is_not_taken_for_an_absent_one(tmp_path):
    root = Path(__file__).parents[2]
    shutil.copytree(root / "strandworks", tmp_path / "strandworks", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    (tmp_path / "strandworks" / "llm" / "mixing.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode


def test_nothing_else_imports_the_package():
    root = Path(__file__).parents[2] / "strandworks"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "strandworks.llm" in p.read_text()]


def test_every_operator_is_registered():
    from strandworks.llm import queries

    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
