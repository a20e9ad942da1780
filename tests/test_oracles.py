"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandworks import registry
from strandworks.operators import linalg

SF = "/root/testdata/sf0.001"
TABLES = "lineitem embeddings documents benchmark".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(repr(tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, key):
    df = registry.QUERIES[key](spark, SF)
    rel = con.execute(registry.ORACLES[key])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(rel.fetchall(), columns, order)


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_als_query_runs_to_the_default_limit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(linalg, "als_init", lambda rows, n, k, **more: seen.append(more) or (None, rows.selectExpr("0L AS sample", "0L AS k", "1D AS q").limit(1)))
    assert registry.QUERIES["admix_init"](spark, SF).count() > 0
    assert seen == [{}]


def test_six_decimals_as_the_sql_rounds(spark):
    """Halves go away from 0 by the nearest millionth, in a plan without decimals."""
    import math

    import duckdb
    from pyspark.sql import functions as F

    from strandworks.functions.numeric import round6

    values = [0.0, -0.0, 5e-7, -5e-7, 1.0000005, -2.5000005, 0.1234565, 3.3333333, -7e8 / 3, 1e9 + 1 / 3, -1e15 / 7, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", round6(F.col("v")).alias("v"))
    got = [r.v for r in df.orderBy("i").collect()]
    for v, x in zip(values, got):
        want = v if v is None or not math.isfinite(v) else duckdb.connect().execute(f"SELECT round({v!r}::DOUBLE, 6) + 0.0").fetchone()[0]
        assert repr(x) == repr(want), v


@pytest.mark.parametrize("key", ["grm_raw", "wide_grm"])
def test_no_packed_samples_are_copied_for_each_block(spark, key):
    """Partitions of packed samples meet in tasks; none is repeated for the blocks that it meets and shuffled."""
    plan = registry.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "sequence(" not in plan
