"""Shared helpers: tables written to the shared folder, checked broadcasts, packing of rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it has at most so many rows (each a few dozen bytes wide).
BROADCAST_ROWS = 50_000
#: The same for a table of one integer column: some 20 MB as a hash table.
ID_ROWS = 500_000

#: Words as runs of anything but ASCII white space.
WS_WORD = r"[^\x20\x09-\x0D]+"


#: Temporary folders of local masters without the setting, by application.
_FOLDERS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Unset on a local master (as in tests) a temporary folder is made once per application; unset on a
    cluster the warehouse folder, which is shared too, is used. A machine-local folder never is.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="strandworks-")
        return _FOLDERS[app]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; the reread plan has real sizes, so later
    joins are planned from them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/strandworks/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing will read again."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/strandworks/" in name and root.split(":")[-1].strip("/") in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``right`` broadcast if it has at most ``limit`` rows, else shuffled.

    ``rows``: the row count of ``right`` if it is known; else it is counted, so ``right`` should be
    a materialized table.
    """
    if rows is None:
        rows = right.limit(limit + 1).count()
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)


def staying(df: DataFrame, made: list[str]) -> list[str]:
    """The columns that appended ones of the given names do not replace; case does not count, as in Spark."""
    lower = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in lower]


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The table with columns c0, c1, ..., and a function that gives the new name of each: no other name,
    such as an operator's own ones, can clash with a column of the caller's."""
    at = {c.lower(): f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), lambda c: at[c.lower()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(col) -> "F.Column":
    """60 well-mixed bits of a value's text form, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def n_words(col) -> "F.Column":
    """Number of words (runs of anything but ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WS_WORD)), F.lit(0)).cast("long")
