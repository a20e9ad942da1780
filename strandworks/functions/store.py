"""Tables written to the folder that driver and executors share, to cut lineages that grow with iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local masters without the setting, by application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder (one for each application) on a local
    master, else a folder of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="strandworks-")
        root = _FOLDERS[app]
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/strandworks/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: no later step depends on the executors that made it."""
    spark = df.sparkSession
    path = scratch(spark, "haplotypes")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a written table that nothing will read again."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/strandworks/haplotypes-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
