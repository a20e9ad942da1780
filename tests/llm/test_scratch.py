"""The folder of intermediate tables, where the session's setting is absent."""

import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
from strandworks.llm import sharding
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
assert sharding.assign_shards(docs).count() == 1
print("done")
"""


def test_without_checkpoint_dir(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    run = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert "done" in run.stdout, run.stderr[-2000:]
