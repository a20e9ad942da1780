"""Binary files read by ranges: the same rows as from the whole, however they are cut."""

import gzip
import os
import random
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.plans import verbs
from strandworks.sources import bcf, codecs, records, writers

from tests.test_bcf import HEADER, code, record


def test_fixed_records_over_many_partitions(spark, tmp_path):
    (tmp_path / "a.x").write_bytes(b"M" + bytes(range(30)))
    (tmp_path / "b.x").write_bytes(b"M" + bytes(range(100, 106)))
    (tmp_path / "c.x").write_bytes(b"M")
    (tmp_path / "skipped.y").write_bytes(b"no")
    df = records.fixed_records(spark, str(tmp_path), b"M", 3, suffix=".x", partition_bytes=7)
    assert df.rdd.getNumPartitions() == 6
    got = {(os.path.basename(r.file), r.record): bytes(r.content) for r in df.collect()}
    assert got == {("a.x", i): bytes(range(3 * i, 3 * i + 3)) for i in range(10)} | {("b.x", i): bytes(range(100 + 3 * i, 103 + 3 * i)) for i in range(2)}
    assert records.fixed_records(spark, "file://" + str(tmp_path / "c.x"), b"M", 3).count() == 0
    with pytest.raises(Exception, match="whole records"):
        records.fixed_records(spark, str(tmp_path / "a.x"), b"M", 4).collect()
    with pytest.raises(Exception, match="does not open with"):
        records.fixed_records(spark, str(tmp_path / "a.x"), b"N", 3).collect()


@pytest.mark.parametrize("partition_bytes", [1, 60, 64 << 20])
def test_files_of_a_clustering_by_ranges(spark, tmp_path, partition_bytes):
    r = np.random.default_rng(3)
    founders = r.integers(0, 2, (4, 40))
    data = [(c, j, 100 + 7 * j, h, h // 2, int(founders[h % 4, j])) for c in ("chr1", "chr2") for h in range(12) for j in range(40)]
    made = verbs.cluster(spark.createDataFrame(data, "chrom string, snp long, pos long, hap long, sample long, allele long"), size=9, min_mac=1, medians=True)
    writers.write_clusters(made, spark.createDataFrame([(i, f"s{i}") for i in range(6)], "sample long, iid string"), str(tmp_path / "o"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    key = ("chrom", "window", "hap", "sample", "cluster")
    z = records.read_assignments(spark, str(tmp_path), 12, partition_bytes=partition_bytes)
    assert rows(z, *key) == rows(made.assignments, *key)
    windows = made.windows
    files = spark.createDataFrame([(c, str(tmp_path / f"o.{c}.bcm"), str(tmp_path / f"o.{c}.blk")) for c in ("chr1", "chr2")], "chrom string, file string, blk string")
    m = records.read_medians(files, windows, partition_bytes=partition_bytes)
    want = made.medians.join(windows, ["chrom", "window"]).select("chrom", "window", "cluster", F.explode(F.expr("sequence(0L, size - 1)")).alias("j"), "bits").withColumn("allele", F.expr("shiftright(bits, cast(j as int)) & 1"))
    assert rows(m, "chrom", "window", "cluster", "j", "allele") == rows(want, "chrom", "window", "cluster", "j", "allele")
    ll = records.read_loglik(files.select("chrom", F.col("blk").alias("file")), windows, partition_bytes=partition_bytes)
    assert rows(ll, "chrom", "window", "c1", "c2", "ll") == [(*k, float(np.float32(v))) for *k, v in rows(made.loglik, "chrom", "window", "c1", "c2", "ll")]
    with pytest.raises(Exception, match="ends inside|does not open"):
        records.read_medians(files, windows.withColumn("k", F.col("k") + 1), partition_bytes=partition_bytes).count()


def test_bed_by_ranges(spark, tmp_path):
    r = np.random.default_rng(0)
    g = r.integers(0, 3, (50, 10))
    rows = spark.createDataFrame([("c", i, j, int(g[i, j])) for i in range(50) for j in range(10)], "chrom string, snp long, sample long, dosage long")
    path = writers.write_bed(codecs.plink_encode(rows, ["chrom", "snp"]), ["chrom", "snp"], str(tmp_path / "x.bed"))
    bed = records.read_bed(spark, path, 10, partition_bytes=12)
    assert records.fixed_records(spark, path, codecs.PLINK_MAGIC, 3, partition_bytes=12).rdd.getNumPartitions() == 13
    got = codecs.plink_decode(bed, ["snp"], 10).collect()
    assert {(x.snp, x["sample"]): x.dosage for x in got} == {(i, j): int(g[i, j]) for i in range(50) for j in range(10)}


# --- BCF ---

def blocks(data, size, extra=b""):
    """BGZF blocks of so many unpacked bytes each, and the empty one at the end."""
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        z = zlib.compressobj(wbits=-15)
        body = z.compress(part) + z.flush()
        field = extra + b"BC\x02\x00" + struct.pack("<H", 12 + len(extra) + 6 + len(body) + 8 - 1)
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(field)) + field + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def study(n, samples, seed):
    r = random.Random(seed)
    header = HEADER.replace("#CHROM\tPOS\n", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i}" for i in range(samples)) + "\n")
    want, body = {}, b""
    for k in range(n):
        gt = [code(r.choice([0, 1, -1]), r.choice([0, 1]), r.random() < 0.5) for _ in range(samples)]
        body += record(k % 2, k + 1, ["A", "C" * r.randint(1, 9)], gt)
        for i, (a, b) in enumerate(gt):
            want[f"chr{k % 2 + 1}", k + 1, 2 * i] = (a >> 1) - 1 if a >> 1 else None
            want[f"chr{k % 2 + 1}", k + 1, 2 * i + 1] = (b >> 1) - 1
    return b"BCF\x02\x02" + struct.pack("<I", len(header)) + header.encode() + body, want


@pytest.mark.parametrize("size, partition_bytes, samples", [(50, 1, 3), (97, 200, 3), (31, 1, 40), (1000, 1, 1), (65000, 1, 5)])
def test_bcf_by_ranges(spark, tmp_path, size, partition_bytes, samples):
    data, want = study(60, samples, size)
    (tmp_path / "x.bcf").write_bytes(blocks(data, size, b"XX\x01\x00z" if size == 97 else b""))
    (tmp_path / "y.txt").write_bytes(b"not one")
    df = bcf.read_bcf(spark, str(tmp_path), partition_bytes=partition_bytes)
    if size < 1000:
        assert df.rdd.getNumPartitions() >= 4
    got = df.collect()
    assert len(got) == len(want) and {(r.chrom, r.pos, r.hap): r.allele for r in got} == want


def test_bcf_round_trip(spark, tmp_path):
    r = random.Random(1)
    rows = [(c, 10 + j, h, h // 2, r.choice([0, 1, None])) for c in ("chr1", "chr2") for j in range(30) for h in range(8)]
    h = spark.createDataFrame(rows, "chrom string, pos long, hap long, sample long, allele long")
    path = writers.write_bcf(h, str(tmp_path / "x.bcf"), block_bytes=150)
    got = bcf.read_bcf(spark, path, partition_bytes=300)
    assert got.rdd.getNumPartitions() >= 4 and gzip.decompress((tmp_path / "x.bcf").read_bytes())[:3] == b"BCF"
    assert sorted(map(repr, ((x.chrom, x.pos, x.hap, x["sample"], x.allele) for x in got.where("phased").collect()))) == sorted(map(repr, rows))


def test_bcf_that_is_not_in_blocks(spark, tmp_path):
    data, want = study(5, 2, 1)
    for name, content in (("plain", data), ("gzip", gzip.compress(data))):
        (tmp_path / f"{name}.bcf").write_bytes(content)
        assert {(r.chrom, r.pos, r.hap): r.allele for r in bcf.read_bcf(spark, str(tmp_path / f"{name}.bcf")).collect()} == want


def test_without_checkpoint_dir(tmp_path):
    code_ = """
from pyspark.sql import SparkSession
from strandworks import registry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert registry.QUERIES["grm_raw"](spark, "/root/testdata/sf0.001").count() > 0
print("done")
"""
    run = subprocess.run([sys.executable, "-c", code_], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}, capture_output=True, text=True, timeout=300)
    assert "done" in run.stdout, run.stderr[-2000:]
