from strandworks.streaming import counts


def test_running_counts_equal_batch(spark, tmp_path):
    src, out = str(tmp_path / "calls"), str(tmp_path / "out")
    for part in range(2):
        rows = [("c", s, 10 * s, 2 * part + h, part, (s + h) % 2) for s in range(3) for h in range(2)] + [("c", 0, 0, 9, 4, None)]
        spark.createDataFrame(rows, counts.CALLS).write.mode("append").parquet(src)
        counts.write_counts(counts.running_counts(counts.read_calls(spark, src)), out, str(tmp_path / "cp")).awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("c", 0, 4, 2), ("c", 1, 4, 2), ("c", 2, 4, 2)]
