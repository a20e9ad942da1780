"""The verbs on small tables, and their file round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.operators import admix, chains, clustering, lai, linalg, stats, windows
from strandworks.plans import verbs
from strandworks.sources import codecs, records

from tests.test_operators import _model, rows


def test_admix_and_local_ancestry(spark):
    z, p, q = _model(spark)
    before = admix.loglik(z, p, q).first()[0]
    p1, q1, value = verbs.admix(z, p, q, iterations=2, batches=2, check=1)
    assert value > before
    assert all(abs(r.s - 1) < 1e-6 for r in q1.groupBy("sample").agg(F.sum("q").alias("s")).collect())
    labels = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "sample long, pop long")
    _, q2, _ = verbs.admix(z, p, q, iterations=1, batches=1, check=1, labels=labels)
    assert q2.where("sample = 0 and k = 0").first().q > 0.99
    p3, _, _ = verbs.admix(z, p, q, iterations=1, batches=1, check=1, projection=True)
    assert rows(p3) == rows(p)
    meta = spark.createDataFrame([("c", w, 10 + w) for w in range(6)], "chrom string, window long, length long")
    qh = z.select("hap", "sample").distinct().join(q, "sample").select("hap", "k", "q")
    for more in ({"alpha": 0.5, "use_viterbi": True}, {"posteriors": True, "block": 4}, {"quantile": 0.5, "simple": True}):
        path = verbs.local_ancestry(z, p, qh, meta, genome_wide=True, **more)
        assert path.count() == 12 * 6 and path.where("k not in (0, 1)").count() == 0


def test_pca_projection_of_the_same_samples(spark):
    z, _, _ = _model(spark)
    val, v, load, freqs = verbs.struct_pca(z, 6, 2)
    vals = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(val)], "pc long, val double")
    got = verbs.struct_project(z, freqs, load, vals, linalg.allele_rows(z, freqs).count())
    m = np.zeros((6, 2))
    for r in got.collect():
        m[r["sample"], r["pc"] - 1] = r["v"]
    v = v.toPandas().pivot(index="sample", columns="pc", values="v").to_numpy()
    assert np.allclose(m, v, atol=1e-6)
    g = verbs.struct_grm(z)
    assert abs(g.where("i = j").agg(F.sum("g")).first()[0] - 5) < 1e-9


def test_als_start_is_a_distribution(spark):
    z, _, _ = _model(spark)
    p, q = linalg.als_init(linalg.allele_rows(z, stats.frequency(z)), 6, 3, iterations=5)
    assert np.allclose(q.toPandas().groupby("sample")["q"].sum(), 1) and np.allclose(p.toPandas().groupby(["chrom", "window", "k"])["p"].sum(), 1)


def test_length_filter_bounds(spark):
    meta = spark.createDataFrame([("c", w, 10 * w) for w in range(5)], "chrom string, window long, length long")
    assert [r.window for r in lai.window_length_filter(meta, 10, 30).orderBy("window").collect()] == [1, 2, 3]
    assert [r.window for r in lai.window_length_filter(meta, quantile=0.5).orderBy("window").collect()] == [1, 2, 3]


def test_bad_files_and_labels_raise(spark):
    with pytest.raises(Exception, match="not an assignment file"):
        codecs.decode_assignments(spark.createDataFrame([("c", b"\x00\x01\x02\x03")], "chrom string, content binary"), 1).collect()
    lines = spark.createDataFrame([(0, "1"), (1, "9")], "sample long, value string")
    with pytest.raises(Exception, match="population label"):
        codecs.checked_labels(lines, 3).collect()


def test_bed_file_round_trip(spark, tmp_path):
    dosage = np.array([[0, 1, 2, 2, 0], [2, 2, 1, 0, 0]])
    code = np.array([3, 2, 0])[dosage]
    body = bytearray()
    for row in code:
        for k in range(0, 5, 4):
            body.append(sum(int(c) << (2 * i) for i, c in enumerate(row[k : k + 4])))
    (tmp_path / "x.bed").write_bytes(codecs.PLINK_MAGIC + bytes(body))
    got = codecs.plink_decode(records.read_bed(spark, str(tmp_path / "x.bed"), 5), ["snp"], 5)
    assert {(r.snp, r["sample"]): r.dosage for r in got.collect()} == {(i, j): int(dosage[i, j]) for i in range(2) for j in range(5)}


def test_vcf_text(spark):
    text = ["##fileformat=VCFv4.2", "#CHROM\tPOS", "chr2\t5\t.\tA\tC\t.\t.\t.\tGT:DP\t0|1:3\t.|1:2"]
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    got = codecs.vcf_haplotypes(lines)
    assert sorted((r.pos, r.hap, r["sample"], r.allele) for r in got.collect() if r.allele is not None) == [(5, 0, 0, 0), (5, 1, 0, 1), (5, 3, 1, 1)]
    assert codecs.is_phased(lines).first().phased
    more = lines.union(spark.createDataFrame([("chr2\t6\t.\tA\tC,G\t.\t.\t.\tGT\t0|2\t1|1",)], "value string"))
    with pytest.raises(Exception, match="multi-allelic record at chr2:6"):
        codecs.vcf_haplotypes(more).collect()


def test_unused_limit_of_clusters():
    x = np.eye(6, dtype=np.int64)
    z, _ = clustering.dp_medians(x, np.full(6, 5), clustering.Settings(6, 0.1, min_mac=1, max_clusters=3))
    assert len(set(z)) <= 3


def test_medians_of_the_last_window_take_all_its_snps(spark):
    r = np.random.default_rng(2)
    founders = r.integers(0, 2, (3, 20))
    data = [("chr1", j, 100 + 7 * j, h, h // 2, int(founders[h % 3, j])) for h in range(24) for j in range(20)]
    hap = spark.createDataFrame(data, "chrom string, snp long, pos long, hap long, sample long, allele long")
    for options in ({"size": 8}, {"size": 8, "step": 4}, {"length": 60}):
        c = verbs.cluster(hap, lmbda=0.1, min_mac=1, medians=True, **options)
        size = {x["window"]: x["size"] for x in c.windows.collect()}
        bits = {(x.window, x.cluster): x.bits for x in c.medians.collect()}
        # three founders without noise: every allele of a cluster is its median's
        for x in c.loglik.collect():
            w = size[x.window]
            apart = bin(bits[x.window, x.c1] ^ bits[x.window, x.c2]).count("1")
            assert abs(x.ll - (apart * np.log(1e-5) + (w - apart) * np.log(1 - 1e-5))) < 1e-6
    assert max(size.values()) < 20 and len(size) > 1
    # the axis must be the reference's
    w = windows.fixed(windows.snps_of(hap), 8)
    c = verbs.cluster(hap, size=8, min_mac=1)
    assert verbs.predict(hap, c.medians, w, reference=c.windows).count() == 48
    moved = windows.fixed(windows.snps_of(hap.withColumn("pos", F.col("pos") + 1)), 8)
    with pytest.raises(ValueError, match="open"):
        verbs.predict(hap, c.medians, moved, reference=c.windows)
    with pytest.raises(ValueError, match="end"):
        verbs.predict(hap, c.medians, w, reference=c.windows.withColumn("end", F.col("end") + 1))


def test_ways_to_start(spark):
    z, p, _ = _model(spark)
    labels = spark.createDataFrame([(i, i % 3) for i in range(6)], "sample long, pop long")
    some = z.select("chrom", "window").where("window < 3").distinct()
    for options in ({}, {"windows": some}, {"random": True}, {"labels": labels}, {"p": p}):
        p0, q0 = verbs.admix_start(z, 2, **options)
        assert q0.count() == 12 and all(abs(x.s - 1) < 1e-9 for x in q0.groupBy("sample").agg(F.sum("q").alias("s")).collect())
        assert p0.count() == 2 * z.select("chrom", "window", "cluster").distinct().count()
        assert p0.join(p, ["chrom", "window", "cluster", "k"]).count() == p.count()
        assert em_check(p0)
    assert q0.collect() == verbs.admix_start(z, 2, p=p)[1].collect()
    with pytest.raises(ValueError):
        verbs.admix_start(z, 2, p=p.withColumn("p", F.col("p") * 2))
    with pytest.raises(ValueError):
        verbs.admix_start(z, 1, labels=labels)


def em_check(p):
    return not admix.check_p(p).where("not ok").count()


def test_chromosomes_have_their_own_proportions(spark):
    z, p, q = _model(spark)
    other = z.withColumn("chrom", F.lit("d")).withColumn("cluster", F.lit(0).cast("long"))
    both, p2 = z.union(other), p.union(p.withColumn("chrom", F.lit("d")))
    qh = z.select("hap", "sample").distinct().join(q, "sample").select("hap", "k", "q")
    own = verbs.chromosome_q(both, p2, qh, iterations=1, batches=1)
    assert own.count() == 2 * qh.count() and own.where("chrom = 'c'").join(own.where("chrom = 'd'").select("hap", "k", F.col("q").alias("r")), ["hap", "k"]).where("abs(q - r) > 1e-6").count() > 0
    meta = spark.createDataFrame([(c, w, 10 + w) for c in "cd" for w in range(6)], "chrom string, window long, length long")
    path = verbs.local_ancestry(both, p2, qh, meta, iterations=1, batches=1, alpha=0.5)
    assert path.count() == 2 * 12 * 6


def test_files_of_other_samples_raise(spark):
    z, _, _ = _model(spark)
    assert codecs.filelist_union([z, z]).count() == 2 * z.count()
    with pytest.raises(ValueError, match="file 1"):
        codecs.filelist_union([z, z.where("sample < 5")])


def test_chain_kernels_on_many_blocks():
    r = np.random.default_rng(5)
    e, q, alpha = np.log(r.random((7, 2000, 3))), r.dirichlet([1, 1, 1], 7), r.random(7)
    t = chains.moves(q, alpha, False)
    assert np.allclose(np.exp(t).sum(1), 1)
    post = chains.posteriors(e, q, alpha, False)
    assert np.allclose(post.sum(2), 1)
    path = chains.best_paths(e, q, alpha, False)
    score = lambda p, c: e[c, 0, p[0]] + np.log(q[c, p[0]]) + sum(t[c, p[b], p[b - 1]] + e[c, b, p[b]] for b in range(1, len(p)))
    for c in range(7):
        other = path[c].copy()
        other[r.integers(0, 2000, 3)] = r.integers(0, 3, 3)
        assert score(path[c], c) >= score(other, c) - 1e-9


def test_wide_windows_in_the_clustering_kernel():
    r = np.random.default_rng(1)
    founders = r.integers(0, 2, (3, 150))
    x = np.unique(np.concatenate([founders, founders ^ (r.random((3, 150)) < 0.02)]), axis=0)
    z, m = clustering.dp_medians(x, np.ones(len(x), np.int64), clustering.Settings(150, 0.1, min_mac=1))
    near = (x[:, None, :] != m[None]).sum(2)
    assert len(set(z)) == 3 and (near[np.arange(len(x)), z] == near.min(1)).all()


@pytest.mark.parametrize("batches, iterations", [(2, 1), (1, 0)])
def test_chromosomes_move_together_as_they_would_alone(spark, batches, iterations):
    z, p, q = _model(spark)
    z = z.unionByName(z.withColumn("chrom", F.lit("d")).withColumn("cluster", (F.col("cluster") + F.col("hap") % 2) % 2).where("window < 4"))
    p = p.unionByName(p.withColumn("chrom", F.lit("d")).where("window < 4"))
    qh = z.select("hap", "sample").distinct().join(q, "sample").select("hap", "k", "q")
    got = verbs.chromosome_q(z, p, qh, iterations=iterations, batches=batches, check=99)
    for chrom in ("c", "d"):
        on = F.col("chrom") == chrom
        _, alone, _ = verbs.admix(z.where(on), p.where(on), qh, iterations=iterations, batches=batches, check=99, projection=True, unit="hap")
        want = {(r.hap, r.k): r.q for r in alone.collect()}
        have = {(r.hap, r.k): r.q for r in got.where(on).collect()}
        assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_chromosomes_end_by_themselves(spark):
    z, p, q = _model(spark)
    z = z.unionByName(z.withColumn("chrom", F.lit("d")).where("window < 2"))
    p = p.unionByName(p.withColumn("chrom", F.lit("d")).where("window < 2"))
    qh = z.select("hap", "sample").distinct().join(q, "sample").select("hap", "k", "q")
    got = verbs.chromosome_q(z, p, qh, iterations=6, batches=2, check=1, tolerance=1e-2)
    assert got.groupBy("chrom").count().orderBy("chrom").collect() == [("c", 24), ("d", 24)]
    assert all(abs(r.s - 1) < 1e-6 for r in got.groupBy("chrom", "hap").agg(F.sum("q").alias("s")).collect())


def test_quasi_step_plan_and_files(spark):
    """A step is one pass over z: the plan of the result reads written tables only."""
    z, p, q = _model(spark)
    new_p, new_q = admix.quasi_step(z, p, q)
    for df in (new_p, new_q):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    sums = admix.em_sums(admix.seen(z), p, q)._jdf.queryExecution().executedPlan().toString()
    assert sums.count("Join") <= 2


def test_start_takes_one_chromosome_in_four(spark, monkeypatch):
    z, _, _ = _model(spark)
    five = z
    for c in "defg":
        five = five.unionByName(z.withColumn("chrom", F.lit(c)).where("window < 2"))
    seen = []
    inner = linalg.als_init
    monkeypatch.setattr(linalg, "als_init", lambda *a, **more: (seen.append(sorted({r.chrom for r in more["windows"].collect()}) if more["windows"] is not None else None), inner(*a, **more))[1])
    p, q = verbs.admix_start(five, 2)
    assert p.select("chrom").distinct().count() == 5 and q.count() == 12 and em_check(p)
    verbs.admix_start(z, 2)
    assert seen == [["c", "d"], None]
    with pytest.raises(ValueError, match="subsampling"):
        verbs.admix_start(five, 2, subsampling=1)
