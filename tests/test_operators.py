"""Operators on small hand-made tables: windows, ties, edge cases, and invariants."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.operators import admix, clustering, dedup, lai, linalg, predict, stats, windows
from strandworks.plans import verbs
from strandworks.sources import codecs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def axis(spark, n, chrom="chr1", gap=10):
    return spark.createDataFrame([(chrom, i, 100 + i * gap) for i in range(n)], "chrom string, snp long, pos long")


def test_fixed_windows_absorb_the_remainder(spark):
    got = rows(windows.fixed(axis(spark, 11), 4).groupBy("window").count())
    assert got == [(0, 4), (1, 7)]


def test_sliding_windows_cover_and_last_runs_to_the_end(spark):
    got = rows(windows.sliding(axis(spark, 12), 5, 3).groupBy("window").agg(F.min("snp"), F.max("snp")))
    assert got == [(0, 0, 4), (1, 3, 7), (2, 6, 11)]


def test_too_few_snps_raise(spark):
    with pytest.raises(Exception, match="fewer SNPs"):
        windows.fixed(axis(spark, 3), 4).collect()


def test_length_windows_are_greedy_and_inclusive(spark):
    got = rows(windows.by_length(axis(spark, 7), 20).groupBy("window").agg(F.min("snp"), F.max("snp")))
    assert got == [(0, 0, 2), (1, 3, 5), (2, 6, 6)]


def test_custom_windows_and_empty_table(spark):
    starts = spark.createDataFrame([("chr1", 0), ("chr1", 4)], "chrom string, start long")
    got = rows(windows.custom(axis(spark, 6), starts).groupBy("window").agg(F.min("snp"), F.max("snp")))
    assert got == [(0, 0, 3), (1, 4, 5)]
    assert windows.custom(axis(spark, 6).limit(0), starts).count() == 0


def unique(spark, data):
    return spark.createDataFrame([("c", 0, i, b, n) for i, (b, n) in enumerate(data)], "chrom string, window long, u_idx long, bits long, n_u long")


def medians(spark, data):
    return spark.createDataFrame([("c", 0, i, b) for i, b in enumerate(data)], "chrom string, window long, cluster long, bits long")


def test_nearest_takes_the_highest_of_equals(spark):
    got = clustering.assign_nearest(unique(spark, [(0b0011, 1)]), medians(spark, [0b0001, 0b0010])).first()
    assert (got.cluster, got.d) == (1, 1)


def test_majority_is_strict(spark):
    near = unique(spark, [(0b01, 2), (0b10, 2)]).withColumn("cluster", F.lit(0).cast("long"))
    assert rows(clustering.medians_of(near, 2)) == [("c", 0, 0, 0)]


def test_farthest_smallest_prune_compact(spark):
    a = unique(spark, [(1, 3), (2, 5), (4, 5)]).withColumn("d", F.lit(2).cast("long"))
    assert clustering.farthest_point(a).first().u_idx == 1
    assert clustering.farthest_point(a, 3).count() == 0
    s = spark.createDataFrame([("c", 0, 0, 2), ("c", 0, 1, 2), ("c", 0, 2, 9), ("c", 0, 4, 9), ("c", 0, 5, 7)], "chrom string, window long, cluster long, n long")
    assert clustering.smallest_cluster(s).first().cluster == 1
    assert [r.cluster for r in clustering.prune_clusters(s).orderBy("cluster").collect()] == [2, 4, 5]
    assert [r.compact for r in clustering.compact_ids(s).orderBy("cluster").collect()] == [0, 1, 2, 3, 4]


def test_clustering_loop_invariants():
    r = np.random.default_rng(1)
    founders = r.integers(0, 2, (4, 16))
    x = np.repeat(founders, 60, 0)
    flip = r.random(x.shape) < 0.01
    x = np.where(flip, 1 - x, x)
    bits = (x << np.arange(16)).sum(1)
    u, n = np.unique(bits, return_counts=True)
    z, med = clustering.dp_medians((u[:, None] >> np.arange(16)) & 1, n, clustering.Settings(16, 0.2, min_mac=5))
    assert set(z) == set(range(len(med))) and {tuple(m) for m in med} == {tuple(f) for f in founders}
    size = np.bincount(z, n)
    assert (size >= 5).all() or len(size) <= 2
    one, _ = clustering.dp_medians(np.array([[0, 1]]), np.array([9]), clustering.Settings(2))
    assert list(one) == [0]
    two, _ = clustering.dp_medians(np.array([[0, 0, 0], [1, 0, 0]]), np.array([9, 1]), clustering.Settings(3, 0.9, min_mac=1))
    assert len(set(two)) == 2


def test_unphased_matches_brute_force(spark):
    r = random.Random(5)
    med = [r.randrange(16) for _ in range(4)]
    calls = [("c", 0, s, j, r.choice([0, 1, 2, None])) for s in range(40) for j in range(4)]
    g = spark.createDataFrame(calls, "chrom string, window long, sample long, j long, dosage long")
    got = {x.sample: (x.t, x.c1, x.c2) for x in predict.unphased(predict.geno_states(g), medians(spark, med)).collect()}
    for s in range(40):
        mine = {j: d for _, _, t, j, d in calls if t == s}
        best = None
        for c1, c2 in itertools.product(range(4), repeat=2):
            t = 0
            for j, d in mine.items():
                a, b = med[c1] >> j & 1, med[c2] >> j & 1
                if d in (0, 2):
                    t += 2 * (a != d // 2) + (b != d // 2)
                elif d == 1:
                    t += (1 - a) != b
            if best is None or t < best[0]:
                best = (t, c1, c2)
        assert got[s] == best


def test_plink_round_trip(spark):
    g = spark.createDataFrame([("c", s, [0, 1, 2, None][s % 4]) for s in range(7)], "chrom string, sample long, dosage long")
    back = codecs.plink_decode(codecs.plink_encode(g, ["chrom"]), ["chrom"], 7)
    assert {(r.sample, r.dosage) for r in back.collect()} == {(r.sample, r.dosage) for r in g.collect()}


def _model(spark):
    r = np.random.default_rng(0)
    z = spark.createDataFrame([("c", w, h, h // 2, int(r.integers(0, 3))) for w in range(6) for h in range(12)], "chrom string, window long, hap long, sample long, cluster long").cache()
    raw = spark.createDataFrame([("c", w, c, k, float(r.random() + 0.1)) for w in range(6) for c in range(3) for k in range(2)], "chrom string, window long, cluster long, k long, p double")
    p = admix.create_p(raw).cache()
    q = admix.project_q(spark.createDataFrame([(s, k, float(r.random() + 0.1)) for s in range(6) for k in range(2)], "sample long, k long, q double")).cache()
    return z, p, q


def test_em_raises_the_likelihood_and_keeps_sums(spark):
    z, p, q = _model(spark)
    before = admix.loglik(z, p, q).first()[0]
    p1, q1 = verbs.em_iterations(z, p, q, 1)
    assert admix.loglik(z, p1, q1).first()[0] > before
    assert all(abs(x.s - 1) < 1e-9 for x in q1.groupBy("sample").agg(F.sum("q").alias("s")).collect())
    assert admix.check_p(p1).where("not ok").count() == 0


def test_hmm_against_enumeration(spark):
    e = np.log(np.random.default_rng(3).random((4, 2)))
    q = np.array([0.3, 0.7])
    em = spark.createDataFrame([("c", 0, b, k, float(e[b, k])) for b in range(4) for k in range(2)], "chrom string, hap long, block long, k long, e double")
    qs = spark.createDataFrame([(0, k, float(q[k])) for k in range(2)], "hap long, k long, q double")
    a = spark.createDataFrame([(0.4,)], "alpha double")
    stay = np.exp(-0.4)
    t = np.log((1 - stay) * q[:, None] + stay * np.eye(2))
    paths = {s: e[0, s[0]] + np.log(q[s[0]]) + sum(t[s[i], s[i - 1]] + e[i, s[i]] for i in range(1, 4)) for s in itertools.product(range(2), repeat=4)}
    total = np.logaddexp.reduce(list(paths.values()))
    c = lai.chains(em, qs, a)
    assert abs(lai.forward(c).first().loglik - total) < 1e-9
    assert tuple(r.k for r in lai.viterbi(c).orderBy("block").collect()) == max(paths, key=paths.get)
    post = {(r.block, r.k): r.p for r in lai.posterior(c).collect()}
    for b, k in post:
        assert abs(post[b, k] - sum(np.exp(v - total) for s, v in paths.items() if s[b] == k)) < 1e-9


def test_grm_in_tiles_and_pca(spark):
    z, _, _ = _model(spark)
    f = stats.frequency(z)
    dense = stats.centered(z, f).toPandas().pivot(index=["chrom", "window", "cluster"], columns="sample", values="x").to_numpy()
    want = dense.T @ dense / (2 * stats.denominator(f).first().d)
    for more in ({}, {"tile": 4, "entries": 8}, {"tile": 1}):
        got = {(r.i, r.j): r.g for r in stats.grm(z, f, **more).collect()}
        assert sorted(got) == [(i, j) for i in range(6) for j in range(i + 1)]
        assert all(abs(g - want[k]) < 1e-9 for k, g in got.items())
    # samples that share no window are a pair too
    apart = z.where("(sample < 3 and window < 3) or (sample >= 3 and window >= 3)")
    assert stats.grm(apart, f, tile=2, entries=4).count() == 21
    full = linalg.allele_rows(z, f)
    s, v, m = linalg.svd(full, 6, 3)
    v = v.toPandas().pivot(index="sample", columns="pc", values="v").to_numpy()
    table = full.toPandas()
    p = table["p"].to_numpy()[:, None]
    x = np.repeat(-2 * p, 6, 1)
    for i, (at, dosage) in enumerate(zip(table["samples"], table["zs"], strict=True)):
        x[i, at] += dosage
    x /= np.sqrt(2 * p * (1 - p))
    want = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[1][:3]) and np.allclose(np.abs((v * want[2][:3].T).sum(0)), 1, atol=1e-6)


def test_verbs_end_to_end(spark):
    r = np.random.default_rng(2)
    founders = r.integers(0, 2, (3, 16))
    data = [("chr1", j, 100 + 7 * j, h, h // 2, int(founders[h % 3, j])) for h in range(24) for j in range(16)]
    hap = spark.createDataFrame(data, "chrom string, snp long, pos long, hap long, sample long, allele long")
    c = verbs.cluster(hap, size=8, lmbda=0.1, min_mac=1)
    assert rows(c.windows.select("window", "size")) == [(0, 8), (1, 8)]
    w = windows.fixed(windows.snps_of(hap), 8)
    again = verbs.predict(hap, c.medians, w)
    key = ["chrom", "window", "hap", "sample", "cluster"]
    assert rows(again.select(*key)) == rows(c.assignments.select(*key))
    with pytest.raises(ValueError):
        verbs.cluster(hap, size=8, length=100)
    packed = dedup.packed(windows.attach(hap, w))
    assert dedup.unique(packed).agg(F.sum("n_u")).first()[0] == 48


@pytest.mark.parametrize("tile, entries", [(512, 1 << 20), (4, 30), (3, 1 << 20), (16, 7)])
def test_relationship_tiles_of_any_size(spark, tile, entries):
    """Tiles, and parts of their alleles, change nothing; ids may have gaps."""
    r = np.random.default_rng(tile)
    ids = [0, 1, 2, 5, 6, 11, 12]
    c = r.integers(0, 3, (9, 14))
    z = spark.createDataFrame([("c", w, h, ids[h // 2], int(c[w, h])) for w in range(9) for h in range(14)], "chrom string, window long, hap long, sample long, cluster long")
    got = {(x.i, x.j): x.g for x in stats.grm(z, stats.frequency(z), tile=tile, entries=entries).collect()}
    dose = np.array([[(c[w, 2 * s] == k).astype(int) + (c[w, 2 * s + 1] == k) for s in range(7)] for w in range(9) for k in range(3)])
    p = dose.mean(1) / 2
    x = dose - 2 * p[:, None]
    want = x.T @ x / (2 * (p * (1 - p)).sum())
    assert got.keys() == {(a, b) for a in ids for b in ids if a >= b}
    assert all(abs(g - want[ids.index(a), ids.index(b)]) < 1e-9 for (a, b), g in got.items())


@pytest.mark.parametrize("tile, entries, span", [(512, 1 << 20, 1024), (2, 8, 4), (3, 6, 3)])
def test_centred_relations_of_dosages(spark, tile, entries, span, monkeypatch):
    """The centred matrix by groups of several tiles: the means leave the dosages, so no pair is joined or read again."""
    monkeypatch.setattr(stats, "SPAN", span)
    r = np.random.default_rng(3)
    ids, c = [0, 1, 3, 4, 7, 8, 11], r.integers(0, 3, (5, 14))
    z = spark.createDataFrame([("c", w, h, ids[h // 2], int(c[w, h])) for w in range(5) for h in range(14) if (w, h) != (2, 5)], "chrom string, window long, hap long, sample long, cluster long")
    got = stats.grm_centered(z, tile=tile, entries=entries)
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") <= 1
    assert got.groupBy().count().first()[0] == 28
    dose = np.array([[(c[w, 2 * s] == k).astype(int) * ((w, 2 * s) != (2, 5)) + (c[w, 2 * s + 1] == k) * ((w, 2 * s + 1) != (2, 5)) for s in range(7)] for w in range(5) for k in range(3)])
    x = dose - dose.sum(1, keepdims=True) / 14
    g = x.T @ x
    g = g - g.mean(0) - g.mean(1)[:, None] + g.mean()
    g *= 6 / np.trace(g)
    assert all(abs(row.g - g[ids.index(row.i), ids.index(row.j)]) < 1e-9 for row in got.collect())


def test_no_proportions_through_the_driver(spark, tmp_path):
    """A step's joins by units shuffle both sides, however small the files are, and z is never the side that is sent."""
    z, p, q = _model(spark)
    for name, df in (("z", admix.seen(z)), ("q", q)):
        df.write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    plan = admix.joint(read("z"), p, read("q"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2


def _pairs_model(spark, n: int, tile: int = 2):
    """z of n samples with gaps in their ids, several alike."""
    r = np.random.default_rng(n)
    ids, kinds = [s + s // 3 for s in range(n)], r.integers(0, 3, (6, 10))
    c = kinds[:, r.integers(0, 10, 2 * n)]
    z = [("c", w, h, ids[h // 2], int(c[w, h])) for w in range(6) for h in range(2 * n)]
    dose = np.array([[(c[w, 2 * s] == k).astype(int) + (c[w, 2 * s + 1] == k) for s in range(n)] for w in range(6) for k in range(3)])
    return spark.createDataFrame(z, "chrom string, window long, hap long, sample long, cluster long"), ids, dose


@pytest.mark.parametrize("entries", [1 << 20, 12])
def test_pairs_of_several_runs_of_blocks(spark, entries, monkeypatch):
    """Each pair once, whether its samples lie in one block, one run of ids or two."""
    monkeypatch.setattr(stats, "SPAN", 4)
    monkeypatch.setattr(stats, "CHUNK", 8)
    z, ids, dose = _pairs_model(spark, 17)
    got = [(r.i, r.j, r.g) for r in stats.grm(z, stats.frequency(z), tile=2, entries=entries).collect()]
    p = dose.mean(1) / 2
    x = dose - 2 * p[:, None]
    want = x.T @ x / (2 * (p * (1 - p)).sum())
    assert sorted(g[:2] for g in got) == [(a, b) for a in ids for b in ids if a >= b]
    assert all(abs(g - want[ids.index(i), ids.index(j)]) < 1e-9 for i, j, g in got)


def test_like_samples_lie_side_by_side(spark):
    """Blocks of a later run of ids hold the greater ids; inside a run equal samples follow each other."""
    marks = spark.createDataFrame([(s, 0.0, s % 5) for s in range(0, 9000, 3)], "sample long, m double, like long")
    placed = stats._placed(marks, 1024).orderBy("b", "at").collect()
    assert [r["at"] for r in placed if r.b == 0] == list(range(1024))
    for late in (False, True):
        own = [r["sample"] for r in placed if (r["sample"] >= stats.CHUNK) == late]
        assert own == sorted(own, key=lambda s: (s % 5, s))
    assert max(r.b for r in placed if r["sample"] < stats.CHUNK) < min(r.b for r in placed if r["sample"] >= stats.CHUNK)


def shuffled(spark, df) -> int:
    """Bytes that a run of df leaves on the executors' disks for other tasks."""
    sc = spark.sparkContext._jsc.sc()
    total = []
    for run in (False, True):
        if run:
            df.write.format("noop").mode("overwrite").save()
        sc.listenerBus().waitUntilEmpty(30_000)
        every = sc.statusStore().executorList(False)
        total.append(sum(every.apply(k).totalShuffleWrite() for k in range(every.size())))
    return total[1] - total[0]


PAIRS = {
    "grm_lower": lambda z: stats.grm(z, stats.frequency(z), tile=2),
    "grm_centered": lambda z: stats.grm_centered(z, tile=2),
}


@pytest.mark.parametrize("key", PAIRS)
def test_disk_of_pairs_grows_with_the_samples(spark, key, monkeypatch):
    """Four times the samples, 16 times the pairs of blocks: no packed row is copied for each block that it meets."""
    monkeypatch.setattr(stats, "SPAN", 2)
    monkeypatch.setattr(stats, "CHUNK", 8)
    few, many = (shuffled(spark, PAIRS[key](_pairs_model(spark, n)[0])) for n in (16, 64))
    assert 0 < many < 6 * few
