"""Files of the interchange formats, read back byte by byte."""

import numpy as np
from pyspark.sql import functions as F

from strandworks.operators import linalg, stats, windows
from strandworks.plans import verbs
from strandworks.sources import codecs, writers

from tests.test_operators import _model


def test_files_of_a_clustering(spark, tmp_path):
    r = np.random.default_rng(3)
    founders = r.integers(0, 2, (3, 20))
    data = [(c, j, 100 + 7 * j, h, h // 2, int(founders[h % 3, j])) for c in ("chr1", "chr2") for h in range(12) for j in range(20)]
    hap = spark.createDataFrame(data, "chrom string, snp long, pos long, hap long, sample long, allele long")
    c = verbs.cluster(hap, size=8, min_mac=1, medians=True)
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "sample long, iid string")
    out = writers.write_clusters(c, samples, str(tmp_path / "o")) + writers.write_starts(windows.fixed(windows.snps_of(hap), 8), str(tmp_path / "o"))
    assert len(out) == 11
    z = {(x.chrom, x.window, x.hap): x.cluster for x in c.assignments.collect()}
    data = (tmp_path / "o.chr2.bca").read_bytes()
    assert data[:3] == codecs.MAGIC and list(data[3:]) == [z["chr2", w, h] for w in range(2) for h in range(12)]
    assert (tmp_path / "o.ids").read_text().split() == [f"s{i}" for i in range(6)]
    lines = (tmp_path / "o.chr1.win").read_text().splitlines()
    assert lines[0].split("\t") == writers.WIN_HEADER and [x.split("\t")[4] for x in lines[1:]] == ["8", "12"]
    k = [int(x.split("\t")[5]) for x in lines[1:]]
    bits = {(x.window, x.cluster): x.bits for x in c.medians.where("chrom = 'chr1'").collect()}
    assert list((tmp_path / "o.chr1.bcm").read_bytes()[3:]) == [bits[w, m] >> j & 1 for w, n in enumerate((8, 12)) for m in range(k[w]) for j in range(n)]
    ll = {(x.window, x.c1, x.c2): x.ll for x in c.loglik.where("chrom = 'chr1'").collect()}
    got = np.frombuffer((tmp_path / "o.chr1.blk").read_bytes()[3:], "<f4")
    assert np.allclose(got, [ll[w, a, b] for w in range(2) for a in range(k[w]) for b in range(k[w])])
    assert (tmp_path / "o.chr1.wix").read_text().split() == ["0", "8"]


def test_matrices_and_text(spark, tmp_path):
    z, p, q = _model(spark)
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "sample long, iid string")
    g = stats.grm(z, stats.frequency(z))
    at = str(tmp_path / "o")
    writers.write_grm(g, 2.5, samples, at)
    m = {(x.i, x.j): x.g for x in g.collect()}
    assert np.allclose(np.fromfile(at + ".grm.bin", "<f4"), [m[i, j] for i in range(6) for j in range(i + 1)], atol=1e-6)
    assert np.fromfile(at + ".grm.N.bin", "<f4").tolist() == [2.5] * 21
    assert (tmp_path / "o.grm.id").read_text().splitlines()[1] == "0\ts1"
    val, vectors, load, freqs = verbs.struct_pca(z, 6, 2)
    v = vectors.toPandas().pivot(index="sample", columns="pc", values="v").to_numpy()
    values = spark.createDataFrame([(j + 1, float(val[j])) for j in range(2)], "pc long, val double")
    writers.write_components(vectors, values, samples, at, duplicate_fid=True)
    lines = (tmp_path / "o.eigenvecs").read_text().splitlines()
    assert lines[0] == "#FID\tIID\tPC1\tPC2" and lines[1].startswith("s0\ts0\t") and abs(float(lines[3].split("\t")[3]) - v[2, 1]) < 1e-6
    writers.write_components(vectors, values, samples, at, raw=True)
    assert np.allclose(np.loadtxt(at + ".eigenvecs"), v, atol=1e-6) and np.allclose(np.loadtxt(at + ".eigenvals"), val, atol=1e-6)
    writers.write_loadings(load, freqs, at)
    assert np.loadtxt(at + ".loadings").shape == (linalg.allele_rows(z, freqs).count(), 2) and len(np.loadtxt(at + ".freqs")) == len(np.loadtxt(at + ".loadings"))
    both = p.union(p.withColumn("chrom", F.lit("d")))
    writers.write_proportions(both, q, at)
    assert np.allclose(np.loadtxt(at + ".Q").sum(1), 1, atol=1e-5) and (tmp_path / "o.pfilelist").read_text().split() == [at + ".c.P", at + ".d.P"]
    want = [x.p for x in p.orderBy("window", "cluster", "k").collect()]
    assert np.allclose(np.loadtxt(at + ".d.P").ravel(), want, atol=1e-6)
    path = z.select("chrom", "window", "hap", (F.col("hap") % 2).alias("k"), F.lit(0.25).alias("prob"))
    writers.write_path(path, at)
    assert np.loadtxt(at + ".c.path").tolist() == [[h % 2] * 6 for h in range(12)] and (tmp_path / "o.c.prob").read_text().split()[0] == "0.250"
    writers.write_log(spark, "cluster", {"size": 8, "prune": True, "seed": 1}, {"seed": 1}, at)
    assert (tmp_path / "o.log").read_text() == "cluster\nOptions:\n\t--size 8\n\t--prune\n"
