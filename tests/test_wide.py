"""Windows of more than 62 SNPs, and the bound of the unphased search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import bits as B
from strandworks.operators import clustering, dedup, predict, windows
from strandworks.plans import verbs
from strandworks.sources import codecs, writers


def haplotypes(spark, alleles):
    """alleles: [hap, snp], None as missing."""
    rows = [("c", j, 10 + 3 * j, i, i // 2, a if a is None else int(a)) for i, row in enumerate(alleles) for j, a in enumerate(row)]
    return spark.createDataFrame(rows, "chrom string, snp long, pos long, hap long, sample long, allele long")


def test_words():
    assert [B.words_for(n) for n in (0, 62, 63, 124, 125)] == [None, None, 2, 2, 3]


@pytest.mark.parametrize("snps, size", [(130, 65), (200, 100), (63, 63)])
def test_cluster_equals_the_kernel_on_the_matrix(spark, snps, size):
    r = np.random.default_rng(snps)
    founders = r.integers(0, 2, (4, snps))
    x = founders[r.integers(0, 4, 40)] ^ (r.random((40, snps)) < 0.02)
    made = verbs.cluster(haplotypes(spark, x), size=size, lmbda=0.2, medians=True)
    got = {(a.window, a.hap): a.cluster for a in made.assignments.collect()}
    n_windows = snps // size
    for w in range(n_windows):
        part = x[:, w * size : (w + 1) * size if w < n_windows - 1 else snps]
        kinds, back, count = np.unique(part[:, ::-1], axis=0, return_inverse=True, return_counts=True)
        z, _ = clustering.dp_medians(kinds[:, ::-1].astype(np.int64), count, clustering.Settings(part.shape[1], 0.2))
        assert [got[w, i] for i in range(40)] == z[back.ravel()].tolist()
    assert made.loglik.count() > 0 and B.is_wide(made.medians)


def test_wide_and_narrow_agree(spark):
    """The same windows as words and as one bigint."""
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (3, 40))[r.integers(0, 3, 30)] ^ (r.random((30, 40)) < 0.05)
    h = haplotypes(spark, x)
    w = windows.fixed(windows.snps_of(h), 20)
    rows = windows.attach(h, w)
    narrow, wide = dedup.unique(dedup.packed(rows)), dedup.unique(dedup.packed(rows, 2))
    plain = lambda df, c: sorted((a.window, a.u_idx, a[c][0] if isinstance(a[c], list) else a[c], a.n_u) for a in df.collect())
    assert plain(narrow, "bits") == plain(wide, "bits")
    a, b = (clustering.cluster_windows(u, clustering.Settings(20, 0.2)) for u in (narrow, wide))
    assert plain(a, "median") == plain(b, "median")


def test_predict_wide_with_missing_calls(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.integers(0, 2, (3, 150))[r.integers(0, 3, 30)] ^ (r.random((30, 150)) < 0.02)
    h = haplotypes(spark, x)
    axis = windows.fixed(windows.snps_of(h), 75)
    made = verbs.cluster(h, size=75, lmbda=0.2)
    holes = [[None if r.random() < 0.2 else a for a in row] for row in x]
    got = {(a.window, a.hap): a.cluster for a in verbs.predict(haplotypes(spark, holes), made.medians, axis).collect()}
    medians = {(m.window, m.cluster): m.bits for m in made.medians.collect()}
    for (w, i), cluster in got.items():
        d = {c: sum(a is not None and a != (m[j // 62] >> (j % 62)) & 1 for j, a in enumerate(holes[i][75 * w : 75 * w + 75])) for (v, c), m in medians.items() if v == w}
        assert (d[cluster], -cluster) == min((n, -c) for c, n in d.items())
    with pytest.raises(ValueError, match="more SNPs"):
        verbs.predict(h, verbs.cluster(h, size=50).medians, axis)
    # the median file holds a byte per SNP, whatever the packing
    path = writers.write_medians(made.medians, made.windows, str(tmp_path / "x"))[0]
    data = (tmp_path / path.rsplit("/", 1)[1]).read_bytes()
    order = sorted(medians)
    assert data == codecs.MAGIC + bytes((medians[k][j // 62] >> (j % 62)) & 1 for k in order for j in range(75))


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("compat", [False, True])
def test_unphased_search_equals_all_pairs(spark, wide, compat):
    r = random.Random(4)
    n = 70 if wide else 9
    words = B.words_for(n)
    split = lambda v: [(v >> (62 * k)) & ((1 << 62) - 1) for k in range(words)] if wide else v
    medians = [("c", 0, k, r.getrandbits(n)) for k in range(12)]
    rows = []
    for s in range(40):
        a, b = (medians[r.randrange(12)][3] for _ in range(2))
        noise = sum(1 << j for j in range(n) if r.random() < 0.05)
        a, missing = a ^ noise, sum(1 << j for j in range(n) if r.random() < 0.1)
        hom_mask = ~(a ^ b) & ~missing & ((1 << n) - 1)
        rows.append((s, a & hom_mask, hom_mask, (a ^ b) & ~missing))
    kind = "array<long>" if wide else "long"
    states = spark.createDataFrame([("c", 0, s, *map(split, v)) for s, *v in rows], f"chrom string, window long, sample long, hom {kind}, hom_mask {kind}, het {kind}")
    md = spark.createDataFrame([(c, w, k, split(b)) for c, w, k, b in medians], f"chrom string, window long, cluster long, bits {kind}")
    got = {x["sample"]: (x.c1, x.c2, x.t) for x in predict.unphased(states, md, compat).collect()}
    for s, hom, mask, het in rows:
        best = None
        for _, _, i, a in medians:
            for _, _, j, b in medians:
                t = 2 * ((hom ^ a) & mask).bit_count() + ((hom ^ b) & mask).bit_count() + (~(a ^ b) & het).bit_count()
                late = compat and t > 0 and float(np.float32(0.33 * t)) > 0.33 * t
                key = (t, -i if late else i, -j if late else j)
                if best is None or key < best[0]:
                    best = key, (i, j, t)
        assert got[s] == best[1]


def test_alleles_spelled(spark):
    df = spark.createDataFrame([([5, 1], 64)], "bits array<long>, size long")
    assert df.select(B.alleles("bits", F.col("size"), True).alias("a")).first().a == [1, 0, 1] + [0] * 59 + [1, 0]
