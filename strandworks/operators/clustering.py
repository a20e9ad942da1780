"""Clustering of a window's distinct haplotypes around majority medians: single steps as DataFrame
operators, and the whole loop as one grouped kernel (windows are independent)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions import bits as B
from strandworks.functions.numeric import clamp

KEY = ["chrom", "window"]


def distances(unique: DataFrame, medians: DataFrame) -> DataFrame:
    """Distance of every distinct haplotype to every median of its window. The medians are joined on
    the window, never crossed; AQE broadcasts them where they are small."""
    m = medians.select(*KEY, "cluster", F.col("bits").alias("median"))
    return unique.join(m, KEY).withColumn("d", B.hamming(F.col("bits"), F.col("median"), B.is_wide(unique)))


def assign_nearest(unique: DataFrame, medians: DataFrame) -> DataFrame:
    """(… unique, cluster, d): the nearest median, the highest cluster of equals."""
    best = F.min(F.struct("d", (-F.col("cluster")).alias("c"), "cluster")).alias("b")
    return distances(unique, medians).groupBy(*KEY, "u_idx", "bits", "n_u").agg(best).select(*KEY, "u_idx", "bits", "n_u", "b.cluster", "b.d")


def cluster_counts(assigned: DataFrame, size: int | None = None) -> DataFrame:
    """(chrom, window, cluster, j, count, n): copies with allele 1 at each SNP, and all copies. Without
    ``size`` every window has its own, in a column of that name."""
    last = F.col("size").cast("int") - 1 if size is None else F.lit(size - 1)
    df = assigned.withColumn("j", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.col("j").cast("long"))
    return df.groupBy(*KEY, "cluster", "j").agg(F.sum(F.col("n_u") * B.bit("bits", "j", B.is_wide(assigned))).alias("count"), F.sum("n_u").alias("n"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(*KEY, "cluster").agg(F.sum("n_u").alias("n"))


def marginal_median(counts: DataFrame) -> DataFrame:
    """(chrom, window, cluster, j, allele): 1 where more than half of the copies have it."""
    return counts.select(*KEY, "cluster", "j", F.expr("if(count > n div 2, 1L, 0L)").alias("allele"))


def medians_of(assigned: DataFrame, size: int | None = None, words: int | None = None) -> DataFrame:
    m = marginal_median(cluster_counts(assigned, size))
    return m.groupBy(*KEY, "cluster").agg(B.pack(F.col("allele"), F.col("j"), words).alias("bits"))


def farthest_point(assigned: DataFrame, limit: int | None = None) -> DataFrame:
    """(chrom, window, u_idx, d, n_u) of the most distant haplotype: then most copies, then first; only
    if its distance reaches ``limit``."""
    top = F.max(F.struct("d", "n_u", (-F.col("u_idx")).alias("u"))).alias("t")
    df = assigned.groupBy(*KEY).agg(top).select(*KEY, (-F.col("t.u")).alias("u_idx"), "t.d", "t.n_u")
    return df if limit is None else df.where(F.col("d") >= limit)


def assignment_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select(*KEY, "u_idx", F.col("cluster").alias("a")).join(new.select(*KEY, "u_idx", F.col("cluster").alias("b")), [*KEY, "u_idx"])
    return both.groupBy(*KEY).agg(F.sum((F.col("a") != F.col("b")).cast("long")).alias("changes"))


def smallest_cluster(sizes: DataFrame) -> DataFrame:
    """The smallest non-empty cluster, the highest of equals."""
    df = sizes.where("n > 0").groupBy(*KEY).agg(F.min(F.struct("n", (-F.col("cluster")).alias("c"))).alias("s"))
    return df.select(*KEY, (-F.col("s.c")).alias("cluster"), "s.n")


def prune_clusters(sizes: DataFrame) -> DataFrame:
    """Drop clusters of one or two copies, if more than two are larger."""
    large = F.sum((F.col("n") > 2).cast("long")).over(Window.partitionBy(*KEY))
    return sizes.withColumn("large", large).where("large <= 2 or n > 2").drop("large")


def compact_ids(sizes: DataFrame) -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("cluster")) - 1
    return sizes.withColumn("compact", rank.cast("long"))


def median_loglik(counts: DataFrame, medians: DataFrame) -> DataFrame:
    """(chrom, window, c1, c2, ll): log-likelihood of the median of c1 under the alleles of c2."""
    p = counts.select(*KEY, F.col("cluster").alias("c2"), "j", clamp(F.col("count") / F.col("n")).alias("p"))
    m = medians.select(*KEY, F.col("cluster").alias("c1"), F.col("bits").alias("median"))
    term = F.when(B.bit("median", "j", B.is_wide(medians)) == 1, F.ln("p")).otherwise(F.ln(1 - F.col("p")))
    return m.join(p, KEY).groupBy(*KEY, "c1", "c2").agg(F.sum(term).alias("ll"))


class Settings:
    """Parameters of the clustering loop."""

    def __init__(self, size: int, lmbda: float = 0.1, min_freq: float = 0.005, min_mac: int | None = None, max_clusters: int = 256, max_iterations: int = 1000, prune: bool = False):
        self.size, self.lmbda, self.min_freq, self.min_mac = size, lmbda, min_freq, min_mac
        self.max_clusters, self.max_iterations, self.prune = max_clusters, max_iterations, prune


def _counts(x: np.ndarray, u: np.ndarray, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(z, u, k).astype(np.int64)
    c = np.zeros((k, x.shape[1]), np.int64)
    np.add.at(c, z, x * u[:, None])
    return n, c


def _words(x: np.ndarray) -> list[np.ndarray]:
    """Rows of 0 and 1 as words of up to 62 bits, one array per word."""
    w = B.WORD
    return [(x[:, k : k + w] << np.arange(min(w, x.shape[1] - k))).sum(1) for k in range(0, x.shape[1], w)]


def _alleles(bits: pd.Series, size: int, wide: bool) -> np.ndarray:
    """Rows of 0 and 1 of packed alleles."""
    words = np.stack(bits.to_list()) if wide else bits.to_numpy(np.int64)[:, None]
    j = np.arange(size)
    return (words[:, j // B.WORD] >> (j % B.WORD)) & 1


def _packed(x: np.ndarray, words: int | None) -> np.ndarray | list:
    """The inverse: a bigint, or so many words, a row."""
    got = _words(x)
    if words is None:
        return got[0]
    return list(np.stack(got + [np.zeros(len(x), np.int64)] * (words - len(got)), 1))


def dp_medians(x: np.ndarray, u: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Clusters (compact ids) of the distinct haplotypes ``x`` (rows in packed order, ``u`` copies each),
    and the medians they were last assigned to.

    Grow: assign to the nearest median, split off the farthest haplotype if it lies beyond the limit,
    recompute medians, until nothing changes. Shrink: drop the smallest cluster below the minimum
    count and reassign, until none is. Two clusters always stay, if there are two haplotypes.
    """
    m, total = x.shape[1], int(u.sum())
    limit = math.ceil(s.lmbda * m)
    mac = s.min_mac or math.ceil(total * s.min_freq)

    def median(n, c):
        return (c > (n // 2)[:, None]).astype(np.int64)

    packed = _words(x)

    def nearest(r, active):
        d = np.zeros((len(x), int(active.sum())), np.int64)
        for a, b in zip(packed, _words(r[active]), strict=True):
            d += np.bitwise_count(a[:, None] ^ b[None, :])
        at = d.shape[1] - 1 - d[:, ::-1].argmin(1)  # the highest of equals
        return np.flatnonzero(active)[at], d[np.arange(len(x)), at]

    z = np.zeros(len(x), np.int64)
    n, c = _counts(x, u, z, 1)
    r = median(n, c)
    if len(x) == 1:
        return z, r
    before = z
    for it in range(s.max_iterations):
        z, d = nearest(r, n > 0)
        k = len(r)
        far = np.lexsort((np.arange(len(x)), -u, -d))[0]
        grown = d[far] >= limit and k < s.max_clusters and limit > 0
        if grown:
            z[far] = k
            r = np.vstack((r, x[far]))
        if it > 0 and (z == before).all() and len(r) > 1:
            break
        if len(r) == 1:  # nothing lies beyond the limit: split all the same
            z[far] = 1
            r = np.vstack((r, x[far]))
        before = z.copy()
        n, c = _counts(x, u, z, len(r))
        fresh = median(n, c)
        r = np.where((n > 0)[:, None], fresh, r)
    n, c = _counts(x, u, z, len(r))
    if (n > 0).sum() > 2:
        if s.prune and (n > 2).sum() > 2:
            n = np.where(n <= 2, 0, n)
        before = z.copy()
        for _ in range(s.max_iterations + len(r)):
            fresh_n, c = _counts(x, u, z, len(r))
            r = np.where((n > 0)[:, None] & (fresh_n > 0)[:, None], median(fresh_n, c), r)
            z, _ = nearest(r, n > 0)
            fresh_n, _ = _counts(x, u, z, len(r))
            n = np.where(n > 0, fresh_n, 0)
            full = np.flatnonzero(n > 0)
            if len(full) <= 2:
                break
            small = full[::-1][n[full][::-1].argmin()]
            if n[small] < mac:
                n[small] = 0
                if (n > 0).sum() == 2:
                    z, _ = nearest(r, n > 0)
                    break
            elif (z == before).all():
                break
            before = z.copy()
    used = np.unique(z)
    return np.searchsorted(used, z), r[used]


def cluster_windows(unique: DataFrame, settings: Settings | None = None, **options) -> DataFrame:
    """Run the loop in every window: (chrom, window, u_idx, bits, n_u, cluster, median).

    Without ``settings`` every window's size is in a column of that name, and ``options`` are those of ``Settings``.
    """
    wide = B.is_wide(unique)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = settings or Settings(int(pdf["size"].iloc[0]), **options)
        pdf = pdf.sort_values("u_idx", ignore_index=True)
        z, r = dp_medians(_alleles(pdf["bits"], own.size, wide), pdf["n_u"].to_numpy(np.int64), own)
        pdf["cluster"] = z
        medians = _packed(r, len(pdf["bits"].iloc[0]) if wide else None)
        pdf["median"] = [medians[k] for k in z]
        return pdf[["chrom", "window", "u_idx", "bits", "n_u", "cluster", "median"]]

    kind = "array<long>" if wide else "long"
    schema = f"chrom string, window long, u_idx long, bits {kind}, n_u long, cluster long, median {kind}"
    columns = [*KEY, "u_idx", "bits", "n_u"] + (["size"] if settings is None else [])
    return unique.select(*columns).groupBy(*KEY).applyInPandas(run, schema)
