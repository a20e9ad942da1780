"""Local ancestry: emissions, transitions, hidden Markov decoding and voting over switch rates.

Chains are one row per unit: arrays over blocks, so decoding is one shuffle by haplotype and then one
pass of numpy kernels over batches of chains (``chains``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.operators import chains as kernels

CELL = ["chrom", "window", "cluster"]


def window_length_filter(meta: DataFrame, least: float | None = None, most: float | None = None, quantile: float | None = None) -> DataFrame:
    """Windows whose length lies in [least, most], or in the central ``quantile`` of all lengths."""
    if quantile is None:
        cond = F.lit(True)
        if least is not None:
            cond &= F.col("length") >= least
        if most is not None:
            cond &= F.col("length") <= most
        return meta.where(cond)
    lo = (1 - quantile) / 2
    bounds = meta.agg(F.percentile("length", F.lit(lo)).alias("lo"), F.percentile("length", F.lit(1 - lo)).alias("hi"))
    return meta.crossJoin(F.broadcast(bounds)).where(F.col("length").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def emissions_hard(z: DataFrame, p: DataFrame, block: int = 1, windows: DataFrame | None = None) -> DataFrame:
    """(chrom, hap, block, k, e): sums of log p over a block's windows; filtered-out windows add 0."""
    df = z.join(p.select(*CELL, "k", "p"), CELL)
    ll = F.ln("p")
    if windows is not None:
        df = df.join(windows.select("chrom", "window", F.lit(1).alias("use")), ["chrom", "window"], "left")
        ll = F.when(F.col("use") == 1, ll).otherwise(F.lit(0.0))
    # windows of one cluster share their term: the haplotype axis joins after the logarithm
    return df.withColumn("block", F.expr(f"window div {block}")).groupBy("chrom", "hap", "block", "k").agg(F.sum(ll).alias("e"))


def softmax_loglik(ll: DataFrame) -> DataFrame:
    """exp(ll) over each row (c1) of a window's matrix, normalised."""
    top = F.max("ll").over(Window.partitionBy("chrom", "window", "c1"))
    e = ll.withColumn("l", F.exp(F.col("ll") - top))
    return e.select("chrom", "window", "c1", "c2", (F.col("l") / F.sum("l").over(Window.partitionBy("chrom", "window", "c1"))).alias("l"))


def emissions_soft(z: DataFrame, p: DataFrame, soft: DataFrame, block: int = 1, compat: bool = False, windows: DataFrame | None = None) -> DataFrame:
    """Mixture emissions: log of the sum over clusters of l[z, c] * p[c]; filtered-out windows add 0. compat:
    p of the own cluster only."""
    if compat:
        return emissions_hard(z, p, block, windows)
    mixed = soft.join(p.select("chrom", "window", F.col("cluster").alias("c2"), "k", "p"), ["chrom", "window", "c2"])
    cell = mixed.groupBy("chrom", "window", F.col("c1").alias("cluster"), "k").agg(F.ln(F.sum(F.col("l") * F.col("p"))).alias("e"))
    if windows is not None:
        cell = cell.join(windows.select("chrom", "window", F.lit(1).alias("use")), ["chrom", "window"], "left")
        cell = cell.withColumn("e", F.when(F.col("use") == 1, F.col("e")).otherwise(F.lit(0.0))).drop("use")
    return z.join(cell, CELL).withColumn("block", F.expr(f"window div {block}")).groupBy("chrom", "hap", "block", "k").agg(F.sum("e").alias("e"))


def transition(q: DataFrame, alphas: DataFrame, simple: bool = False) -> DataFrame:
    """(unit, alpha, k1, k2, t): log of moving from k2 to k1. simple: stay with exp(-alpha) exactly."""
    unit = q.columns[0]
    e = F.exp(-F.col("alpha"))
    to = q.select(unit, F.col("k").alias("k1"), "q")
    df = to.join(q.select(unit, F.col("k").alias("k2")), unit).crossJoin(F.broadcast(alphas))
    same = F.col("k1") == F.col("k2")
    if simple:
        t = F.when(same, F.ln(e)).otherwise(F.ln((1 - e) * F.col("q")))
    else:
        t = F.ln((1 - e) * F.col("q") + F.when(same, e).otherwise(F.lit(0.0)))
    return df.select(unit, "alpha", "k1", "k2", t.alias("t"))


def alpha_grid(spark, low: float = 4, high: float = 9, n: int = 5) -> DataFrame:
    """n rates, evenly spaced in the exponent from 10**-high to 10**-low."""
    step = (high - low) / max(1, n - 1)
    return spark.range(n).select(F.col("id").alias("i"), F.pow(F.lit(10.0), F.lit(-float(high)) + F.col("id") * F.lit(step)).alias("alpha"))


def chains(emissions: DataFrame, q: DataFrame, alphas: DataFrame) -> DataFrame:
    """(chrom, hap, alpha, q, e): arrays of q and of emissions e[block][k], one row per chain and rate.
    q: (hap, k, q), or (chrom, hap, k, q) where every chromosome has its own."""
    rows = emissions.groupBy("chrom", "hap", "block").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("v"))
    rows = rows.select("chrom", "hap", "block", F.transform("v", lambda x: x["e"]).alias("e"))
    e = rows.groupBy("chrom", "hap").agg(F.sort_array(F.collect_list(F.struct("block", "e"))).alias("v")).select("chrom", "hap", F.transform("v", lambda x: x["e"]).alias("e"))
    unit = [c for c in ("chrom", "hap") if c in q.columns]
    qa = q.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("v")).select(*unit, F.transform("v", lambda x: x["q"]).alias("q"))
    return e.join(qa, unit).crossJoin(F.broadcast(alphas.select("alpha")))


def _run(chains_: DataFrame, kernel, name: str, kind: str, simple: bool) -> DataFrame:
    arrow = {"double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}[kind]
    run = kernels.over_batches(lambda e, q, alpha: kernel(e, q, alpha, simple), name, arrow)
    return chains_.select("chrom", "hap", "alpha", "q", "e").mapInArrow(run, f"chrom string, hap long, alpha double, {name} {kind}")


def viterbi(chains_: DataFrame, simple: bool = False) -> DataFrame:
    """(chrom, hap, alpha, block, k): the most likely path; of equals the lowest source."""
    path = _run(chains_, kernels.best_paths, "path", "array<long>", simple)
    return path.select("chrom", "hap", "alpha", F.posexplode("path").alias("block", "k")).withColumn("block", F.col("block").cast("long"))


def forward(chains_: DataFrame, simple: bool = False) -> DataFrame:
    """(chrom, hap, alpha, loglik)."""
    return _run(chains_, kernels.likelihoods, "loglik", "double", simple)


def posterior(chains_: DataFrame, simple: bool = False) -> DataFrame:
    """(chrom, hap, alpha, block, k, p): forward times backward over the total."""
    post = _run(chains_, kernels.posteriors, "post", "array<array<double>>", simple)
    df = post.select("chrom", "hap", "alpha", F.posexplode("post").alias("block", "v")).select("chrom", "hap", "alpha", F.col("block").cast("long").alias("block"), F.posexplode("v").alias("k", "p"))
    return df.withColumn("k", F.col("k").cast("long"))


def posterior_decode(post: DataFrame) -> DataFrame:
    """(…, k, p): the most probable source of each block, the lowest of equals."""
    best = F.max(F.struct("p", (-F.col("k")).alias("m"))).alias("b")
    return post.groupBy("chrom", "hap", "alpha", "block").agg(best).select("chrom", "hap", "alpha", "block", (-F.col("b.m")).alias("k"), "b.p")


def majority_vote(decoded: DataFrame) -> DataFrame:
    """(chrom, hap, block, k, votes): the most frequent source over the rates, the lowest of equals."""
    n = decoded.groupBy("chrom", "hap", "block", "k").agg(F.count("*").alias("votes"))
    best = F.max(F.struct("votes", (-F.col("k")).alias("m"))).alias("b")
    return n.groupBy("chrom", "hap", "block").agg(best).select("chrom", "hap", "block", (-F.col("b.m")).alias("k"), "b.votes")


def weighted_median(decoded: DataFrame, voted: DataFrame) -> DataFrame:
    """(chrom, hap, block, prob): median posterior among the rates that agree with the vote, times their share."""
    df = decoded.join(voted.select("chrom", "hap", "block", F.col("k").alias("win")), ["chrom", "hap", "block"])
    agree = F.col("k") == F.col("win")
    return df.groupBy("chrom", "hap", "block").agg((F.percentile(F.when(agree, F.col("p")), F.lit(0.5)) * F.avg(agree.cast("double"))).alias("prob"))


def block_expand(path: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """Blocks back to windows; the last block covers what is left."""
    w = windows.select("chrom", "window", F.expr(f"window div {block}").alias("block"))
    return path.join(w, ["chrom", "block"]).drop("block")
