"""Ancestry proportions by expectation-maximisation: the steps as joins and aggregates.

z: (chrom, window, hap, sample, cluster), or its counts as ``seen`` gives them. p: (chrom, window, cluster, k, p).
q: (unit, k, q), where the unit is ``sample`` for genome-wide runs, ``hap`` for local ancestry, and any other
column of z, such as a pair of chromosome and haplotype, where a unit has proportions of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.numeric import QN_HIGH, QN_LOW, clamp
from strandworks.functions.store import release, written

CELL = ["chrom", "window", "cluster"]


def _normalised(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def apart(df: DataFrame) -> DataFrame:
    """``df`` for a join by units: both sides are shuffled. A table of proportions is small as a file, its values being
    few, so that Spark would send it whole through the driver to every executor."""
    return df.hint("merge")


def project_p(p: DataFrame) -> DataFrame:
    """Clamp, then make the clusters of a window sum to 1 for each source."""
    return _normalised(p.withColumn("p", clamp(F.col("p"))), "p", ["chrom", "window", "k"])


def project_q(q: DataFrame, unit: str = "sample") -> DataFrame:
    return _normalised(q.withColumn("q", clamp(F.col("q"))), "q", [unit])


def create_p(raw: DataFrame) -> DataFrame:
    return _normalised(raw, "p", ["chrom", "window", "k"])


def check_p(p: DataFrame) -> DataFrame:
    """(chrom, window, k, total, ok)."""
    df = p.groupBy("chrom", "window", "k").agg(F.sum("p").alias("total"))
    return df.withColumn("ok", F.abs(F.col("total") - 1) <= 1e-3)


def seen(z: DataFrame, unit: str = "sample") -> DataFrame:
    """(chrom, window, cluster, unit, n): how often a unit has a cluster; steps over the same z need it once."""
    return z if "n" in z.columns else z.groupBy(*CELL, unit).agg(F.count("*").alias("n"))


def joint(z: DataFrame, p: DataFrame, q: DataFrame, unit: str = "sample") -> DataFrame:
    """(chrom, window, cluster, hap, unit, n, f, v): one row for each haplotype with f = sum of p*q and the
    array v of (k, p, q). Haplotypes of one unit with the same cluster are counted once, n times."""
    pa = p.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("pa"))
    qa = q.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("qa"))
    v = F.expr("zip_with(pa, qa, (a, b) -> named_struct('k', a.k, 'p', a.p, 'q', b.q))")
    # z too may be a small file: neither it nor what is joined to it is sent whole
    df = seen(z, unit).join(apart(pa), CELL).join(apart(qa), unit).withColumn("v", v)
    return df.withColumn("f", F.expr("aggregate(v, 0D, (s, x) -> s + x.p * x.q)")).select(*CELL, unit, "n", "f", "v")


def individual_freq(z, p, q, unit="sample") -> DataFrame:
    """1 / (sum over sources of p q) of each unit's clusters."""
    return joint(z, p, q, unit).select(*CELL, unit, (1 / F.col("f")).alias("h"))


def loglik(z, p, q, unit="sample") -> DataFrame:
    """Sum of log f over all haplotypes, over (cluster alleles * haplotypes)."""
    alleles = p.select(*CELL).distinct().agg(F.count("*").alias("a"))
    haps = z.agg(F.count_distinct("hap").alias("h"))
    return joint(z, p, q, unit).agg(F.sum(F.col("n") * F.ln("f")).alias("l")).crossJoin(alleles).crossJoin(haps).select((F.col("l") / (F.col("a") * F.col("h"))).alias("loglik"))


def accumulate_p(z, p, q, unit="sample") -> DataFrame:
    """(cell, k, acc): sum of q / f."""
    df = joint(z, p, q, unit).select(*CELL, "n", "f", F.inline("v"))
    return df.groupBy(*CELL, "k").agg(F.sum(F.col("n") * F.col("q") / F.col("f")).alias("acc"))


def accumulate_q(z, p, q, unit="sample") -> DataFrame:
    """(unit, k, acc): sum of p / f."""
    df = joint(z, p, q, unit).select(unit, "n", "f", F.inline("v"))
    return df.groupBy(unit, "k").agg(F.sum(F.col("n") * F.col("p") / F.col("f")).alias("acc"))


def p_step(z, p, q, unit="sample") -> DataFrame:
    """New p: p times its sums over the number of haplotypes, clamped, normalised."""
    n = z.agg(F.count_distinct("hap").alias("h"))
    df = p.join(accumulate_p(z, p, q, unit), [*CELL, "k"], "left").crossJoin(F.broadcast(n))
    return project_p(df.select(*CELL, "k", (F.col("p") * F.coalesce("acc", F.lit(0.0)) / F.col("h")).alias("p")))


def q_step(z, p, q, unit="sample") -> DataFrame:
    """New q: q times its sums over the alleles of a unit (2 per window of a sample, 1 of a haplotype)."""
    w = z.select("chrom", "window").distinct().agg((F.count("*") * (2 if unit == "sample" else 1)).alias("w"))
    df = q.join(apart(accumulate_q(z, p, q, unit)), [unit, "k"], "left").crossJoin(F.broadcast(w))
    return project_q(df.select(unit, "k", (F.col("q") * F.coalesce("acc", F.lit(0.0)) / F.col("w")).alias("q")), unit)


def em_sums(z, p, q, unit="sample", fixed_p: bool = False) -> DataFrame:
    """(cell, unit, k, n, ap, aq): sums of q / f by cell and source (unit null) and of p / f by unit and source (cell
    null), with the number of haplotypes of each, from one pass over ``joint``. fixed_p: the second kind only."""
    df = joint(z, p, q, unit).select(*CELL, unit, "n", "f", F.inline("v"))
    sets = [[unit, "k"]] if fixed_p else [[F.col(c) for c in CELL] + [F.col("k")], [F.col(unit), F.col("k")]]
    what = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q") / F.col("f")).alias("ap"), F.sum(F.col("n") * F.col("p") / F.col("f")).alias("aq")]
    if fixed_p:
        return df.groupBy(*sets[0]).agg(*what)
    return df.groupingSets(sets, *CELL, unit, "k").agg(*what)


def em_step(z, p, q, unit="sample", fixed_p: bool = False, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New p and q as written tables: each times its sums over the haplotypes they were taken from, clamped, normalised.

    A window's haplotypes are those of all of its cells, a unit's alleles those that it has in z, so the same
    step serves batches of windows and units with windows of their own.
    """
    both = sums = written(em_sums(z, p, q, unit, fixed_p))
    own = both if fixed_p else both.where("cluster is null")
    q1 = q.join(apart(own.select(unit, "k", "n", "aq")), [unit, "k"], "left").select(unit, "k", (F.col("q") * F.coalesce("aq", F.lit(0.0)) / F.coalesce("n", F.lit(1))).alias("q"))
    q1 = project_q(q1, unit)
    q1 = written(q1 if labels is None else supervised_q(q1, labels))
    p1 = p
    if not fixed_p:
        cells = both.where("cluster is not null").select(*CELL, "k", "n", "ap")
        haps = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("chrom", "window", "k"))
        df = p.join(cells, [*CELL, "k"], "left").withColumn("h", haps)
        p1 = written(project_p(df.select(*CELL, "k", (F.col("p") * F.coalesce("ap", F.lit(0.0)) / F.col("h")).alias("p"))))
    release(sums)
    return p1, q1


def qn_factor(x0: DataFrame, x1: DataFrame, x2: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row c: -sum(u*u) / sum(u*v) clamped, u = x1 - x0, v = (x2 - x1) - u."""
    df = x0.select(*key, F.col(value).alias("a")).join(apart(x1.select(*key, F.col(value).alias("b"))), key).join(apart(x2.select(*key, F.col(value).alias("c"))), key)
    u, v = F.col("b") - F.col("a"), (F.col("c") - F.col("b")) - (F.col("b") - F.col("a"))
    s = df.agg(F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"))
    return s.select(F.when(F.col("uv") == 0, F.lit(QN_LOW)).otherwise(clamp(-F.col("uu") / F.when(F.col("uv") != 0, F.col("uv")), QN_LOW, QN_HIGH)).alias("c"))


def jump(x1: DataFrame, x2: DataFrame, c: DataFrame, key: list[str], value: str) -> DataFrame:
    df = x1.select(*key, F.col(value).alias("a")).join(apart(x2.select(*key, F.col(value).alias("b"))), key).crossJoin(F.broadcast(c))
    return df.select(*key, ((1 - F.col("c")) * F.col("a") + F.col("c") * F.col("b")).alias(value))


def _accelerated(x0: DataFrame, x1: DataFrame, x2: DataFrame, key: list[str], value: str, finish, by: str | None = None) -> DataFrame:
    """finish(the accelerated value of every key from three steps), written; one table holds the three. by: a field of
    the key (chrom, of a pair) that tells problems apart, each with a factor of its own."""
    df = x0.select(*key, F.col(value).alias("a")).join(apart(x1.select(*key, F.col(value).alias("b"))), key).join(apart(x2.select(*key, F.col(value).alias("c"))), key)
    df = written(df.withColumn("problem", F.lit(0) if by is None else F.col(by)))
    u, v = F.col("b") - F.col("a"), (F.col("c") - F.col("b")) - (F.col("b") - F.col("a"))
    s = df.groupBy("problem").agg(F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"))
    c = F.when(F.col("uv") == 0, F.lit(QN_LOW)).otherwise(clamp(-F.col("uu") / F.when(F.col("uv") != 0, F.col("uv")), QN_LOW, QN_HIGH))
    factor = s.select("problem", c.alias("factor"))  # a row per problem
    out = df.join(F.broadcast(factor), "problem").select(*key, ((1 - F.col("factor")) * F.col("b") + F.col("factor") * F.col("c")).alias(value))
    out = written(finish(out))
    release(df)
    return out


def quasi_step(z, p, q, fixed_p: bool = False, unit: str = "sample", labels: DataFrame | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two steps and an accelerated jump, clamped and normalised, as written tables. fixed_p: only q moves. by: a
    field of the unit (``unit.chrom``) that tells problems apart, each of which jumps by a factor of its own.

    Each step is one pass over z; the tables between are deleted.
    """
    counts = z if "n" in z.columns else written(seen(z, unit))
    p1, q1 = em_step(counts, p, q, unit, fixed_p, labels)
    p2, q2 = em_step(counts, p1, q1, unit, fixed_p, labels)
    super_ = (lambda x: x) if labels is None else (lambda x: supervised_q(x, labels))
    new_q = _accelerated(q, q1, q2, [unit, "k"], "q", lambda x: super_(project_q(x, unit)), by)
    new_p = p if fixed_p else _accelerated(p, p1, p2, [*CELL, "k"], "p", project_p)
    for df in (q1, q2) if fixed_p else (q1, q2, p1, p2):
        release(df)
    return new_p, new_q


def of_windows(p: DataFrame, z: DataFrame) -> DataFrame:
    """The cells of p in the windows of z: a step over a batch must not see, or normalise, any other."""
    return p.join(z.select("chrom", "window").distinct(), ["chrom", "window"], "left_semi")


def supervised_p(z: DataFrame, labels: DataFrame, p: DataFrame) -> DataFrame:
    """p of source k from the samples labelled k + 1; sources without any keep theirs."""
    marked = z.join(labels.where("pop > 0"), "sample").withColumn("k", F.col("pop") - 1)
    n = marked.groupBy("chrom", "window", "k").agg(F.count("*").alias("all"))
    c = marked.groupBy(*CELL, "k").agg(F.count("*").alias("n"))
    df = p.join(n, ["chrom", "window", "k"], "left").join(c, [*CELL, "k"], "left")
    new = F.when(F.col("all").isNull(), F.col("p")).otherwise(F.coalesce("n", F.lit(0)) / F.col("all"))
    return project_p(df.select(*CELL, "k", new.alias("p")))


def supervised_q(q: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled samples: nearly all of their own source."""
    df = q.join(labels, "sample", "left")
    own = F.when(F.col("pop") > 0, F.when(F.col("k") == F.col("pop") - 1, F.lit(1 - 1e-5)).otherwise(F.lit(1e-5))).otherwise(F.col("q"))
    labelled = F.coalesce(F.col("pop") > 0, F.lit(False))
    total = F.sum(own).over(Window.partitionBy("sample"))
    return df.select("sample", "k", F.when(labelled, own / total).otherwise(F.col("q")).alias("q"))


def rmse(a: DataFrame, b: DataFrame, key: list[str], value: str = "q") -> DataFrame:
    d = a.select(*key, F.col(value).alias("x")).join(apart(b.select(*key, F.col(value).alias("y"))), key)
    return d.select(F.pow(F.col("x") - F.col("y"), 2).alias("s")).agg(F.sqrt(F.avg("s")).alias("rmse"))


def batch_of(z: DataFrame, batch: int, batches: int, round_: int = 0) -> DataFrame:
    """Windows of one mini-batch: by a hash of the window, so no order has to be shuffled on the driver.
    Another round deals the windows anew."""
    if round_:
        return z.where(F.pmod(F.xxhash64("chrom", "window", F.lit(round_)), F.lit(batches)) == batch)
    return z.where(F.expr(f"(window * 31 + length(chrom) * 7 + ascii(substring(chrom, -1, 1))) % {batches} = {batch}"))
