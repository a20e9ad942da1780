"""Five verbs: cluster, predict, struct, admix and local ancestry, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions import bits
from strandworks.functions.numeric import clamp
from strandworks.functions.store import release, written
from strandworks.operators import admix as em
from strandworks.operators import clustering, dedup, lai, linalg, predict as prediction, stats, windows


@dataclass
class Clustered:
    """Assignments, medians, window metadata and, if asked for, log-likelihoods of medians."""

    assignments: DataFrame
    medians: DataFrame
    windows: DataFrame
    loglik: DataFrame | None = None


def _words(window_axis: DataFrame) -> int | None:
    """Words of the widest window of the axis; None if all fit into one bigint."""
    last = window_axis.agg(F.max("j")).first()[0]
    return bits.words_for(0 if last is None else last + 1)


def cluster(
    haplotypes: DataFrame, *, size: int | None = None, length: int | None = None, starts: DataFrame | None = None, step: int | None = None,
    lmbda: float = 0.1, min_freq: float = 0.005, min_mac: int | None = None, max_clusters: int = 256, max_iterations: int = 1000,
    prune: bool = False, medians: bool = False,
) -> Clustered:
    """Cluster the haplotypes of every window. Exactly one of size, length and starts is given.

    haplotypes: (chrom, snp, pos, hap, sample, allele), complete and biallelic. Where a window has more than
    62 SNPs, the alleles and medians of all are arrays of words.
    """
    if sum(x is not None for x in (size, length, starts)) != 1:
        raise ValueError("give one of size, length and starts")
    if not 2 <= max_clusters <= 256:
        raise ValueError("max_clusters must be in 2..256")
    bad = haplotypes.where("allele is null or allele not in (0, 1)").limit(1).count()
    if bad:
        raise ValueError("haplotypes must be biallelic without missing calls")
    sn = windows.snps_of(haplotypes)
    if size is not None:
        w = windows.fixed(sn, size) if step is None else windows.sliding(sn, size, step)
    else:
        w = windows.by_length(sn, length) if length is not None else windows.custom(sn, starts)
    packed = dedup.packed(windows.attach(haplotypes, w), _words(w))
    widths = w.groupBy("chrom", "window").agg(F.count("*").alias("size"))
    unique = dedup.unique(packed).join(widths, ["chrom", "window"])
    options = dict(lmbda=lmbda, min_freq=min_freq, min_mac=min_mac, max_clusters=max_clusters, max_iterations=max_iterations, prune=prune)
    done = written(clustering.cluster_windows(unique, **options))
    md = done.groupBy("chrom", "window", "cluster").agg(F.first("median").alias("bits"))
    k = md.groupBy("chrom", "window").agg(F.count("*").alias("k"))
    ll = clustering.median_loglik(clustering.cluster_counts(done.join(widths, ["chrom", "window"])), md) if medians else None
    return Clustered(dedup.assign_haplotypes(packed, done), md, windows.meta(w, k), ll)


def predict(
    calls: DataFrame, medians: DataFrame, window_axis: DataFrame, *, phased: bool = True, compat: bool = False, reference: DataFrame | None = None,
) -> DataFrame:
    """Assign new haplotypes (allele, null if missing) or, unphased, genotypes (dosage) to stored medians.

    reference: (chrom, window, start[, end]) of the medians' windows. Every one of them must open at the
    same position in the new data, and the last one of a chromosome end there; else this raises.
    """
    if reference is not None:
        opened = window_axis.groupBy("chrom", "window").agg(F.min("pos").alias("s"), F.max("pos").alias("e"))
        bad = prediction.align(opened.select("chrom", "window", F.col("s").alias("start")), reference.select("chrom", "window", "start")).where("not ok")
        if bad.limit(1).count():
            raise ValueError(f"windows do not open where the reference's do: {bad.first()}")
        if "end" in reference.columns:
            ends = reference.groupBy("chrom").agg(F.max("end").alias("end")).join(opened.groupBy("chrom").agg(F.max("e").alias("e")), "chrom")
            if ends.where("end <> e").limit(1).count():
                raise ValueError("the new data do not end where the reference does")
    df = windows.attach(calls, window_axis)
    words = None
    if bits.is_wide(medians):  # a median's array is as long as that of every other one
        words = medians.select(F.size("bits").alias("n")).limit(1).first()
        words = words.n if words else None
    if (_words(window_axis) or 1) > (words or 1):
        raise ValueError("a window has more SNPs than the medians hold")
    if phased:
        return prediction.phased(dedup.packed(df, words), medians).drop("d")
    pairs = prediction.unphased(prediction.geno_states(df, words), medians, compat)
    both = F.explode(F.array(F.struct((2 * F.col("sample")).alias("hap"), F.col("c1").alias("cluster")), F.struct((2 * F.col("sample") + 1).alias("hap"), F.col("c2").alias("cluster"))))
    return pairs.select("chrom", "window", "sample", both.alias("x")).select("chrom", "window", "x.hap", "sample", "x.cluster")


def struct_grm(z: DataFrame, *, centering: bool = True) -> DataFrame:
    return stats.grm_centered(z) if centering else stats.grm(z, stats.frequency(z))


def struct_pca(z: DataFrame, n: int, components: int, *, power: int = 11, seed: int = 42):
    """(eigenvalues, eigenvectors (sample, pc, v), loadings, frequencies)."""
    freqs = stats.frequency(z)
    rows = written(linalg.allele_entries(z, freqs))
    s, v, m = linalg.svd(rows, n, components, power=power, seed=seed)
    return s * s / m, v, linalg.loadings(rows, s, v), freqs


def struct_project(z: DataFrame, freqs: DataFrame, loadings: DataFrame, eigvals: DataFrame, alleles: int) -> DataFrame:
    return linalg.project(z, freqs, loadings, eigvals, alleles)


def em_iterations(z: DataFrame, p: DataFrame, q: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """n plain EM steps."""
    for _ in range(n):
        p, q = em.p_step(z, p, q), em.q_step(z, p, q)
    return p, q


def admix_start(
    z: DataFrame, k: int, *, labels: DataFrame | None = None, p: DataFrame | None = None, random: bool = False, windows: DataFrame | None = None,
    seed: int = 42, iterations: int = 1000, tolerance: float = 1e-4, power: int = 11, subsampling: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(p, q) to start from: p as given (projection, its sums checked), from labelled samples (supervised), at
    random, or else by least squares on the principal components of ``windows``.

    Without ``windows`` these are those of one chromosome in ``subsampling`` (the first ones by name, one at least),
    of all where there is but one chromosome.
    Random numbers come from a hash of the cell and the seed, so they are the same on every run.
    """
    noise = lambda *c: clamp((F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30))
    sources = F.explode(F.expr(f"sequence(0L, {k - 1}L)")).alias("k")
    cells = lambda: z.select("chrom", "window", "cluster").distinct().select("chrom", "window", "cluster", sources)
    q = z.select("sample").distinct().select("sample", sources).withColumn("q", noise("sample", "k"))
    q = q.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("sample")))
    if p is not None:
        if em.check_p(p).where("not ok").limit(1).count():
            raise ValueError("frequencies do not sum to 1")
        return p, written(q)
    if labels is not None:
        if labels.where(~F.coalesce(F.col("pop").between(0, k), F.lit(False))).limit(1).count():
            raise ValueError(f"labels must be in 0..{k}")
        start = em.create_p(cells().withColumn("p", noise("chrom", "window", "cluster", "k")))
        return written(em.supervised_p(z, labels, start)), written(em.supervised_q(q, labels))
    if random:
        return written(em.create_p(cells().withColumn("p", noise("chrom", "window", "cluster", "k")))), written(q)
    ids = written(z.select("sample").distinct())
    n = ids.agg(F.max("sample") + 1).first()[0]
    rows = written(linalg.allele_entries(z, stats.frequency(z)))
    if windows is None:
        if subsampling < 2:
            raise ValueError("subsampling must be at least 2")
        chroms = [r.chrom for r in z.select("chrom").distinct().orderBy("chrom").collect()]  # a row per chromosome
        if len(chroms) > 1:
            windows = rows.where(F.col("chrom").isin(chroms[: -(-len(chroms) // subsampling)])).select("chrom", "window").distinct()
    start, own = linalg.als_init(rows, n, k, iterations=iterations, tolerance=tolerance, power=power, seed=seed, windows=windows)
    # alleles that do not vary have no row of their own: they keep their frequency in every source
    fixed = cells().join(start, ["chrom", "window", "cluster", "k"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return written(em.project_p(fixed)), written(own.join(ids, "sample", "left_semi"))


def admix(
    z: DataFrame, p: DataFrame, q: DataFrame, *, iterations: int = 1000, tolerance: float = 1e-9, batches: int = 16, check: int = 5,
    labels: DataFrame | None = None, projection: bool = False, unit: str = "sample",
) -> tuple[DataFrame, DataFrame, float]:
    """Accelerated EM from the given start; (p, q, log-likelihood).

    Mini-batches of windows, dealt anew in every iteration and halved whenever a check finds no progress, then full steps until the
    log-likelihood gains less than the tolerance. Everything is one row per parameter; a step's tables
    are cut from their lineage before the next.
    """
    counts = written(em.seen(z, unit))
    value = lambda p, q: _loglik(counts, p, q, unit)

    def quasi(p, q, part=None):
        if part is None or projection:
            return em.quasi_step(counts if part is None else part, p, q, projection, unit, labels)
        # the factor of a batch, like its steps, is of the batch's windows alone
        new_p, new_q = em.quasi_step(part, em.of_windows(p, part), q, projection, unit, labels)
        key = ["chrom", "window"]
        whole = written(new_p.unionByName(p.join(part.select(*key).distinct(), key, "left_anti")))
        release(new_p)
        return whole, new_q

    step = lambda p, q: em.em_step(counts, p, q, unit, projection, labels)
    given = p, q

    def move(how, *more):
        """The next p and q; those before are deleted, unless the caller gave them."""
        nonlocal p, q
        old = p, q
        p, q = how(p, q, *more)
        for df in old:
            if all(df is not x for x in (*given, p, q)):
                release(df)

    n_windows = z.select("chrom", "window").distinct().count()
    batches = max(1, min(batches, n_windows))
    before = best = value(p, q)  # of full steps, and of the batches of this size
    for how in (step, quasi, step):
        move(how)
    for it in range(1, iterations + 1):
        if batches > 1:
            for b in range(batches):
                part = em.batch_of(counts, b, batches, it)
                if part.limit(1).count():
                    move(quasi, part)
            move(quasi)
        else:
            for how in (step, quasi) if projection else (quasi, step):
                move(how)
        if it % check == 0:
            now = value(p, q)
            if batches > 1:
                if now < best + tolerance:
                    batches, best, before = batches // 2, float("-inf"), now
                    move(quasi)
                else:
                    best = now
            elif now < before + tolerance:
                break
            else:
                before = now
    return p, q, value(p, q)


def _loglik(counts: DataFrame, p: DataFrame, q: DataFrame, unit: str) -> float:
    """Log-likelihood over cluster alleles and haplotypes, of counted z."""
    alleles = p.select("chrom", "window", "cluster").distinct().count()
    total, haps = em.joint(counts, p, q, unit).groupBy("chrom", "window").agg(F.sum(F.col("n") * F.ln("f")).alias("l"), F.sum("n").alias("h")).agg(F.sum("l"), F.max("h")).first()
    return total / (alleles * haps)


def chromosome_q(
    z: DataFrame, p: DataFrame, q: DataFrame, *, iterations: int = 1000, tolerance: float = 1e-9, batches: int = 8, check: int = 5,
) -> DataFrame:
    """(chrom, hap, k, q): proportions of every haplotype on each chromosome, by projection on p from q: (hap, k, q).

    Every chromosome is a problem of its own, with its own factor, batches and end, but all of them move in the
    same passes: the unit is the pair of chromosome and haplotype, and a chromosome that is done is masked. What
    the driver holds is a row per chromosome.
    """
    unit = F.struct("chrom", "hap").alias("unit")
    counts = written(em.seen(z.select("chrom", "window", "cluster", unit), "unit"))
    own = z.select("chrom", "hap").distinct().join(em.apart(q), "hap").select(unit, "k", "q")
    now = written(own)
    windows_of = {r.chrom: r.n for r in counts.groupBy("chrom").agg(F.count_distinct("window").alias("n")).collect()}  # a row per chromosome
    if not windows_of:
        return own.select("unit.chrom", "unit.hap", "k", "q")
    alleles = {r.chrom: r.n for r in p.select("chrom", "window", "cluster").distinct().groupBy("chrom").agg(F.count("*").alias("n")).collect()}

    def value(chroms):
        got = em.joint(counts.where(F.col("chrom").isin(chroms)), p, now, "unit").groupBy("chrom", "window").agg(F.sum(F.col("n") * F.ln("f")).alias("l"), F.sum("n").alias("h"))
        return {r.chrom: r.l / (alleles[r.chrom] * r.h) for r in got.groupBy("chrom").agg(F.sum("l").alias("l"), F.max("h").alias("h")).collect()}

    def moved(chroms, how, part=None):
        """q after a step of these chromosomes; that of others stays."""
        here, mine = F.col("chrom").isin(chroms), F.col("unit.chrom").isin(chroms)
        new = how((counts if part is None else part).where(here), now.where(mine))
        out = written(new.unionByName(now.where(~mine)))
        release(new)
        release(now)
        return out

    quasi = lambda z, q: em.quasi_step(z, p, q, True, "unit", by="unit.chrom")[1]
    step = lambda z, q: em.em_step(z, p, q, "unit", True)[1]
    live = {c: max(1, min(batches, n)) for c, n in windows_of.items()}
    best = value(list(live))
    before = dict(best)
    for how in (step, quasi, step):
        now = moved(list(live), how)
    for it in range(1, iterations + 1):
        several = {c: n for c, n in live.items() if n > 1}
        for b in range(max(several.values(), default=0)):
            chroms = [c for c, n in several.items() if b < n]
            of = F.create_map(*[F.lit(x) for c in chroms for x in (c, several[c])])
            part = counts.where(F.col("chrom").isin(chroms)).where(F.pmod(F.xxhash64("chrom", "window", F.lit(it)), of[F.col("chrom")]) == b)
            filled = [r.chrom for r in part.select("chrom").distinct().collect()]
            if filled:
                now = moved(filled, quasi, part)
        now = moved(list(live), quasi)
        if single := [c for c, n in live.items() if n == 1]:
            now = moved(single, step)
        if it % check == 0:
            halved = []
            for c, got in value(list(live)).items():
                if live[c] > 1:
                    if got < best[c] + tolerance:
                        live[c], best[c], before[c] = live[c] // 2, float("-inf"), got
                        halved.append(c)
                    else:
                        best[c] = got
                elif got < before[c] + tolerance:
                    del live[c]
                else:
                    before[c] = got
            if halved:
                now = moved(halved, quasi)
            if not live:
                break
    return now.select("unit.chrom", "unit.hap", "k", "q")


def local_ancestry(
    z: DataFrame, p: DataFrame, q: DataFrame, meta: DataFrame, *, block: int = 1, min_length: float | None = None, max_length: float | None = None,
    quantile: float | None = None, alpha: float | None = None, alpha_min: float = 4, alpha_max: float = 9, alpha_num: int = 5,
    loglik: DataFrame | None = None, use_viterbi: bool = False, simple: bool = False, posteriors: bool = False,
    genome_wide: bool = False, **admix_options,
) -> DataFrame:
    """(chrom, window, hap, k[, prob]): the ancestry of every haplotype along the windows. q: (hap, k, q).

    Every chromosome's own proportions are estimated first, from its windows, with p fixed and q as the
    start; admix_options (iterations, tolerance, batches, check) are for that. genome_wide: q stays as it is.
    """
    if not genome_wide:
        q = chromosome_q(z, p, q, **admix_options)
    use = lai.window_length_filter(meta, min_length, max_length, quantile)
    if loglik is not None:
        e = lai.emissions_soft(z, p, lai.softmax_loglik(loglik), block, windows=use)
    else:
        e = lai.emissions_hard(z, p, block, use)
    spark = z.sparkSession
    rates = spark.range(1).select(F.lit(alpha).alias("alpha")) if alpha is not None else lai.alpha_grid(spark, alpha_min, alpha_max, alpha_num)
    c = lai.chains(e, q, rates)
    if use_viterbi:
        path = lai.majority_vote(lai.viterbi(c, simple)).drop("votes")
    else:
        decoded = lai.posterior_decode(lai.posterior(c, simple))
        path = lai.majority_vote(decoded).drop("votes")
        if posteriors:
            path = path.join(lai.weighted_median(decoded, path), ["chrom", "hap", "block"])
    return lai.block_expand(path, meta, block)
