"""Dosages, frequencies and relationship matrices of cluster alleles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.store import written

ALLELE = ["chrom", "window", "cluster"]


def dosage(z: DataFrame) -> DataFrame:
    """(chrom, window, cluster, sample, z): copies of the cluster allele, zeros left out."""
    return z.groupBy(*ALLELE, "sample").agg(F.count("*").alias("z"))


def frequency(z: DataFrame) -> DataFrame:
    n = F.sum("n").over(Window.partitionBy("chrom", "window"))
    return z.groupBy(*ALLELE).agg(F.count("*").alias("n")).select(*ALLELE, (F.col("n") / n).alias("p"))


def allele_offsets(k: DataFrame) -> DataFrame:
    """(chrom, window, k, offset): number of cluster alleles in the windows before. One row per window."""
    before = Window.orderBy("chrom", "window").rowsBetween(Window.unboundedPreceding, -1)
    return k.select("chrom", "window", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))


def dense(z: DataFrame, freqs: DataFrame) -> DataFrame:
    """(allele, sample, z, p) with zeros filled in."""
    samples = z.select("sample").distinct()
    grid = freqs.crossJoin(samples)  # the dense matrix itself is asked for
    return grid.join(dosage(z), [*ALLELE, "sample"], "left").withColumn("z", F.coalesce("z", F.lit(0)))


def centered(z: DataFrame, freqs: DataFrame) -> DataFrame:
    return dense(z, freqs).select(*ALLELE, "sample", (F.col("z") - 2 * F.col("p")).alias("x"))


def standardized(z: DataFrame, freqs: DataFrame) -> DataFrame:
    """(z - 2p) / sqrt(2p(1-p)); alleles that do not vary give 0."""
    scale = F.sqrt(2 * F.col("p") * (1 - F.col("p")))
    return dense(z, freqs).select(*ALLELE, "sample", F.when(scale > 0, (F.col("z") - 2 * F.col("p")) / scale).otherwise(F.lit(0.0)).alias("x"))


def denominator(freqs: DataFrame) -> DataFrame:
    return freqs.agg(F.sum(F.col("p") * (1 - F.col("p"))).alias("d"))


#: Rows that a tile of a matrix of pairs takes at a time; samples in a block; sample ids from which blocks are made;
#: entries of a block at most; partitions of blocks at most, unless they would hold more than that.
STEP, SPAN, CHUNK, BLOCK, GROUPS = 1024, 1024, 8192, 1 << 24, 128


def _placed(marks: DataFrame, span: int) -> DataFrame:
    """(sample, m, b, at): the samples of a run of ids in blocks of ``span``, those with like values side by side.

    A block of a later run has the greater ids throughout; of like samples the pairs' values repeat, which files store in little."""
    per = max(1, CHUNK // span)
    run, at = F.expr(f"sample div {per * span}"), F.row_number().over(Window.partitionBy("run").orderBy("like", "sample")) - 1
    own = marks.withColumn("run", run).withColumn("at", at)
    return own.select("sample", F.col("m").cast("double").alias("m"), F.expr(f"run * {per} + at div {span}").alias("b"), F.expr(f"at % {span}").cast("long").alias("at"))


def products(entries: DataFrame, marks: DataFrame, *, span: int, parts: int, tile: int, constant: float = 0.0, factor: float = 1.0) -> DataFrame:
    """(i, j, g), i >= j, for all pairs of marked samples: (sum of x_i x_j - m_i - m_j + constant) * factor.

    entries: (sample, part, row, x), the values that are not zero; rows of a part are numbered from 0. marks: (sample, m,
    like), a row per sample; samples with equal values have equal ``like``. The entries of ``span`` samples on one part are packed into one row.
    Every two partitions of packed rows meet in a task, which reads both and copies neither to disk, so the disk holds
    each entry a few times however many pairs there are. A task multiplies two packed rows, ``tile`` samples by ``span`` at a time, and adds
    up the parts; all parts of a block are in one partition. Pairs are rows only in the result, which is dense by definition.
    """
    placed = written(_placed(marks, span))
    own = entries.join(placed.select("sample", "b", "at").hint("merge"), "sample").select("sample", "b", "at", "part", "row", F.col("x").cast("double").alias("x"))
    both = own.unionByName(placed.select("sample", "b", "at", F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("row"), F.col("m").alias("x")))

    def pack(key, group):
        sample, at, row, x = (group.column(c).to_numpy() for c in ("sample", "at", "row", "x"))
        order = np.lexsort((at, row))
        head, rest = np.split(order, [np.count_nonzero(row < 0)])  # the marks are in order of their place
        cells = {"row": row[rest].astype(np.int32), "at": at[rest].astype(np.int32), "x": x[rest], "ids": sample[head].astype(np.int64), "m": x[head]}
        return pa.table({"b": [key[0].as_py()], "part": [key[1].as_py()], **{n: pa.array([v.tobytes()], pa.binary()) for n, v in cells.items()}})

    packed = written(both.groupBy("b", "part").applyInArrow(pack, "b long, part long, row binary, at binary, x binary, ids binary, m binary"))
    blocks, held = packed.agg(F.count_distinct("b"), F.sum(F.length("x") / 8)).first()
    dealt = packed.repartitionByRange(max(1, min(blocks, max(8, min(GROUPS, -(-blocks // 2)), -(-int(held or 0) // BLOCK)))), "b")
    left, right = (dealt.select(*[F.col(c).alias(side + c) for c in packed.columns]) for side in "ij")
    meet = F.col("ib") >= F.col("jb")
    met = left.hint("shuffle_replicate_nl").join(right, meet if parts == 1 else meet & (F.col("ipart") == F.col("jpart")))

    def product(row, side):
        """The product of two packed rows, and the marks with their samples, if they have them."""
        cells = [(np.frombuffer(row[s + "row"], np.int32), np.frombuffer(row[s + "at"], np.int32), np.frombuffer(row[s + "x"])) for s in "ij"]
        heads = [(np.frombuffer(row[s + "ids"], np.int64), np.frombuffer(row[s + "m"])) for s in "ij"]
        g = np.zeros([len(ids) if parts == 1 else side for ids, _ in heads])
        most = min((int(r[-1]) + 1 if len(r) else 0 for r, _, _ in cells))
        for low in range(0, most, STEP):
            x, y = np.zeros((min(STEP, most - low), g.shape[0])), np.zeros((min(STEP, most - low), g.shape[1]))
            for dense, (r, at, v) in zip((x, y), cells):
                a, b = np.searchsorted(r, (low, min(low + STEP, most)))
                dense[r[a:b] - low, at[a:b]] = v[a:b]
            for k in range(0, len(g), tile):
                g[k : k + tile] += x[:, k : k + tile].T @ y
        return g, heads

    def pairs(g, heads, same):
        """The pairs of two blocks as arrays, a row per sample with those not after it, a few samples at a time."""
        (ids, m), (others, n) = heads
        g = (g[: len(ids), : len(others)] - m[:, None] - n + constant) * factor
        whole = not same and ids.min() > others.max()
        for a, b, v in ((ids, others, g),) if same or whole else ((ids, others, g), (others, ids, g.T)):
            if not whole:
                order = np.argsort(b)
                b, v = b[order], v[:, order]
            few = max(1, (1 << 18) // len(b))
            for k in range(0, len(a), few):
                i = a[k : k + few]
                size = np.searchsorted(b, i, "right") if not whole else np.full(len(i), len(b))
                kept, ends = np.arange(len(b)) < size[:, None], pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                js, values = (pa.ListArray.from_arrays(ends, pa.array(x[kept])) for x in (np.broadcast_to(b, kept.shape), v[k : k + few]))
                yield pa.record_batch([pa.array(i), js, values], names=["i", "js", "v"])

    def run(it):
        sums = {}
        for batch in it:
            names = batch.schema.names
            for values in zip(*(batch.column(c) for c in names)):
                row = {c: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for c, v in zip(names, values)}
                key = row["ib"], row["jb"]
                g, heads = product(row, span)
                if parts == 1:
                    yield from pairs(g, heads, key[0] == key[1])
                    continue
                of = sums.setdefault(key, [0.0, None])
                of[0] = of[0] + g
                of[1] = heads if row["ipart"] == 0 else of[1]
        for key, (g, heads) in sums.items():
            yield from pairs(g, heads, key[0] == key[1])

    rows = met.mapInArrow(run, "i long, js array<long>, v array<double>")
    return rows.select("i", "js", F.posexplode("v").alias("c", "g")).select("i", F.expr("js[c]").alias("j"), "g")


def numbered(alleles: DataFrame, parts: int) -> DataFrame:
    """The alleles with a part, by hash, and a row within it."""
    part = F.pmod(F.xxhash64(*ALLELE), F.lit(parts))
    return alleles.withColumn("part", part).withColumn("row", (F.row_number().over(Window.partitionBy("part").orderBy(*ALLELE)) - 1).cast("long"))


def _relations(z: DataFrame, freqs, tile: int, entries: int) -> DataFrame:
    """The products of dosages less twice the frequencies, over 2D (freqs), or less their means over the samples with
    the trace scaled to n - 1 (no freqs)."""
    d = written(dosage(z))
    n, samples = d.agg(F.count("*"), F.count_distinct("sample")).first()
    each = -(-n // max(1, samples))  # entries of a sample
    span = max(1, min(SPAN, BLOCK // max(1, each)) // tile) * tile
    parts = max(1, -(-2 * min(span, samples) * each // entries))
    if freqs is None:
        freqs = d.groupBy(*ALLELE).agg((F.sum("z") / (2 * samples)).alias("p"), F.sum(F.col("z") * F.col("z")).alias("zz"))
        factor = (samples - 1) / F.sum(F.col("zz") - 4 * samples * F.col("p") * F.col("p"))
    else:
        factor = 1 / (2 * F.sum(F.col("p") * (1 - F.col("p"))))
    freqs = written(freqs)
    pp, factor = freqs.agg(F.sum(4 * F.col("p") * F.col("p")), factor).first()
    own = d.join(numbered(freqs, parts), ALLELE).select("sample", "part", "row", F.col("z").alias("x"), "p")
    marks = own.groupBy("sample").agg(F.sum(2 * F.col("p") * F.col("x")).alias("m"), F.bit_xor(F.xxhash64("part", "row", "x")).alias("like"))
    none = float("nan")
    return products(own.drop("p"), marks, span=span, parts=parts, tile=tile, constant=none if pp is None else pp, factor=none if factor is None else factor)


def grm(z: DataFrame, freqs: DataFrame, *, tile: int = 512, entries: int = 1 << 20) -> DataFrame:
    """(i, j, g), i >= j: sum over alleles of centred products over 2D.

    Samples are cut into blocks, multiplied ``tile`` samples at a time, alleles into parts with about ``entries`` dosages for two
    blocks. The means' share is added in closed form.
    """
    return _relations(z, freqs, tile, entries)


def grm_centered(z: DataFrame, *, tile: int = 512, entries: int = 1 << 20) -> DataFrame:
    """(i, j, g), i >= j: the relationship matrix less its row and column means, its trace scaled to n - 1.

    Taking the means off the matrix is taking an allele's mean over the samples off its dosages, whatever frequency was
    taken off before; and 2D cancels out. So it is the same products, and no pair is read again.
    """
    return _relations(z, None, tile, entries)
