"""Queries of the haplotype operators, by key, on tables derived from the test data, and equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import bits as B
from strandworks.functions.numeric import clamp, logsumexp, round6
from strandworks.operators import admix, clustering, dedup, lai, linalg, pheno, predict, stats, windows
from strandworks.sources import codecs
from strandworks.sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}

#: Common tables of the SQL: h haplotypes, hw their windows, pk packed rows, u distinct ones, md founder
#: medians, nr nearest median, z assignments, pf and qf fixed parameters. Fixed values as in fixtures.
_FB = "CASE WHEN ({f}*131 + j*17 + {f}*j*37 + {f}*{f}*j*11) % 23 < 9 THEN 1 ELSE 0 END"
CTE = f"""WITH RECURSIVE ax AS (SELECT j::BIGINT AS j, CASE WHEN j < 32 THEN 'chr1' ELSE 'chr2' END AS chrom, (j % 32)::BIGINT AS snp,
  (1000 + j * 137 + (j * j * 13) % 101)::BIGINT AS pos FROM (SELECT unnest(range(0, 64)) AS j)),
hm0 AS (SELECT vec_id AS hap, vec_id // 2 AS sample, (label % 4) * 2 + ((vec_id * 31 + (j // 16) * 17 + vec_id // 7) % 2) AS f, ax.* FROM embeddings, ax),
hm1 AS (SELECT *, {_FB.format(f='f')} AS b FROM hm0),
hm AS (SELECT chrom, snp, pos, hap, sample, j, (CASE WHEN (hap * 53 + j * 29 + hap * j * 7) % 97 < 2 THEN 1 - b ELSE b END)::BIGINT AS allele FROM hm1),
hx AS (SELECT chrom, snp, pos, hap, sample, CASE WHEN (hap * 11 + j * 5) % 41 <> 0 THEN allele END AS allele FROM hm),
h AS (SELECT chrom, snp, pos, hap, sample, allele FROM hm),
sn AS (SELECT DISTINCT chrom, snp, pos FROM ax),
hw AS (SELECT *, snp // 8 AS "window", snp % 8 AS o FROM h),
xw AS (SELECT *, snp // 8 AS "window", snp % 8 AS o FROM hx),
pk AS (SELECT chrom, "window", hap, sample, sum(allele << o)::BIGINT AS bits FROM hw GROUP BY ALL),
xk AS (SELECT chrom, "window", hap, sample, coalesce(sum(allele << o), 0)::BIGINT AS bits, coalesce(sum(CASE WHEN allele IS NOT NULL THEN 1 << o END), 0)::BIGINT AS mask FROM xw GROUP BY ALL),
u AS (SELECT chrom, "window", bits, n_u, row_number() OVER (PARTITION BY chrom, "window" ORDER BY bits) - 1 AS u_idx
      FROM (SELECT chrom, "window", bits, count(*) AS n_u FROM pk GROUP BY ALL)),
fm AS (SELECT chrom, snp // 8 AS "window", f, sum(({_FB.format(f='f')}) << (snp % 8))::BIGINT AS bits FROM ax, (SELECT unnest(range(0, 8)) AS f) GROUP BY ALL),
md AS (SELECT chrom, "window", bits, row_number() OVER (PARTITION BY chrom, "window" ORDER BY f) - 1 AS cluster
       FROM (SELECT chrom, "window", bits, min(f) AS f FROM fm GROUP BY ALL)),
ds AS (SELECT u.*, md.cluster, md.bits AS median, bit_count(xor(u.bits, md.bits))::BIGINT AS d FROM u JOIN md USING (chrom, "window")),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, "window", u_idx ORDER BY d, cluster DESC) AS r FROM ds) WHERE r = 1),
z AS (SELECT pk.chrom, pk."window", hap, sample, cluster FROM pk JOIN nr USING (chrom, "window", bits)),
cc AS (SELECT chrom, "window", cluster, j, sum(n_u * ((bits >> j) & 1))::BIGINT AS count, sum(n_u)::BIGINT AS n FROM nr, (SELECT unnest(range(0, 8)) AS j) GROUP BY ALL),
sz AS (SELECT chrom, "window", cluster, sum(n_u)::BIGINT AS n FROM nr GROUP BY ALL),
m2 AS (SELECT chrom, "window", cluster, sum((CASE WHEN count > n // 2 THEN 1 ELSE 0 END) << j)::BIGINT AS bits FROM cc GROUP BY ALL),
ll AS (SELECT m2.chrom, m2."window", m2.cluster AS c1, cc.cluster AS c2,
       sum(CASE WHEN (bits >> j) & 1 = 1 THEN ln(greatest(1e-5::DOUBLE, least(count::DOUBLE / n, 1 - 1e-5::DOUBLE))) ELSE ln(1 - greatest(1e-5::DOUBLE, least(count::DOUBLE / n, 1 - 1e-5::DOUBLE))) END) AS ll
       FROM m2 JOIN cc USING (chrom, "window") GROUP BY ALL),
ks AS (SELECT unnest(range(0, 3)) AS k),
pf0 AS (SELECT chrom, "window", cluster, k, (1 + ("window" * 7 + cluster * 13 + k * 29) % 17)::DOUBLE AS r FROM md, ks),
pf AS (SELECT chrom, "window", cluster, k, r / sum(r) OVER (PARTITION BY chrom, "window", k) AS p FROM pf0),
qf0 AS (SELECT sample, k, (1 + (sample * 5 + k * 11) % 7)::DOUBLE AS r FROM (SELECT DISTINCT vec_id // 2 AS sample FROM embeddings), ks),
qf AS (SELECT sample, k, r / sum(r) OVER (PARTITION BY sample) AS q FROM qf0),
lb AS (SELECT vec_id // 2 AS sample, CASE WHEN (vec_id // 2) % 3 = 0 THEN label % 4 + 1 ELSE 0 END::BIGINT AS pop FROM embeddings WHERE vec_id % 2 = 0),
fr AS (SELECT chrom, "window", cluster, count(*) / sum(count(*)) OVER (PARTITION BY chrom, "window") AS p FROM z GROUP BY chrom, "window", cluster),
dg AS (SELECT chrom, "window", cluster, sample, count(*) AS z FROM z GROUP BY ALL),
mt AS (SELECT chrom, snp // 8 AS "window", min(pos) AS start, max(pos) AS "end", max(pos) - min(pos) AS length, count(*) AS size FROM sn GROUP BY ALL)
"""

R = "round({} , 6) + 0.0"


def em(n: str, p: str, q: str, z: str = "z", unit: str = "sample", scale: str | None = None) -> str:
    """SQL of one EM step from tables p, q: {n}p and {n}q (and {n}h with the accumulated terms)."""
    w = scale or ("2 * (SELECT count(*) FROM (SELECT DISTINCT chrom, \"window\" FROM " + z + "))" if unit == "sample" else "(SELECT count(*) FROM (SELECT DISTINCT chrom, \"window\" FROM " + z + "))")
    return f""",
{n}f AS (SELECT {z}.chrom, {z}."window", {z}.cluster, {z}.hap, {z}.{unit}, sum(p * q) AS f FROM {z} JOIN {p} USING (chrom, "window", cluster) JOIN {q} USING ({unit}, k) GROUP BY ALL),
{n}j AS (SELECT {n}f.*, k, p, q FROM {n}f JOIN {p} USING (chrom, "window", cluster) JOIN {q} USING ({unit}, k)),
{n}pa AS (SELECT chrom, "window", cluster, k, sum(q / f) AS acc FROM {n}j GROUP BY ALL),
{n}qa AS (SELECT {unit}, k, sum(p / f) AS acc FROM {n}j GROUP BY ALL),
{n}p0 AS (SELECT chrom, "window", cluster, k, greatest(1e-5::DOUBLE, least(p * coalesce(acc, 0) / (SELECT count(DISTINCT hap) FROM {z}), 1 - 1e-5::DOUBLE)) AS p FROM {p} LEFT JOIN {n}pa USING (chrom, "window", cluster, k)),
{n}p AS (SELECT chrom, "window", cluster, k, p / sum(p) OVER (PARTITION BY chrom, "window", k) AS p FROM {n}p0),
{n}q0 AS (SELECT {unit}, k, greatest(1e-5::DOUBLE, least(q * acc / ({w}), 1 - 1e-5::DOUBLE)) AS q FROM {q} JOIN {n}qa USING ({unit}, k)),
{n}q AS (SELECT {unit}, k, q / sum(q) OVER (PARTITION BY {unit}) AS q FROM {n}q0)"""


def qn(n: str, a: str, b: str, c: str, key: str, v: str, by: str) -> str:
    return f""",
{n}c AS (SELECT greatest(1.0::DOUBLE, least(-sum(uu * uu) / sum(uu * vv), 96.0::DOUBLE)) AS c FROM (
   SELECT b.{v} - a.{v} AS uu, (c.{v} - b.{v}) - (b.{v} - a.{v}) AS vv FROM {a} a JOIN {b} b USING ({key}) JOIN {c} c USING ({key}))),
{n}j0 AS (SELECT {key}, greatest(1e-5::DOUBLE, least((1 - c) * b.{v} + c * d.{v}, 1 - 1e-5::DOUBLE)) AS {v} FROM {b} b JOIN {c} d USING ({key}), {n}c),
{n}x AS (SELECT {key}, {v} / sum({v}) OVER (PARTITION BY {by}) AS {v} FROM {n}j0)"""


class Tables:
    """The derived tables of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir
        self.h = fx.haplotypes(spark, sf_dir)
        self.sn = windows.snps_of(self.h)
        self.w = windows.fixed(self.sn, fx.SIZE)

    def windowed(self, missing: bool = False) -> DataFrame:
        h = fx.haplotypes(self.spark, self.sf, True) if missing else self.h
        return h.withColumn("window", F.expr(f"snp div {fx.SIZE}")).withColumn("j", F.expr(f"snp % {fx.SIZE}"))

    def packed(self, missing: bool = False) -> DataFrame:
        return dedup.packed(self.windowed(missing))

    @property
    def u(self) -> DataFrame:
        return dedup.unique(self.packed())

    @property
    def md(self) -> DataFrame:
        return fx.founder_medians(self.spark, self.sf)

    @property
    def near(self) -> DataFrame:
        return clustering.assign_nearest(self.u, self.md)

    @property
    def z(self) -> DataFrame:
        return dedup.assign_haplotypes(self.packed(), self.near)

    @property
    def counts(self) -> DataFrame:
        return clustering.cluster_counts(self.near, fx.SIZE)

    @property
    def p(self) -> DataFrame:
        return fx.p_fixed(self.md)

    @property
    def q(self) -> DataFrame:
        return fx.q_fixed(self.h)

    @property
    def qh(self) -> DataFrame:
        """q of every haplotype."""
        return self.h.select("hap", "sample").distinct().join(self.q.hint("merge"), "sample").select("hap", "k", "q")

    @property
    def labels(self) -> DataFrame:
        return fx.labels(self.spark, self.sf)

    @property
    def freqs(self) -> DataFrame:
        return stats.frequency(self.z)

    @property
    def meta(self) -> DataFrame:
        return windows.meta(self.w)

    @property
    def geno(self) -> DataFrame:
        g = codecs.genotypes(fx.haplotypes(self.spark, self.sf, True))
        return g.withColumn("window", F.expr(f"snp div {fx.SIZE}")).withColumn("j", F.expr(f"snp % {fx.SIZE}"))


def query(key: str, types: str, sql: str | None = None):
    """Register f(Tables); ``types`` lists the output as 'name type', doubles rounded to six places."""
    fields = [x.split() for x in types.split(", ")]

    def shape(df: DataFrame) -> DataFrame:
        cast = {"long": lambda c: F.col(c).cast("long"), "double": lambda c: round6(F.col(c)), "string": lambda c: F.col(c).cast("string"), "boolean": lambda c: F.col(c).cast("boolean")}
        return df.select(*[cast[t](c).alias(c) for c, t in fields])

    sql_type = {"long": "CAST(\"{0}\" AS BIGINT)", "double": "round(CAST(\"{0}\" AS DOUBLE), 6) + 0.0", "string": "CAST(\"{0}\" AS VARCHAR)", "boolean": "CAST(\"{0}\" AS BOOLEAN)"}

    def wrap(f):
        QUERIES[key] = lambda spark, sf_dir: shape(f(Tables(spark, sf_dir)))
        if sql:
            more, _, body = sql.rpartition(";;")
            ORACLES[key] = f"{CTE}{more} SELECT {', '.join(sql_type[t].format(c) + f' AS "{c}"' for c, t in fields)} FROM ({body})"
        return f

    return wrap


CW, CWC = "chrom string, window long", "chrom string, window long, cluster long"

from strandworks.plans import queries as _queries  # noqa: E402, F401  registers the queries
