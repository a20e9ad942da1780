"""The registered queries: each applies an operator to the derived tables, with equal SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandworks.functions import bits as B
from strandworks.functions.numeric import clamp, logsumexp
from strandworks.functions.store import scratch, written
from strandworks.operators import admix, clustering, dedup, lai, linalg, pheno, predict, stats, windows
from strandworks.registry import CW, CWC, em, qn, query
from strandworks.sources import bcf, codecs, records, writers
from strandworks.sources import fixtures as fx

W, H = '"window"', "hap long, sample long"

# --- scans and codecs ---

HAPS = "chrom string, pos long, hap long, sample long, allele long"


@query("scan_haplotypes", HAPS, "SELECT * FROM h")
def _(t):
    return codecs.vcf_haplotypes(codecs.vcf_lines(t.h))


@query("scan_haplotypes_missing", HAPS, "SELECT * FROM hx")
def _(t):
    return codecs.vcf_haplotypes(codecs.vcf_lines(fx.haplotypes(t.spark, t.sf, True)))


GENO = ', g AS (SELECT chrom, snp, pos, sample, CASE WHEN count(allele) = 2 THEN sum(allele) END AS dosage FROM hx GROUP BY chrom, snp, pos, sample)'


@query("scan_genotypes", "chrom string, snp long, pos long, sample long, dosage long", GENO + ";; SELECT * FROM g")
def _(t):
    return codecs.genotypes(fx.haplotypes(t.spark, t.sf, True))


KW = f', kw AS (SELECT chrom, {W}, count(*) AS k FROM md GROUP BY ALL)'
META = f'{CW}, start long, end long, length long, size long'


def _k(t):
    return t.md.groupBy("chrom", "window").agg(F.count("*").alias("k"))


@query("scan_windows", "chrom string, start long, end long, length long, size long, k long", KW + f";; SELECT * FROM mt JOIN kw USING (chrom, {W})")
def _(t):
    df = windows.meta(t.w, _k(t)).select("chrom", "start", "end", "length", "size", "k")
    return codecs.parse_lines(codecs.to_lines(df), codecs.WIN_SCHEMA)


Z = f"{CW}, hap long, sample long, cluster long"


@query("scan_assignments", Z, "SELECT * FROM z")
def _(t):
    return codecs.decode_assignments(codecs.encode_assignments(t.z), t.h.select("hap").distinct().count())


@query("scan_medians", f"{CWC}, j long, allele long", "SELECT *, (bits >> j) & 1 AS allele FROM md, (SELECT unnest(range(0, 8)) AS j)")
def _(t):
    w = _k(t).withColumn("size", F.lit(fx.SIZE).cast("long"))
    return codecs.decode_medians(codecs.encode_medians(t.md, fx.SIZE), w)


@query("scan_loglik", f"{CW}, c1 long, c2 long, ll double", f"SELECT chrom, {W}, c1, c2, round(ll::FLOAT::DOUBLE, 4) AS ll FROM ll")
def _(t):
    ll = clustering.median_loglik(t.counts, clustering.medians_of(t.near, fx.SIZE))
    k = t.near.groupBy("chrom", "window").agg(F.count_distinct("cluster").alias("k"))
    return codecs.decode_loglik(codecs.encode_loglik(ll), k).withColumn("ll", F.round("ll", 4))


U5 = f""", h5 AS (SELECT chrom, least(snp // 5, 5) AS {W}, hap, sum(allele << (snp - 5 * least(snp // 5, 5)))::BIGINT AS bits FROM h GROUP BY ALL),
u5 AS (SELECT chrom, {W}, bits, bits % 3 AS cluster, count(*) AS n_u, CASE WHEN {W} = 5 THEN 7 ELSE 5 END AS size FROM h5 GROUP BY ALL),
c5 AS (SELECT chrom, {W}, cluster, j, sum(n_u * ((bits >> j) & 1))::BIGINT AS count, sum(n_u)::BIGINT AS n FROM u5, (SELECT unnest(range(0, 7)) AS j) WHERE j < size GROUP BY ALL),
m5 AS (SELECT chrom, {W}, cluster, sum((CASE WHEN count > n // 2 THEN 1 ELSE 0 END) << j)::BIGINT AS bits FROM c5 GROUP BY ALL)"""


@query("cluster_loglik_remainder", f"{CW}, c1 long, c2 long, ll double", U5 + f""";; SELECT m5.chrom, m5.{W}, m5.cluster AS c1, c5.cluster AS c2,
sum(CASE WHEN (bits >> j) & 1 = 1 THEN ln(greatest(1e-5::DOUBLE, least(count::DOUBLE / n, 1 - 1e-5::DOUBLE))) ELSE ln(1 - greatest(1e-5::DOUBLE, least(count::DOUBLE / n, 1 - 1e-5::DOUBLE))) END) AS ll
FROM m5 JOIN c5 USING (chrom, {W}) GROUP BY ALL""")
def _(t):
    w = windows.fixed(t.sn, 5)
    sizes = w.groupBy("chrom", "window").agg(F.count("*").alias("size"))
    u = dedup.unique(dedup.packed(windows.attach(t.h, w))).withColumn("cluster", F.expr("bits % 3")).join(sizes, ["chrom", "window"])
    counts = clustering.cluster_counts(u)
    medians = clustering.marginal_median(counts).groupBy("chrom", "window", "cluster").agg(B.pack(F.col("allele"), F.col("j")).alias("bits"))
    return clustering.median_loglik(counts, medians)


@query("detect_phase", "chrom string, phased boolean", "SELECT DISTINCT chrom, TRUE AS phased FROM h")
def _(t):
    return codecs.is_phased(codecs.vcf_lines(t.h))


@query("scan_labels", "sample long, pop long", "SELECT * FROM lb")
def _(t):
    return codecs.checked_labels(t.labels.select("sample", F.col("pop").cast("string").alias("value")), 4)


BIM = f"SELECT chrom, chrom || '_W' || ({W} + 1) || '_K' || (cluster + 1) || '_B' || size AS id, 0 AS cm, start AS pos, 'K' AS a1, '0' AS a2 FROM md JOIN mt USING (chrom, {W})"
BIM_T = "chrom string, id string, cm long, pos long, a1 string, a2 string"


@query("plink_bim", BIM_T, BIM)
def _(t):
    return codecs.plink_bim(t.meta, t.md.select("chrom", "window", "cluster"))


@query("scan_plink_meta", BIM_T, BIM)
def _(t):
    return codecs.parse_lines(codecs.to_lines(codecs.plink_bim(t.meta, t.md.select("chrom", "window", "cluster"))), codecs.BIM_SCHEMA)


@query("plink_fam", "fid string, iid string, pat long, mat long, sex long, pheno long", "SELECT '0' AS fid, 's' || sample AS iid, 0 AS pat, 0 AS mat, 0 AS sex, -9 AS pheno FROM (SELECT DISTINCT sample FROM h)")
def _(t):
    return codecs.plink_fam(t.h.select(F.concat(F.lit("s"), F.col("sample").cast("string")).alias("iid")).distinct())


PLINK = f""", ca AS (SELECT md.chrom, md.{W}, md.cluster, s.sample, coalesce(z, 0) AS dosage FROM md CROSS JOIN (SELECT DISTINCT sample FROM z) s LEFT JOIN dg USING (chrom, {W}, cluster, sample)),
bd AS (SELECT chrom, {W}, cluster, sample // 4 AS byte_idx, sum((CASE dosage WHEN 2 THEN 0 WHEN 1 THEN 2 ELSE 3 END) << (2 * (sample % 4))) AS byte FROM ca GROUP BY ALL)"""
ROW = ["chrom", "window", "cluster"]


@query("plink_encode", f"{CWC}, byte_idx long, byte long", PLINK + ";; SELECT * FROM bd")
def _(t):
    return codecs.plink_encode(codecs.plink_cluster_alleles(t.z, t.md), ROW)


@query("plink_decode", "chrom string, snp long, sample long, dosage long", GENO + ";; SELECT * FROM g")
def _(t):
    g = codecs.genotypes(fx.haplotypes(t.spark, t.sf, True))
    return codecs.plink_decode(codecs.plink_encode(g, ["chrom", "snp"]), ["chrom", "snp"], g.select("sample").distinct().count())


@query("plink_gather", f"{CWC}, sample long, dosage long", PLINK + f";; SELECT * FROM ca WHERE cluster = 1 AND {W} % 2 = 0")
def _(t):
    bed = codecs.plink_encode(codecs.plink_cluster_alleles(t.z, t.md), ROW)
    wanted = t.md.where("cluster = 1 and window % 2 = 0").select(*ROW)
    return codecs.plink_decode(bed.join(wanted, ROW, "left_semi"), ROW, t.h.select("sample").distinct().count())


@query("pack_bits", f"{CW}, {H}, bits long", "SELECT * FROM pk")
def _(t):
    return t.packed()


@query("unpack_bits", f"{CW}, u_idx long, j long, allele long", "SELECT *, (bits >> j) & 1 AS allele FROM u, (SELECT unnest(range(0, 8)) AS j)")
def _(t):
    df = t.u.withColumn("j", F.explode(F.expr(f"sequence(0L, {fx.SIZE - 1}L)")))
    return df.withColumn("allele", B.bit("bits", "j"))


@query("window_transpose", f"{CW}, hap long, alleles string", f"SELECT chrom, {W}, hap, string_agg(allele::VARCHAR, '' ORDER BY o) AS alleles FROM hw GROUP BY ALL")
def _(t):
    v = F.sort_array(F.collect_list(F.struct("j", F.col("allele").cast("string").alias("a"))))
    return t.windowed().groupBy("chrom", "window", "hap").agg(F.array_join(F.transform(v, lambda x: x["a"]), "").alias("alleles"))


@query("filelist_union", "file long, " + Z, "SELECT CASE chrom WHEN 'chr1' THEN 0 ELSE 1 END AS file, * FROM z")
def _(t):
    return codecs.filelist_union([t.z.where(F.col("chrom") == c) for c in ("chr1", "chr2")])


@query("p_by_file", "file string, window long, cluster long, k long, p double", "SELECT 'out.' || chrom AS file, * FROM pf")
def _(t):
    return t.p.withColumn("file", F.concat(F.lit("out."), F.col("chrom")))


# --- binary files by byte ranges: written, then read by several tasks ---

@query("scan_assignments_ranges", Z, "SELECT * FROM z")
def _(t):
    folder = scratch(t.spark, "bca")
    writers.write_assignments(t.z, f"{folder}/x")
    return records.read_assignments(t.spark, folder, t.h.select("hap").distinct().count(), partition_bytes=256)


@query("scan_bed_ranges", "chrom string, snp long, sample long, dosage long", GENO + ";; SELECT * FROM g")
def _(t):
    g = codecs.genotypes(fx.haplotypes(t.spark, t.sf, True))
    path = writers.write_bed(codecs.plink_encode(g, ["chrom", "snp"]), ["chrom", "snp"], scratch(t.spark, "bed") + "/x.bed")
    bed = records.read_bed(t.spark, path, n := g.select("sample").distinct().count(), partition_bytes=1024)
    axis = t.sn.withColumn("row", F.row_number().over(Window.orderBy("chrom", "snp")) - 1)  # a row per SNP
    return codecs.plink_decode(bed.withColumnRenamed("snp", "row"), ["row"], n).join(axis, "row")


@query("scan_medians_ranges", f"{CWC}, j long, allele long", "SELECT *, (bits >> j) & 1 AS allele FROM md, (SELECT unnest(range(0, 8)) AS j)")
def _(t):
    w = _k(t).withColumn("size", F.lit(fx.SIZE).cast("long"))
    paths = writers.write_medians(t.md, w, scratch(t.spark, "bcm") + "/x")
    return records.read_medians(_files(t, paths), w, partition_bytes=100)


@query("scan_loglik_ranges", f"{CW}, c1 long, c2 long, ll double", f"SELECT chrom, {W}, c1, c2, round(ll::FLOAT::DOUBLE, 4) AS ll FROM ll")
def _(t):
    ll = clustering.median_loglik(t.counts, clustering.medians_of(t.near, fx.SIZE))
    paths = writers.write_loglik(ll, scratch(t.spark, "blk") + "/x")
    k = t.near.groupBy("chrom", "window").agg(F.count_distinct("cluster").alias("k"))
    return records.read_loglik(_files(t, paths), k, partition_bytes=300).withColumn("ll", F.round("ll", 4))


def _files(t, paths):
    return t.spark.createDataFrame([(p,) for p in paths], "file string").withColumn("chrom", records.chromosome_of("file"))


@query("scan_bcf", HAPS, "SELECT * FROM hx")
def _(t):
    path = writers.write_bcf(fx.haplotypes(t.spark, t.sf, True), scratch(t.spark, "bcf") + "/x.bcf", block_bytes=3000)
    return bcf.read_bcf(t.spark, path, partition_bytes=2048)


# --- windows ---

WT = f"{CW}, snp long, pos long, j long"


@query("window_fixed", WT, f"SELECT chrom, w AS {W}, snp, pos, snp - 5 * w AS j FROM (SELECT *, least(snp // 5, 5) AS w FROM sn)")
def _(t):
    return windows.fixed(t.sn, 5)


@query("window_sliding", WT, f"SELECT chrom, w AS {W}, snp, pos, snp - 3 * w AS j FROM sn, (SELECT unnest(range(0, 8)) AS w) WHERE snp >= 3 * w AND (snp < 3 * w + 8 OR w = 7)")
def _(t):
    return windows.sliding(t.sn, 8, 3)


@query("window_length", WT, f""",
nx AS (SELECT a.chrom, a.snp, min(b.snp) AS n FROM sn a JOIN sn b ON a.chrom = b.chrom AND b.pos > a.pos + 900 GROUP BY ALL),
st AS (SELECT chrom, 0::BIGINT AS w, min(snp) AS s FROM sn GROUP BY chrom UNION ALL SELECT st.chrom, w + 1, n FROM st JOIN nx ON nx.chrom = st.chrom AND nx.snp = st.s);;
SELECT sn.chrom, max(w) AS {W}, sn.snp, pos, sn.snp - max(s) AS j FROM sn JOIN st ON st.chrom = sn.chrom AND s <= sn.snp GROUP BY sn.chrom, sn.snp, pos""")
def _(t):
    return windows.by_length(t.sn, 900)


@query("window_custom", WT, f"SELECT sn.chrom, max(w) AS {W}, snp, pos, snp - max(s) AS j FROM sn JOIN (VALUES (0, 0), (3, 1), (10, 2), (20, 3)) v(s, w) ON s <= snp GROUP BY chrom, snp, pos")
def _(t):
    starts = t.sn.select("chrom").distinct().withColumn("start", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 3, 10, 20)])))
    return windows.custom(t.sn, starts)


@query("window_meta", META, "SELECT * FROM mt")
def _(t):
    return t.meta


# --- distinct haplotypes ---

@query("allele_counts", f"{CW}, snp long, count long", f"SELECT chrom, {W}, snp, sum(allele) AS count FROM hw GROUP BY ALL")
def _(t):
    return dedup.allele_counts(t.windowed())


@query("unique_haplotypes", f"{CW}, u_idx long, bits long, n_u long", "SELECT * FROM u")
def _(t):
    return t.u


@query("unique_haplotypes_noisy", f"{CW}, u_idx long, bits long, n_u long", f"""SELECT *, row_number() OVER (PARTITION BY chrom, {W} ORDER BY bits) - 1 AS u_idx FROM (
SELECT chrom, {W}, bits, count(*) AS n_u FROM (SELECT CASE WHEN j < 32 THEN 'chr1' ELSE 'chr2' END AS chrom, (j % 32) // 8 AS {W}, vec_id, sum((CASE WHEN embedding[j + 1] > 0 THEN 1 ELSE 0 END) << (j % 8)) AS bits
FROM embeddings, (SELECT unnest(range(0, 64)) AS j) GROUP BY ALL) GROUP BY ALL)""")
def _(t):
    h = fx.signs(t.spark, t.sf)
    return dedup.unique(dedup.packed(windows.attach(h, windows.fixed(windows.snps_of(h), fx.SIZE))))


@query("assign_haplotypes", Z, "SELECT * FROM z")
def _(t):
    return t.z


# --- clustering steps ---

@query("hamming", f"{CW}, u_idx long, cluster long, d long", "SELECT * FROM ds")
def _(t):
    return clustering.distances(t.u, t.md)


@query("assign_nearest", f"{CW}, u_idx long, cluster long, d long", "SELECT * FROM nr")
def _(t):
    return t.near


@query("cluster_counts", f"{CWC}, j long, count long, n long", "SELECT * FROM cc")
def _(t):
    return t.counts


@query("cluster_sizes", f"{CWC}, n long", "SELECT * FROM sz")
def _(t):
    return clustering.cluster_sizes(t.near)


@query("marginal_median", f"{CWC}, j long, allele long", "SELECT *, CASE WHEN count > n // 2 THEN 1 ELSE 0 END AS allele FROM cc")
def _(t):
    return clustering.marginal_median(t.counts)


@query("farthest_point", f"{CW}, u_idx long, d long, n_u long", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, {W} ORDER BY d DESC, n_u DESC, u_idx) AS o FROM (SELECT chrom, {W}, u_idx, d, n_u FROM nr)) WHERE o = 1 AND d >= 1")
def _(t):
    return clustering.farthest_point(t.near, 1)


@query("assignment_changes", f"{CW}, changes long", f""",
d2 AS (SELECT u.chrom, u.{W}, u_idx, cluster, row_number() OVER (PARTITION BY u.chrom, u.{W}, u_idx ORDER BY bit_count(xor(u.bits, m2.bits)), cluster DESC) AS o FROM u JOIN m2 USING (chrom, {W}));;
SELECT chrom, {W}, sum(CASE WHEN nr.cluster <> d2.cluster THEN 1 ELSE 0 END) AS changes FROM nr JOIN d2 USING (chrom, {W}, u_idx) WHERE o = 1 GROUP BY ALL""")
def _(t):
    return clustering.assignment_changes(t.near, clustering.assign_nearest(t.u, clustering.medians_of(t.near, fx.SIZE)))


@query("smallest_cluster", f"{CWC}, n long", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, {W} ORDER BY n, cluster DESC) AS o FROM sz) WHERE o = 1")
def _(t):
    return clustering.smallest_cluster(clustering.cluster_sizes(t.near))


PRUNE = f", pr AS (SELECT * FROM (SELECT *, sum(CASE WHEN n > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, {W}) AS l FROM (SELECT chrom, {W}, u_idx AS cluster, n_u AS n FROM u)) WHERE l <= 2 OR n > 2)"


@query("prune_clusters", f"{CWC}, n long", PRUNE + ";; SELECT * FROM pr")
def _(t):
    return clustering.prune_clusters(t.u.select("chrom", "window", F.col("u_idx").alias("cluster"), F.col("n_u").alias("n")))


@query("compact_ids", f"{CWC}, n long, compact long", PRUNE + f";; SELECT *, dense_rank() OVER (PARTITION BY chrom, {W} ORDER BY cluster) - 1 AS compact FROM pr")
def _(t):
    return clustering.compact_ids(clustering.prune_clusters(t.u.select("chrom", "window", F.col("u_idx").alias("cluster"), F.col("n_u").alias("n"))))


@query("median_loglik", f"{CW}, c1 long, c2 long, ll double", "SELECT * FROM ll")
def _(t):
    return clustering.median_loglik(t.counts, clustering.medians_of(t.near, fx.SIZE))


@query("cluster_windows", f"{CWC}, median long, n long")
def _(t):
    df = clustering.cluster_windows(t.u, clustering.Settings(fx.SIZE, lmbda=0.25))
    return df.groupBy("chrom", "window", "cluster", "median").agg(F.sum("n_u").alias("n"))


# --- prediction ---

@query("predict_align", f"{CW}, ok boolean", f"SELECT chrom, {W}, {W} <> 3 AS ok FROM mt")
def _(t):
    ref = t.meta.select(F.regexp_replace("chrom", "chr", "Chr").alias("chrom"), "window", F.when(F.col("window") == 3, F.col("start") + 1).otherwise(F.col("start")).alias("start"))
    return predict.align(t.meta, ref).withColumn("chrom", F.lower("chrom"))


@query("hamming_missing", f"{CW}, hap long, cluster long, d long", f"SELECT chrom, {W}, hap, cluster, bit_count(xor(xk.bits, md.bits) & mask) AS d FROM xk JOIN md USING (chrom, {W})")
def _(t):
    m = t.md.withColumnRenamed("bits", "median")
    return t.packed(True).join(m, ["chrom", "window"]).withColumn("d", B.hamming_missing(F.col("bits"), F.col("median"), F.col("mask")))


@query("predict_phased", f"{CW}, {H}, cluster long, d long", f"""SELECT * FROM (SELECT chrom, {W}, hap, sample, cluster, bit_count(xor(xk.bits, md.bits) & mask) AS d,
row_number() OVER (PARTITION BY chrom, {W}, hap ORDER BY bit_count(xor(xk.bits, md.bits) & mask), cluster DESC) AS o FROM xk JOIN md USING (chrom, {W})) WHERE o = 1""")
def _(t):
    return predict.phased(t.packed(True), t.md)


STATES = GENO + f""", gs AS (SELECT chrom, snp // 8 AS {W}, sample,
 sum(CASE WHEN dosage = 2 THEN 1 << (snp % 8) ELSE 0 END)::BIGINT AS hom, sum(CASE WHEN dosage IN (0, 2) THEN 1 << (snp % 8) ELSE 0 END)::BIGINT AS hom_mask,
 sum(CASE WHEN dosage = 1 THEN 1 << (snp % 8) ELSE 0 END)::BIGINT AS het FROM g GROUP BY ALL)"""


@query("geno_states", f"{CW}, sample long, hom long, hom_mask long, het long", STATES + ";; SELECT * FROM gs")
def _(t):
    return predict.geno_states(t.geno)


@query("predict_unphased", f"{CW}, sample long, c1 long, c2 long, t long", STATES + f""", pr AS (SELECT gs.chrom, gs.{W}, sample, a.cluster AS c1, b.cluster AS c2,
 2 * bit_count(xor(hom, a.bits) & hom_mask)::BIGINT + bit_count(xor(hom, b.bits) & hom_mask)::BIGINT + bit_count((255 - xor(a.bits, b.bits)) & het)::BIGINT AS t
 FROM gs JOIN md a ON a.chrom = gs.chrom AND a.{W} = gs.{W} JOIN md b ON b.chrom = gs.chrom AND b.{W} = gs.{W});;
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, {W}, sample ORDER BY t, c1, c2) AS o FROM pr) WHERE o = 1""")
def _(t):
    return predict.unphased(predict.geno_states(t.geno), t.md)


# --- windows of more than 62 SNPs ---

WB = "CASE WHEN ({f}*131 + j*17 + {f}*j*37 + {f}*{f}*j*11) % 23 < 9 THEN 1 ELSE 0 END"
WIDE = f""", wa AS (SELECT j::BIGINT AS j, least(j // 128, 1)::BIGINT AS {W}, (j - 128 * least(j // 128, 1))::BIGINT AS o FROM (SELECT unnest(range(0, 320)) AS j)),
w0 AS (SELECT vec_id AS hap, vec_id // 2 AS sample, (label % 4) * 2 + ((vec_id * 31 + (j // 16) * 17 + vec_id // 7) % 2) AS f, wa.* FROM embeddings, wa),
w1 AS (SELECT *, {WB.format(f='f')} AS b FROM w0),
wh AS (SELECT hap, sample, {W}, o, j, (CASE WHEN (hap * 53 + j * 29 + hap * j * 7) % 97 < 2 THEN 1 - b ELSE b END)::BIGINT AS allele FROM w1),
wx AS (SELECT hap, sample, {W}, o, CASE WHEN (hap * 11 + j * 5) % 41 <> 0 THEN allele END AS allele FROM wh),
wk AS (SELECT {W}, hap, sample, string_agg(allele::VARCHAR, '' ORDER BY o) AS alleles FROM wh GROUP BY ALL),
wu AS (SELECT {W}, alleles, n_u, row_number() OVER (PARTITION BY {W} ORDER BY reverse(alleles)) - 1 AS u_idx FROM (SELECT {W}, alleles, count(*) AS n_u FROM wk GROUP BY ALL)),
wf AS (SELECT {W}, f, string_agg(b::VARCHAR, '' ORDER BY o) AS alleles FROM (SELECT {W}, o, f, {WB.format(f='f')} AS b FROM wa, (SELECT DISTINCT (label % 4) * 2 + i AS f FROM embeddings, (SELECT unnest([0, 1]) AS i))) GROUP BY ALL),
wm AS (SELECT {W}, alleles, row_number() OVER (PARTITION BY {W} ORDER BY f) - 1 AS cluster FROM (SELECT {W}, alleles, min(f) AS f FROM wf GROUP BY ALL)),
wn AS (SELECT * FROM (SELECT wu.{W}, u_idx, wu.alleles, n_u, cluster, hamming(wu.alleles, wm.alleles) AS d, row_number() OVER (PARTITION BY wu.{W}, u_idx ORDER BY hamming(wu.alleles, wm.alleles), cluster DESC) AS r FROM wu JOIN wm USING ({W})) WHERE r = 1),
wz AS (SELECT {W}, hap, sample, cluster FROM wk JOIN wn USING ({W}, alleles)),
wc AS (SELECT wz.{W}, cluster, o, sum(allele)::BIGINT AS count, count(*) AS n FROM wz JOIN wh USING ({W}, hap) GROUP BY ALL),
wr AS (SELECT {W}, cluster, o, n, CASE WHEN count > n // 2 THEN 1 ELSE 0 END AS r FROM wc)"""
WW = "window long"


class _Wide:
    """The wide tables of a query."""

    def __init__(self, t):
        self.h = fx.haplotypes(t.spark, t.sf, wide=True)
        self.axis = windows.fixed(windows.snps_of(self.h), fx.WIDE)
        self.words = B.words_for(fx.WIDE_SNPS - fx.WIDE)
        self.sizes = self.axis.groupBy("chrom", "window").agg(F.count("*").alias("size"))
        self.md = fx.founder_medians(t.spark, t.sf, wide=True)
        self.missing = fx.haplotypes(t.spark, t.sf, True, wide=True)

    @property
    def packed(self):
        return dedup.packed(windows.attach(self.h, self.axis), self.words)

    @property
    def near(self):
        return clustering.assign_nearest(dedup.unique(self.packed), self.md)

    @property
    def counts(self):
        return clustering.cluster_counts(self.near.join(self.sizes, ["chrom", "window"]))

    @property
    def z(self):
        return dedup.assign_haplotypes(self.packed, self.near)

    def spelled(self, df):
        text = F.array_join(F.transform(B.alleles("bits", F.col("size"), True), lambda a: a.cast("string")), "")
        return df.join(self.sizes, ["chrom", "window"]).withColumn("alleles", text)


@query("wide_unique", f"{WW}, u_idx long, alleles string, n_u long", WIDE + ";; SELECT * FROM wu")
def _(t):
    w = _Wide(t)
    return w.spelled(dedup.unique(w.packed))


@query("wide_nearest", f"{WW}, u_idx long, cluster long, d long", WIDE + ";; SELECT * FROM wn")
def _(t):
    return _Wide(t).near


@query("wide_medians", f"{WW}, cluster long, alleles string, n long", WIDE + f";; SELECT {W}, cluster, string_agg(r::VARCHAR, '' ORDER BY o) AS alleles, max(n) AS n FROM wr GROUP BY {W}, cluster")
def _(t):
    w = _Wide(t)
    medians = w.spelled(clustering.medians_of(w.near.join(w.sizes, ["chrom", "window"]), words=w.words))
    return medians.join(clustering.cluster_sizes(w.near), ["chrom", "window", "cluster"])


@query("wide_loglik", f"{WW}, c1 long, c2 long, ll double", WIDE + f"""
;; SELECT wr.{W}, wr.cluster AS c1, wc.cluster AS c2, sum(CASE WHEN r = 1 THEN ln(greatest(1e-5::DOUBLE, least(count::DOUBLE / wc.n, 1 - 1e-5::DOUBLE))) ELSE ln(1 - greatest(1e-5::DOUBLE, least(count::DOUBLE / wc.n, 1 - 1e-5::DOUBLE))) END) AS ll
FROM wr JOIN wc USING ({W}, o) GROUP BY ALL""")
def _(t):
    w = _Wide(t)
    return clustering.median_loglik(w.counts, clustering.medians_of(w.near.join(w.sizes, ["chrom", "window"]), words=w.words))


WMR = f", ws AS (SELECT {W}, cluster, (o - 1)::BIGINT AS o, alleles[o]::BIGINT AS r FROM wm, (SELECT unnest(range(1, 193)) AS o) WHERE o <= length(alleles))"


@query("wide_predict_phased", f"{WW}, {H}, cluster long", WIDE + WMR + f"""
;; SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {W}, hap ORDER BY d, cluster DESC) AS o FROM (
SELECT wx.{W}, hap, sample, cluster, sum(CASE WHEN allele <> r THEN 1 ELSE 0 END) AS d FROM wx JOIN ws USING ({W}, o) GROUP BY ALL)) WHERE o = 1""")
def _(t):
    from strandworks.plans import verbs

    w = _Wide(t)
    return verbs.predict(w.missing, w.md, w.axis)


@query("wide_predict_unphased", f"{WW}, sample long, c1 long, c2 long, t long", WIDE + WMR + f""", wg AS (SELECT {W}, sample, o, CASE WHEN count(allele) = 2 THEN sum(allele) END AS dosage FROM wx GROUP BY ALL),
wp AS (SELECT wg.{W}, sample, a.cluster AS c1, b.cluster AS c2, sum(CASE dosage WHEN 1 THEN (a.r = b.r)::INT WHEN 0 THEN 2 * a.r + b.r WHEN 2 THEN 2 * (1 - a.r) + 1 - b.r ELSE 0 END)::BIGINT AS t
FROM wg JOIN ws a ON a.{W} = wg.{W} AND a.o = wg.o JOIN ws b ON b.{W} = wg.{W} AND b.o = wg.o GROUP BY ALL);;
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {W}, sample ORDER BY t, c1, c2) AS o FROM wp) WHERE o = 1""")
def _(t):
    w = _Wide(t)
    calls = windows.attach(codecs.genotypes(w.missing), w.axis)
    return predict.unphased(predict.geno_states(calls, w.words), w.md)


@query("wide_grm", "i long, j long, g double", WIDE + f""", wq AS (SELECT {W}, cluster, count(*) / sum(count(*)) OVER (PARTITION BY {W}) AS p FROM wz GROUP BY {W}, cluster),
wy AS (SELECT wq.{W}, wq.cluster, p, s.sample, (SELECT count(*) FROM wz WHERE wz.{W} = wq.{W} AND wz.cluster = wq.cluster AND wz.sample = s.sample) AS z FROM wq, (SELECT DISTINCT sample FROM wz) s);;
SELECT a.sample AS i, b.sample AS j, sum((a.z - 2 * a.p) * (b.z - 2 * b.p)) / (2 * (SELECT sum(p * (1 - p)) FROM wq)) AS g FROM wy a JOIN wy b USING ({W}, cluster) WHERE a.sample >= b.sample GROUP BY ALL""")
def _(t):
    z = written(_Wide(t).z)
    return stats.grm(z, stats.frequency(z))


@query("wide_cluster", f"{WW}, cluster long, alleles string, n long")
def _(t):
    from strandworks.plans import verbs

    w = _Wide(t)
    made = verbs.cluster(w.h, size=fx.WIDE)
    n = made.assignments.groupBy("chrom", "window", "cluster").agg(F.count("*").alias("n"))
    return w.spelled(made.medians).join(n, ["chrom", "window", "cluster"])


# --- statistics ---

@query("allele_dosage", f"{CWC}, sample long, z long", "SELECT * FROM dg")
def _(t):
    return stats.dosage(t.z)


@query("allele_freq", f"{CWC}, p double", "SELECT * FROM fr")
def _(t):
    return t.freqs


OFF = KW + f", os AS (SELECT *, coalesce(sum(k) OVER (ORDER BY chrom, {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM kw)"


@query("allele_offsets", f"{CW}, k long, offset long", OFF + ";; SELECT * FROM os")
def _(t):
    return stats.allele_offsets(_k(t))


DENSE = f", de AS (SELECT fr.chrom, fr.{W}, fr.cluster, p, s.sample, coalesce(z, 0) AS z FROM fr CROSS JOIN (SELECT DISTINCT sample FROM z) s LEFT JOIN dg USING (chrom, {W}, cluster, sample))"
STD = "CASE WHEN 2 * p * (1 - p) > 0 THEN (z - 2 * p) / sqrt(2 * p * (1 - p)) ELSE 0 END"


@query("center_dosage", f"{CWC}, sample long, x double", DENSE + ";; SELECT *, z - 2 * p AS x FROM de")
def _(t):
    return stats.centered(t.z, t.freqs)


@query("standardize_dosage", f"{CWC}, sample long, x double", DENSE + f";; SELECT *, {STD} AS x FROM de")
def _(t):
    return stats.standardized(t.z, t.freqs)


@query("grm_denominator", "d double", "SELECT sum(p * (1 - p)) AS d FROM fr")
def _(t):
    return stats.denominator(t.freqs)


GRM = DENSE + f", gr AS (SELECT a.sample AS i, b.sample AS j, sum((a.z - 2 * a.p) * (b.z - 2 * b.p)) / (2 * (SELECT sum(p * (1 - p)) FROM fr)) AS g FROM de a JOIN de b USING (chrom, {W}, cluster) GROUP BY ALL)"


@query("grm_raw", "i long, j long, g double", GRM + ";; SELECT * FROM gr WHERE i >= j")
def _(t):
    return stats.grm(t.z, t.freqs)


@query("grm_lower", "i long, j long, g double", GRM + ";; SELECT * FROM gr WHERE i >= j")
def _(t):
    return stats.grm(t.z, t.freqs, tile=64)


@query("grm_centered", "i long, j long, g double", GRM + """, mm AS (SELECT i, avg(g) AS m FROM gr GROUP BY i),
cn AS (SELECT gr.i, gr.j, g - a.m - b.m + (SELECT avg(g) FROM gr) AS g FROM gr JOIN mm a ON a.i = gr.i JOIN mm b ON b.i = gr.j);;
SELECT i, j, g * (SELECT (count(*) - 1) / sum(g) FROM cn WHERE i = j) AS g FROM cn WHERE i >= j""")
def _(t):
    return stats.grm_centered(t.z)


# --- linear algebra ---

def _rows(t):
    z = written(t.z)
    return written(linalg.allele_entries(z, stats.frequency(z))), t.h.agg(F.max("sample") + 1).first()[0]


@query("pca_eigenvalues", "pc long, val double")
def _(t):
    rows, n = _rows(t)
    s, _, m = linalg.svd(rows, n, 4)
    return t.spark.createDataFrame([(i + 1, float(x * x / m)) for i, x in enumerate(s)], "pc long, val double")


@query("pca_eigenvectors", "sample long, pc long, v double")
def _(t):
    rows, n = _rows(t)
    _, v, _ = linalg.svd(rows, n, 4)
    # the largest of a component, the first sample's of equals, is positive
    sign = v.groupBy("pc").agg(F.signum(F.max_by("v", F.struct(F.abs("v"), -F.col("sample")))).alias("sign"))
    return v.join(F.broadcast(sign), "pc").select("sample", "pc", (F.col("v") * F.col("sign")).alias("v"))  # a row per component


@query("pca_reconstruction", "i long, j long, g double", DENSE + f""", st AS (SELECT chrom, {W}, cluster, sample, {STD} AS x FROM de);;
SELECT a.sample AS i, b.sample AS j, sum(a.x * b.x) / (SELECT count(*) FROM fr WHERE p > 0 AND p < 1) AS g FROM st a JOIN st b USING (chrom, {W}, cluster) WHERE a.sample >= b.sample GROUP BY ALL""")
def _(t):
    # all components together give back the matrix that they decompose
    rows, n = _rows(t)
    s, v, m = linalg.svd(rows, n, n, power=1)
    return linalg.reconstruction(v, s * s / m)


@query("pca_project", "sample long, pc long, v double",OFF + DENSE.replace(", de", ", de") + f""", pcs AS (SELECT unnest(range(1, 3)) AS pc);;
SELECT sample, pc, sum({STD} * (((("offset" + cluster) * 19 + pc * 7) % 23 - 11) / 50.0::DOUBLE) / sqrt((4 - pc) * (SELECT count(*) FROM fr))) AS v FROM de JOIN os USING (chrom, {W}), pcs GROUP BY sample, pc""")
def _(t):
    freqs = t.freqs
    ids = freqs.join(stats.allele_offsets(_k(t)), ["chrom", "window"])
    load = ids.withColumn("pc", F.explode(F.expr("array(1L, 2L)"))).withColumn("u", F.expr("(((offset + cluster) * 19 + pc * 7) % 23 - 11) / 50D"))
    val = t.spark.range(1, 3).select(F.col("id").alias("pc"), (4 - F.col("id")).alias("val"))
    return linalg.project(t.z, freqs, load.select("chrom", "window", "cluster", "pc", "u"), val, freqs.count())


@query("admix_init", "sample long, k long, q double")
def _(t):
    rows, n = _rows(t)
    return linalg.als_init(rows, n, fx.K)[1]


# --- expectation-maximisation ---

P, Q = f"{CWC}, k long, p double", "sample long, k long, q double"
E1 = em("a", "pf", "qf")
CK = f"chrom, {W}, cluster, k"


@query("individual_freq", f"{CWC}, sample long, h double", E1 + f";; SELECT DISTINCT chrom, {W}, cluster, sample, 1 / f AS h FROM (SELECT chrom, {W}, cluster, sample, round(min(f), 15) AS f FROM af GROUP BY ALL)")
def _(t):
    return admix.individual_freq(t.z, t.p, t.q)


@query("loglik", "loglik double", E1 + ";; SELECT sum(ln(f)) / ((SELECT count(*) FROM md) * (SELECT count(DISTINCT hap) FROM z)) AS loglik FROM af")
def _(t):
    return admix.loglik(t.z, t.p, t.q)


@query("em_accumulate", f"{CWC}, k long, acc double", E1 + ";; SELECT * FROM apa")
def _(t):
    return admix.accumulate_p(t.z, t.p, t.q)


@query("em_p_step", P, E1 + ";; SELECT * FROM ap")
def _(t):
    return admix.p_step(t.z, t.p, t.q)


@query("em_q_step", Q, E1 + ";; SELECT * FROM aq")
def _(t):
    return admix.q_step(t.z, t.p, t.q)


@query("projection_q_step", Q, E1 + ";; SELECT * FROM aq")
def _(t):
    return admix.q_step(t.z, t.p, t.q)


BATCH = f", zb AS (SELECT * FROM z WHERE ({W} * 31 + length(chrom) * 7 + ascii(right(chrom, 1))) % 2 = 0)"


@query("em_batch_step", Q, BATCH + em("b", "pf", "qf", "zb") + ";; SELECT * FROM bq")
def _(t):
    return admix.q_step(admix.batch_of(t.z, 0, 2), t.p, t.q)


PB = BATCH + f", pb AS (SELECT pf.* FROM pf SEMI JOIN zb USING (chrom, {W}))" + em("a", "pb", "qf", "zb")


@query("em_batch_step_p", P, PB + ";; SELECT * FROM ap")
def _(t):
    part = admix.batch_of(t.z, 0, 2)
    return admix.p_step(part, admix.of_windows(t.p, part), t.q)


@query("qn_batch", "c double", PB + em("b", "ap", "aq", "zb") + qn("y", "pb", "ap", "bp", CK, "p", f"chrom, {W}, k") + ";; SELECT c FROM yc")
def _(t):
    part = admix.batch_of(t.z, 0, 2)
    p = admix.of_windows(t.p, part)
    p1, q1 = admix.p_step(part, p, t.q), admix.q_step(part, p, t.q)
    return admix.qn_factor(p, p1, admix.p_step(part, p1, q1), ["chrom", "window", "cluster", "k"], "p")


QH = ", qh AS (SELECT DISTINCT hap, k, q FROM (SELECT DISTINCT hap, sample FROM z) JOIN qf USING (sample))"


@query("lai_q_step", "hap long, k long, q double", QH + em("l", "pf", "qh", unit="hap") + ";; SELECT * FROM lq")
def _(t):
    return admix.q_step(t.z, t.p, t.qh, "hap")


TWO = E1 + em("b", "ap", "aq")


@query("qn_factor", "c double", TWO + qn("x", "qf", "aq", "bq", "sample, k", "q", "sample") + ";; SELECT c FROM xc")
def _(t):
    q1 = admix.q_step(t.z, t.p, t.q)
    q2 = admix.q_step(t.z, admix.p_step(t.z, t.p, t.q), q1)
    return admix.qn_factor(t.q, q1, q2, ["sample", "k"], "q")


@query("qn_jump", Q, E1 + """, jj AS (SELECT sample, k, greatest(1e-5::DOUBLE, least(-2 * qf.q + 3 * aq.q, 1 - 1e-5::DOUBLE)) AS q FROM qf JOIN aq USING (sample, k));;
SELECT sample, k, q / sum(q) OVER (PARTITION BY sample) AS q FROM jj""")
def _(t):
    c = t.spark.range(1).select(F.lit(3.0).alias("c"))
    return admix.project_q(admix.jump(t.q, admix.q_step(t.z, t.p, t.q), c, ["sample", "k"], "q"))


QUASI = TWO + qn("x", "qf", "aq", "bq", "sample, k", "q", "sample") + qn("y", "pf", "ap", "bp", CK, "p", f"chrom, {W}, k")


@query("quasi_step", Q, QUASI + ";; SELECT * FROM xx")
def _(t):
    return admix.quasi_step(t.z, t.p, t.q)[1]


@query("quasi_step_p", P, QUASI + ";; SELECT * FROM yx")
def _(t):
    return admix.quasi_step(t.z, t.p, t.q)[0]


@query("admix_fixed_iters", Q, TWO + em("c", "bp", "bq") + ";; SELECT * FROM cq")
def _(t):
    from strandworks.plans import verbs

    return verbs.em_iterations(t.z, t.p, t.q, 3)[1]


@query("clamp", P, f"SELECT {CK}, greatest(0.02, least(p, 0.2)) AS p FROM pf")
def _(t):
    return t.p.withColumn("p", clamp(F.col("p"), 0.02, 0.2))


@query("create_p", P, "SELECT * FROM pf")
def _(t):
    raw = t.p.withColumn("p", F.expr("cast(1 + (window * 7 + cluster * 13 + k * 29) % 17 as double)"))
    return admix.create_p(raw)


@query("project_p", P, f", pp AS (SELECT {CK}, greatest(1e-5::DOUBLE, least(3 * p - 0.1, 1 - 1e-5::DOUBLE)) AS p FROM pf);; SELECT {CK}, p / sum(p) OVER (PARTITION BY chrom, {W}, k) AS p FROM pp")
def _(t):
    return admix.project_p(t.p.withColumn("p", 3 * F.col("p") - 0.1))


@query("project_q", Q, ", qq AS (SELECT sample, k, greatest(1e-5::DOUBLE, least(3 * q - 0.5, 1 - 1e-5::DOUBLE)) AS q FROM qf);; SELECT sample, k, q / sum(q) OVER (PARTITION BY sample) AS q FROM qq")
def _(t):
    return admix.project_q(t.q.withColumn("q", 3 * F.col("q") - 0.5))


@query("rmse", "rmse double", E1 + ";; SELECT sqrt(avg(pow(a.q - b.q, 2))) AS rmse FROM qf a JOIN aq b USING (sample, k)")
def _(t):
    return admix.rmse(t.q, admix.q_step(t.z, t.p, t.q), ["sample", "k"])


@query("supervised_p", P, f""", mk AS (SELECT z.*, pop - 1 AS k FROM z JOIN lb USING (sample) WHERE pop > 0),
al AS (SELECT chrom, {W}, k, count(*) AS a FROM mk GROUP BY ALL), cn AS (SELECT chrom, {W}, cluster, k, count(*) AS n FROM mk GROUP BY ALL),
sp AS (SELECT {CK}, greatest(1e-5::DOUBLE, least(CASE WHEN a IS NULL THEN p ELSE coalesce(n, 0) / a::DOUBLE END, 1 - 1e-5::DOUBLE)) AS p FROM pf LEFT JOIN al USING (chrom, {W}, k) LEFT JOIN cn USING (chrom, {W}, cluster, k));;
SELECT {CK}, p / sum(p) OVER (PARTITION BY chrom, {W}, k) AS p FROM sp""")
def _(t):
    return admix.supervised_p(t.z, t.labels, t.p)


@query("supervised_q", Q, """, sq AS (SELECT sample, k, pop, q AS old, CASE WHEN k = pop - 1 THEN 1 - 1e-5::DOUBLE ELSE 1e-5::DOUBLE END AS q FROM qf JOIN lb USING (sample));;
SELECT sample, k, CASE WHEN pop > 0 THEN q / sum(q) OVER (PARTITION BY sample) ELSE old END AS q FROM sq""")
def _(t):
    return admix.supervised_q(t.q, t.labels)


@query("check_p", f"{CW}, k long, total double, ok boolean", f"SELECT chrom, {W}, k, sum(p) AS total, abs(sum(p) - 1) <= 1e-3 AS ok FROM (SELECT {CK}, CASE WHEN k = 1 AND {W} = 2 THEN p * 1.01 ELSE p END AS p FROM pf) GROUP BY ALL")
def _(t):
    return admix.check_p(t.p.withColumn("p", F.expr("if(k = 1 and window = 2, p * 1.01D, p)")))


_UNIT = ', zu AS (SELECT *, chrom || \':\' || hap AS u FROM z), qu AS (SELECT u, k, q FROM (SELECT DISTINCT u, sample FROM zu) JOIN qf USING (sample))'
_own = lambda n, q: em(n, "pf", q, "zu", "u", f"(SELECT count(DISTINCT {W}) FROM z WHERE chrom = 'chr1')")
CHROMOSOME = _UNIT + _own("a", "qu") + _own("b", "aq") + _own("c", "bq") + """,
fc AS (SELECT split_part(a.u, ':', 1) AS chrom, greatest(1.0::DOUBLE, least(-sum((b.q - a.q) * (b.q - a.q)) / sum((b.q - a.q) * ((c.q - b.q) - (b.q - a.q))), 96.0::DOUBLE)) AS c
  FROM aq a JOIN bq b USING (u, k) JOIN cq c USING (u, k) GROUP BY ALL),
j0 AS (SELECT u, k, greatest(1e-5::DOUBLE, least((1 - fc.c) * b.q + fc.c * c.q, 1 - 1e-5::DOUBLE)) AS q FROM bq b JOIN cq c USING (u, k) JOIN fc ON fc.chrom = split_part(u, ':', 1)),
jq AS (SELECT u, k, q / sum(q) OVER (PARTITION BY u) AS q FROM j0)""" + _own("d", "jq")


@query("chromosome_q", "chrom string, hap long, k long, q double", CHROMOSOME + ";; SELECT split_part(u, ':', 1) AS chrom, split_part(u, ':', 2)::BIGINT AS hap, k, q FROM dq")
def _(t):
    from strandworks.plans import verbs

    return verbs.chromosome_q(written(t.z), t.p, t.qh, iterations=0)


@query("em_joint_step", Q, TWO + ";; SELECT * FROM bq")
def _(t):
    counts = written(admix.seen(t.z))
    return admix.em_step(counts, *admix.em_step(counts, t.p, t.q))[1]


@query("em_joint_step_p", P, TWO + ";; SELECT * FROM bp")
def _(t):
    counts = written(admix.seen(t.z))
    return admix.em_step(counts, *admix.em_step(counts, t.p, t.q))[0]


# --- local ancestry ---

E = "chrom string, hap long, block long, k long, e double"
EM = f", eh AS (SELECT chrom, hap, {W} AS block, k, sum(ln(p)) AS e FROM z JOIN pf USING (chrom, {W}, cluster) GROUP BY ALL)"


@query("emissions_hard", E, f"SELECT chrom, hap, {W} // 3 AS block, k, sum(CASE WHEN length <= 1005 THEN ln(p) ELSE 0 END) AS e FROM z JOIN pf USING (chrom, {W}, cluster) JOIN mt USING (chrom, {W}) GROUP BY ALL")
def _(t):
    return lai.emissions_hard(t.z, t.p, 3, lai.window_length_filter(t.meta, most=1005))


SOFT = f", sm AS (SELECT chrom, {W}, c1, c2, exp(ll) / sum(exp(ll)) OVER (PARTITION BY chrom, {W}, c1) AS l FROM (SELECT chrom, {W}, a.cluster AS c1, b.cluster AS c2, -abs(a.cluster - b.cluster) - ({W} * 3 + a.cluster + b.cluster) % 5 * 0.25::DOUBLE AS ll FROM md a JOIN md b USING (chrom, {W})))"


def _ll(t):
    a, b = (t.md.select("chrom", "window", F.col("cluster").alias(c)) for c in ("c1", "c2"))
    return a.join(b, ["chrom", "window"]).withColumn("ll", F.expr("-abs(c1 - c2) - (window * 3 + c1 + c2) % 5 * 0.25D"))


@query("softmax_loglik", f"{CW}, c1 long, c2 long, l double", SOFT + ";; SELECT * FROM sm")
def _(t):
    return lai.softmax_loglik(_ll(t))


@query("emissions_soft", E, SOFT + f""", ce AS (SELECT chrom, {W}, c1 AS cluster, k, ln(sum(l * p)) AS e FROM sm JOIN pf ON pf.chrom = sm.chrom AND pf.{W} = sm.{W} AND pf.cluster = c2 GROUP BY ALL);;
SELECT chrom, hap, {W} // 2 AS block, k, sum(e) AS e FROM z JOIN ce USING (chrom, {W}, cluster) GROUP BY ALL""".replace("SELECT chrom, \"window\", c1 AS cluster", "SELECT sm.chrom, sm.\"window\", c1 AS cluster"))
def _(t):
    return lai.emissions_soft(t.z, t.p, lai.softmax_loglik(_ll(t)), 2)


@query("emissions_soft_filtered", E, SOFT + f""", ce AS (SELECT sm.chrom, sm.{W}, c1 AS cluster, k, CASE WHEN max(length) <= 1005 THEN ln(sum(l * p)) ELSE 0 END AS e
FROM sm JOIN pf ON pf.chrom = sm.chrom AND pf.{W} = sm.{W} AND pf.cluster = c2 JOIN mt ON mt.chrom = sm.chrom AND mt.{W} = sm.{W} GROUP BY ALL);;
SELECT chrom, hap, {W} // 2 AS block, k, sum(e) AS e FROM z JOIN ce USING (chrom, {W}, cluster) GROUP BY ALL""")
def _(t):
    return lai.emissions_soft(t.z, t.p, lai.softmax_loglik(_ll(t)), 2, windows=lai.window_length_filter(t.meta, most=1005))


TRANS = "sample long, alpha double, k1 long, k2 long, t double"
ALPHAS = (0.05, 0.2, 1.0)
AL = ", al AS (SELECT unnest([0.05, 0.2, 1.0]::DOUBLE[]) AS alpha)"


def _alphas(t):
    return t.spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")


@query("transition_matrix", TRANS, AL + ";; SELECT a.sample, alpha, a.k AS k1, b.k AS k2, ln((1 - exp(-alpha)) * a.q + CASE WHEN a.k = b.k THEN exp(-alpha) ELSE 0 END) AS t FROM qf a JOIN qf b USING (sample), al")
def _(t):
    return lai.transition(t.q, _alphas(t))


@query("transition_simple", TRANS, AL + ";; SELECT a.sample, alpha, a.k AS k1, b.k AS k2, CASE WHEN a.k = b.k THEN -alpha ELSE ln((1 - exp(-alpha)) * a.q) END AS t FROM qf a JOIN qf b USING (sample), al")
def _(t):
    return lai.transition(t.q, _alphas(t), simple=True)


@query("alpha_grid", "i long, loga double", "SELECT i, -9 + i * 1.25 AS loga FROM (SELECT unnest(range(0, 5)) AS i)")
def _(t):
    return lai.alpha_grid(t.spark).withColumn("loga", F.log10("alpha"))


@query("window_length_filter", META, "SELECT * FROM mt WHERE length BETWEEN (SELECT quantile_cont(length, 0.25) FROM mt) AND (SELECT quantile_cont(length, 0.75) FROM mt)")
def _(t):
    return lai.window_length_filter(t.meta, quantile=0.5)


def _max3(x):
    return f"greatest({', '.join(x)})"


def _lse3(x):
    return f"({_max3(x)} + ln({' + '.join(f'exp({y} - {_max3(x)})' for y in x)}))"


def _t3(a, b):
    return f"ln((1 - exp(-c.alpha)) * q{a} + {'exp(-c.alpha)' if a == b else '0'})"


_R = range(3)
_pick = lambda c: ", ".join(f"max({c}) FILTER (WHERE k = {i}) AS {c}{i}" for i in _R)
CHAIN = AL + EM + f""",
ee AS (SELECT chrom, hap, block, {_pick('e')} FROM eh GROUP BY ALL),
qq AS (SELECT sample, {_pick('q')} FROM qf GROUP BY ALL),
ch AS (SELECT ee.*, alpha, q0, q1, q2 FROM ee JOIN (SELECT DISTINCT hap, sample FROM z) USING (hap) JOIN qq USING (sample), al),
fw AS (SELECT chrom, hap, alpha, block, {', '.join(f'e{i} + ln(q{i}) AS a{i}' for i in _R)} FROM ch WHERE block = 0
  UNION ALL SELECT c.chrom, c.hap, c.alpha, c.block, {', '.join(_lse3([f'a{j} + {_t3(i, j)}' for j in _R]) + f' + e{i}' for i in _R)}
  FROM fw JOIN ch c ON c.chrom = fw.chrom AND c.hap = fw.hap AND c.alpha = fw.alpha AND c.block = fw.block + 1),
lt AS (SELECT chrom, hap, alpha, {_lse3(['a0', 'a1', 'a2'])} AS l FROM fw WHERE block = 3),
bw AS (SELECT chrom, hap, alpha, 3::BIGINT AS block, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM lt
  UNION ALL SELECT c.chrom, c.hap, c.alpha, c.block - 1, {', '.join(_lse3([f'{_t3(i, j)} + e{i} + b{i}' for i in _R]) for j in _R)}
  FROM bw JOIN ch c ON c.chrom = bw.chrom AND c.hap = bw.hap AND c.alpha = bw.alpha AND c.block = bw.block WHERE bw.block > 0),
po AS (SELECT chrom, hap, alpha, block, k, CASE k WHEN 0 THEN exp(a0 + b0 - l) WHEN 1 THEN exp(a1 + b1 - l) ELSE exp(a2 + b2 - l) END AS p
  FROM fw JOIN bw USING (chrom, hap, alpha, block) JOIN lt USING (chrom, hap, alpha), ks),
dc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, hap, alpha, block ORDER BY p DESC, k) AS o FROM po) WHERE o = 1),
vc AS (SELECT chrom, hap, block, k, count(*) AS votes FROM dc GROUP BY ALL),
vo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, hap, block ORDER BY votes DESC, k) AS o FROM vc) WHERE o = 1)"""
_v = lambda i: [f"a{j} + {_t3(i, j)}" for j in _R]
_arg = lambda x: f"CASE WHEN {x[0]} >= {x[1]} AND {x[0]} >= {x[2]} THEN 0 WHEN {x[1]} >= {x[2]} THEN 1 ELSE 2 END"
VIT = CHAIN + f""",
vt AS (SELECT chrom, hap, alpha, block, {', '.join(f'e{i} + ln(q{i}) AS a{i}' for i in _R)}, {', '.join(f'CAST([{i}] AS INTEGER[]) AS p{i}' for i in _R)} FROM ch WHERE block = 0
  UNION ALL SELECT c.chrom, c.hap, c.alpha, c.block, {', '.join(_max3(_v(i)) + f' + e{i}' for i in _R)},
  {', '.join(f'list_append(CASE {_arg(_v(i))} WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, {i})' for i in _R)}
  FROM vt JOIN ch c ON c.chrom = vt.chrom AND c.hap = vt.hap AND c.alpha = vt.alpha AND c.block = vt.block + 1),
ve AS (SELECT chrom, hap, alpha, CASE {_arg(['a0', 'a1', 'a2'])} WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS path FROM vt WHERE block = 3)"""


def _chains(t):
    return lai.chains(lai.emissions_hard(t.z, t.p), t.qh, _alphas(t))


HAB = "chrom string, hap long, alpha double, block long, k long"


@query("viterbi", HAB, VIT + ";; SELECT chrom, hap, alpha, block, path[block + 1] AS k FROM ve, (SELECT unnest(range(0, 4)) AS block)")
def _(t):
    return lai.viterbi(_chains(t))


@query("hmm_forward", "chrom string, hap long, alpha double, loglik double", CHAIN + ";; SELECT chrom, hap, alpha, l AS loglik FROM lt")
def _(t):
    return lai.forward(_chains(t))


@query("hmm_posterior", HAB + ", p double", CHAIN + ";; SELECT * FROM po")
def _(t):
    return lai.posterior(_chains(t))


@query("posterior_decode", HAB + ", p double", CHAIN + ";; SELECT * FROM dc")
def _(t):
    return lai.posterior_decode(lai.posterior(_chains(t)))


@query("majority_vote", "chrom string, hap long, block long, k long, votes long", CHAIN + ";; SELECT * FROM vo")
def _(t):
    return lai.majority_vote(lai.posterior_decode(lai.posterior(_chains(t))))


@query("posterior_weighted_median", "chrom string, hap long, block long, prob double", CHAIN + """;; SELECT chrom, hap, block, quantile_cont(CASE WHEN dc.k = vo.k THEN p END, 0.5) * avg(CASE WHEN dc.k = vo.k THEN 1.0 ELSE 0.0 END) AS prob
FROM dc JOIN vo USING (chrom, hap, block) GROUP BY chrom, hap, block""")
def _(t):
    d = lai.posterior_decode(lai.posterior(_chains(t)))
    return lai.weighted_median(d, lai.majority_vote(d))


@query("block_expand", f"{CW}, hap long, k long", EM + f", e3 AS (SELECT chrom, hap, block // 3 AS block, k, sum(e) AS e FROM eh GROUP BY ALL), b3 AS (SELECT *, row_number() OVER (PARTITION BY chrom, hap, block ORDER BY round(e, 9) DESC, k) AS o FROM e3);; SELECT mt.chrom, mt.{W}, hap, k FROM b3 JOIN mt ON mt.chrom = b3.chrom AND mt.{W} // 3 = block WHERE o = 1")
def _(t):
    e = lai.emissions_hard(t.z, t.p, 3)
    best = e.groupBy("chrom", "hap", "block").agg(F.max(F.struct(F.round("e", 9).alias("e"), (-F.col("k")).alias("m"))).alias("b")).select("chrom", "hap", "block", (-F.col("b.m")).alias("k"))
    return lai.block_expand(best, t.meta, 3)


@query("logsumexp", "chrom string, hap long, block long, l double", EM + ";; SELECT chrom, hap, block, max(e) + ln(sum(exp(e - m))) AS l FROM (SELECT *, max(e) OVER (PARTITION BY chrom, hap, block) AS m FROM eh) GROUP BY chrom, hap, block")
def _(t):
    v = lai.emissions_hard(t.z, t.p).groupBy("chrom", "hap", "block").agg(F.collect_list("e").alias("v"))
    return v.withColumn("l", logsumexp("v"))


# --- studies ---

@query("polygenic_score", "sample long, score double", GENO + ";; SELECT sample, sum(dosage * ((snp * 13 + length(chrom)) % 7 - 3) / 4.0::DOUBLE) AS score FROM g WHERE snp % 3 = 0 GROUP BY sample")
def _(t):
    g = codecs.genotypes(fx.haplotypes(t.spark, t.sf, True))
    b = t.sn.where("snp % 3 = 0").select("chrom", "snp", F.expr("((snp * 13 + length(chrom)) % 7 - 3) / 4D").alias("b"))
    return pheno.polygenic_score(g, b, ["chrom", "snp"])


@query("pheno_scale", "l_orderkey long, y double", "SELECT l_orderkey, (v - avg(v) OVER ()) / stddev_pop(v) OVER () * sqrt(0.8::DOUBLE) AS y FROM (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY l_orderkey)")
def _(t):
    li = t.spark.read.parquet(f"{t.sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("y"))
    return pheno.scaled(li, "y", 0.8)


AF = """, af AS (SELECT chrom || ':' || snp AS id, avg(allele) AS freq FROM h GROUP BY chrom, snp), mf AS (SELECT *, least(freq, 1 - freq) AS maf FROM af),
bn AS (SELECT *, least(10, floor((maf - (SELECT min(maf) FROM mf)) * 10 / ((SELECT max(maf) FROM mf) - (SELECT min(maf) FROM mf))) + 1)::BIGINT AS bin FROM mf)"""


def _bins(t):
    f = t.h.groupBy(F.concat_ws(":", "chrom", F.col("snp").cast("string")).alias("id")).agg(F.avg("allele").alias("freq"))
    return pheno.maf_bins(f)


@query("maf_bins", "id string, maf double, bin long", AF + ";; SELECT * FROM bn")
def _(t):
    return _bins(t)


@query("stratified_sample", "id string, bin long", AF + ";; SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(id), id) AS o FROM bn) WHERE o <= (SELECT ceil(count(*) * 0.3 / 10) FROM bn)")
def _(t):
    return pheno.stratified_sample(_bins(t), F.md5("id"), 0.3)
