"""Single files in the interchange formats, for tools that do not read Parquet.

A file's bytes are made by executors, a row for each window, sample or haplotype, sorted, and streamed in
that order through the driver into one file of any file system that Spark knows: never more than a
partition of them is held at once.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import bits as B
from strandworks.sources.codecs import MAGIC, PLINK_MAGIC

#: Fixed header of window files.
WIN_HEADER = ["#CHROM", "START", "END", "LENGTH", "SIZE", "K"]


def put(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> str:
    """Write one file, replacing it."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    finally:
        out.close()
    return path


def _each(df: DataFrame, order: list[str], prefix: str, suffix: str, head: bytes) -> list[str]:
    """A file per chromosome of (chrom, content), the contents in order behind the head."""
    rows = df.orderBy("chrom", *order).select("chrom", "content").toLocalIterator()
    return [put(df.sparkSession, f"{prefix}.{chrom}{suffix}", itertools.chain([head], (bytes(r.content) for r in group))) for chrom, group in itertools.groupby(rows, lambda r: r.chrom)]


def _lines(df: DataFrame, order: list[str], path: str, header: str = "") -> str:
    """One file of the column ``line``, in order."""
    rows = df.orderBy(*order).select("line").toLocalIterator()
    head = [header.encode() + b"\n"] if header else []
    return put(df.sparkSession, path, itertools.chain(head, (r.line.encode() + b"\n" for r in rows)))


def _row(df: DataFrame, keys: list[str], by: str, text) -> DataFrame:
    """(keys, line): the texts of a group in the order of ``by``, with blanks between."""
    v = F.sort_array(F.collect_list(F.struct(by, text.alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(v, lambda x: x["t"]), " ").alias("line"))


def _fixed(column: str, places: int):
    return F.format_string(f"%.{places}f", column)


def write_assignments(z: DataFrame, prefix: str) -> list[str]:
    """{prefix}.{chrom}.bca: magic, then a byte per haplotype of window 0, of window 1, ..."""
    v = F.sort_array(F.collect_list(F.struct("hap", "cluster")))
    rows = z.groupBy("chrom", "window").agg(F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x["cluster"]), 2, "0")), "")).alias("content"))
    return _each(rows, ["window"], prefix, ".bca", MAGIC)


def write_bed(bed: DataFrame, row: list[str], path: str) -> str:
    """One SNP-major .bed file of (row..., byte_idx, byte), in the order of ``row``."""
    v = F.sort_array(F.collect_list(F.struct("byte_idx", "byte")))
    content = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), ""))
    rows = bed.groupBy(*row).agg(content.alias("content")).orderBy(*row).select("content").toLocalIterator()
    return put(bed.sparkSession, path, itertools.chain([PLINK_MAGIC], (bytes(r.content) for r in rows)))


def write_samples(samples: DataFrame, path: str) -> str:
    """The ids, in the order of samples. samples: (sample, iid)."""
    return _lines(samples.select("sample", F.col("iid").alias("line")), ["sample"], path)


#: Unpacked bytes of a block, and the block that ends a file (fixed value of the format).
BLOCK_BYTES = 65280
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _blocks(chunks: Iterable[bytes], size: int) -> Iterable[bytes]:
    """BGZF blocks of a stream: gzip members that say how long they are."""
    held = bytearray()
    for chunk in itertools.chain(chunks, [None]):
        held += chunk or b""
        while len(held) >= size or (chunk is None and held):
            part = bytes(held[:size])
            del held[:size]
            z = zlib.compressobj(wbits=-15)
            body = z.compress(part) + z.flush()
            head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
            yield head + body + struct.pack("<II", zlib.crc32(part), len(part))
    yield LAST_BLOCK


def write_bcf(haplotypes: DataFrame, path: str, *, block_bytes: int = BLOCK_BYTES) -> str:
    """One BCF file of phased calls (chrom, pos, hap, sample, allele), missing alleles null, records in order of
    chromosome and position. Executors make the records; the driver packs the stream."""
    spark = haplotypes.sparkSession
    calls = F.sort_array(F.collect_list(F.struct("hap", F.coalesce("allele", F.lit(-1)).alias("a"))))
    rows = haplotypes.groupBy("chrom", "pos").agg(F.transform(calls, lambda x: x["a"]).alias("v"))
    chroms = [r.chrom for r in haplotypes.select("chrom").distinct().orderBy("chrom").collect()]  # a row per chromosome
    samples = haplotypes.select("sample").distinct().count()
    lines = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', *[f"##contig=<ID={c}>" for c in chroms]]
    lines.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *map(str, range(samples))]))
    text = ("\n".join(lines) + "\n\0").encode()

    def run(it):
        for pdf in it:
            out = []
            for chrom, pos, v in zip(pdf["chrom"], pdf["pos"], pdf["v"], strict=True):
                shared = struct.pack("<iiifII", chroms.index(chrom), pos - 1, 1, 0.0, 2 << 16, 1 << 24 | samples) + b"\x17." + b"\x17A" + b"\x17C" + b"\x11\x00"
                codes = (np.asarray(v, np.int64) + 1) << 1
                codes[1::2] |= 1  # phased
                own = b"\x11\x01\x21" + codes.astype(np.int8).tobytes()
                out.append(struct.pack("<II", len(shared), len(own)) + shared + own)
            pdf["content"] = out
            yield pdf[["chrom", "pos", "content"]]

    made = rows.mapInPandas(run, "chrom string, pos long, content binary").orderBy("chrom", "pos").select("content").toLocalIterator()
    head = b"BCF\x02\x02" + struct.pack("<I", len(text)) + text
    return put(spark, path, _blocks(itertools.chain([head], (bytes(r.content) for r in made)), block_bytes))


def write_windows(windows: DataFrame, prefix: str) -> list[str]:
    """{prefix}.{chrom}.win: header and tab-separated rows."""
    line = F.concat_ws("\t", "chrom", *[F.col(c).cast("string") for c in ("start", "end", "length", "size", "k")])
    df = windows.select("chrom", "window", F.concat(line, F.lit("\n")).cast("binary").alias("content"))
    return _each(df, ["window"], prefix, ".win", ("\t".join(WIN_HEADER) + "\n").encode())


def write_medians(medians: DataFrame, windows: DataFrame, prefix: str) -> list[str]:
    """{prefix}.{chrom}.bcm: magic, then a byte per SNP of every median. medians: (chrom, window, cluster, bits)."""
    df = medians.join(windows.select("chrom", "window", "size"), ["chrom", "window"])
    alleles = B.alleles("bits", F.col("size"), B.is_wide(medians))
    content = F.unhex(F.array_join(F.transform(alleles, lambda a: F.concat(F.lit("0"), a.cast("string"))), ""))
    return _each(df.select("chrom", "window", "cluster", content.alias("content")), ["window", "cluster"], prefix, ".bcm", MAGIC)


def _floats(df: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    """(keys, content): the values of a group in the order of ``by``, four bytes each."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields) + ", content binary"

    def run(it):
        for pdf in it:
            pdf["content"] = [pd.Series([x[value] for x in v]).to_numpy("<f4").tobytes() for v in pdf["v"]]
            yield pdf[[*keys, "content"]]

    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(by, value))).alias("v")).mapInPandas(run, schema)


def write_loglik(ll: DataFrame, prefix: str) -> list[str]:
    """{prefix}.{chrom}.blk: magic, then every window's matrix row by row, four bytes a value."""
    return _each(_floats(ll, ["chrom", "window", "c1"], "c2", "ll"), ["window", "c1"], prefix, ".blk", MAGIC)


def write_starts(windows: DataFrame, prefix: str) -> list[str]:
    """{prefix}.{chrom}.wix: the first SNP of every window. windows: (chrom, window, snp, pos, j)."""
    first = windows.groupBy("chrom", "window").agg(F.min("snp").alias("snp"))
    return _each(first.select("chrom", "window", F.concat(F.col("snp").cast("string"), F.lit("\n")).cast("binary").alias("content")), ["window"], prefix, ".wix", b"")


def write_clusters(clustered, samples: DataFrame, prefix: str) -> list[str]:
    """All files of a clustering (``verbs.Clustered``)."""
    out = write_assignments(clustered.assignments, prefix) + write_windows(clustered.windows, prefix) + [write_samples(samples, f"{prefix}.ids")]
    if clustered.loglik is not None:
        out += write_medians(clustered.medians, clustered.windows, prefix) + write_loglik(clustered.loglik, prefix)
    return out


def _family(samples: DataFrame, duplicate_fid: bool) -> DataFrame:
    return samples.select("sample", (F.col("iid") if duplicate_fid else F.lit("0")).alias("fid"), "iid")


def write_grm(grm: DataFrame, denominator: float, samples: DataFrame, prefix: str, duplicate_fid: bool = False) -> list[str]:
    """{prefix}.grm.bin, .grm.N.bin and .grm.id: the lower triangle row by row and the denominator, four bytes
    each, and the ids."""
    rows = grm.where("i >= j")
    spark = grm.sparkSession
    values = (bytes(r.content) for r in _floats(rows, ["i"], "j", "g").orderBy("i").toLocalIterator())
    same = (bytes(r.content) for r in _floats(rows.withColumn("n", F.lit(float(denominator))), ["i"], "j", "n").orderBy("i").toLocalIterator())
    ids = _family(samples, duplicate_fid).select("sample", F.concat_ws("\t", "fid", "iid").alias("line"))
    return [put(spark, f"{prefix}.grm.bin", values), put(spark, f"{prefix}.grm.N.bin", same), _lines(ids, ["sample"], f"{prefix}.grm.id")]


def write_components(vectors: DataFrame, values: DataFrame, samples: DataFrame, prefix: str, *, raw: bool = False, duplicate_fid: bool = False) -> list[str]:
    """{prefix}.eigenvecs and .eigenvals. vectors: (sample, pc, v), pc from 1; values: (pc, val). raw: no ids."""
    if raw:
        df, header = _row(vectors, ["sample"], "pc", _fixed("v", 6)), ""
    else:
        n = vectors.agg(F.max("pc")).first()[0]
        v = F.sort_array(F.collect_list(F.struct("pc", F.round("v", 7).cast("string").alias("t"))))
        df = vectors.groupBy("sample").agg(F.array_join(F.transform(v, lambda x: x["t"]), "\t").alias("t")).join(_family(samples, duplicate_fid), "sample")
        df, header = df.select("sample", F.concat_ws("\t", "fid", "iid", "t").alias("line")), "\t".join(["#FID", "IID", *[f"PC{k}" for k in range(1, n + 1)]])
    return [_lines(df, ["sample"], f"{prefix}.eigenvecs", header), _lines(values.select("pc", _fixed("val", 6).alias("line")), ["pc"], f"{prefix}.eigenvals")]


def write_loadings(loadings: DataFrame, freqs: DataFrame, prefix: str) -> list[str]:
    """{prefix}.loadings and .freqs, a line per cluster allele that varies."""
    cell = ["chrom", "window", "cluster"]
    kept = freqs.join(loadings.select(*cell).distinct(), cell, "left_semi")
    return [_lines(_row(loadings, cell, "pc", _fixed("u", 6)), cell, f"{prefix}.loadings"), _lines(kept.select(*cell, _fixed("p", 6).alias("line")), cell, f"{prefix}.freqs")]


def write_proportions(p: DataFrame | None, q: DataFrame, prefix: str) -> list[str]:
    """{prefix}.Q, and for each chromosome {prefix}.{chrom}.P, listed in {prefix}.pfilelist where there are
    several; p None: q only."""
    out = [_lines(_row(q, ["sample"], "k", _fixed("q", 6)), ["sample"], f"{prefix}.Q")]
    if p is None:
        return out
    rows = _row(p, ["chrom", "window", "cluster"], "k", _fixed("p", 6))
    files = _each(rows.withColumn("content", F.concat("line", F.lit("\n")).cast("binary")), ["window", "cluster"], prefix, ".P", b"")
    listed = [put(q.sparkSession, f"{prefix}.pfilelist", [("\n".join(files) + "\n").encode()])] if len(files) > 1 else []
    return out + files + listed


def write_path(path: DataFrame, prefix: str) -> list[str]:
    """{prefix}.{chrom}.path, and .prob where there are posteriors: a line per haplotype, a number per window."""
    line = lambda text: _row(path, ["chrom", "hap"], "window", text).withColumn("content", F.concat("line", F.lit("\n")).cast("binary"))
    out = _each(line(F.col("k").cast("string")), ["hap"], prefix, ".path", b"")
    return out + (_each(line(_fixed("prob", 3)), ["hap"], prefix, ".prob", b"") if "prob" in path.columns else [])


def write_log(spark: SparkSession, verb: str, options: dict, defaults: dict, prefix: str) -> str:
    """{prefix}.log: the verb and the options that differ from their defaults."""
    lines = [verb, "Options:", *[f"\t--{k}" + ("" if v is True else f" {v}") for k, v in options.items() if v != defaults.get(k)]]
    return put(spark, f"{prefix}.log", ["\n".join(lines).encode() + b"\n"])
