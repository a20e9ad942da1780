"""Binary files read by byte ranges: one file of any size is dealt over many tasks.

Spark's own binary source reads a file whole, as one row. Here a Python data source cuts files of
fixed-size records into partitions of about ``partition_bytes``, each of which opens the file and reads its
own stretch; files of unequal records are read by a table of spans. Files are opened by Arrow's file
systems (local, S3, GCS, HDFS, ABFS), by the scheme of their address.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandworks.sources.codecs import MAGIC, PLINK_MAGIC

#: Bytes of a partition, and of a batch of rows.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; without a scheme the local one."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sizes(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(address, bytes) of the file, or of the folder's files with the suffix, by name."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((path.rstrip("/") + "/" + x.base_name, x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith(suffix) and not x.base_name.startswith((".", "_")))


def checked(file, magic: bytes, path: str) -> None:
    file.seek(0)
    if file.read(len(magic)) != magic:
        raise ValueError(f"{path} does not open with {magic.hex()}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.record, self.magic = int(options["record"]), bytes.fromhex(options.get("magic", ""))
        self.step = max(1, int(options.get("partition_bytes", PARTITION_BYTES)) // self.record)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in sizes(self.path, self.suffix):
            system, inner = located(path)
            with system.open_input_file(inner) as f:
                checked(f, self.magic, path)
            n, rest = divmod(size - len(self.magic), self.record)
            if rest:
                raise ValueError(f"{path} does not hold whole records of {self.record} bytes")
            out += [InputPartition((path, first, min(self.step, n - first))) for first in range(0, n, self.step)]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a record
            return
        path, first, count = partition.value
        system, inner = located(path)
        step = max(1, BATCH_BYTES // self.record)
        with system.open_input_file(inner) as f:
            f.seek(len(self.magic) + first * self.record)
            for at in range(first, first + count, step):
                n = min(step, first + count - at)
                data = pa.py_buffer(f.read(n * self.record))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * self.record).buffers()[1]
                content = pa.Array.from_buffers(pa.binary(), n, [None, ends, data])
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(at, at + n)), content], names=["file", "record", "content"])


class FixedRecords(DataSource):
    """(file, record, content) of files with a fixed head and records of one size behind it.

    Options: path (a file or a folder), suffix (of a folder's files), magic (the head, as hex), record (bytes of
    one) and partition_bytes. A file without the head, or with part of a record at its end, raises.
    """

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return "file string, record long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def fixed_records(spark: SparkSession, path: str, magic: bytes, record: int, *, suffix: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(FixedRecords)
    options = {"magic": magic.hex(), "record": record, "suffix": suffix, "partition_bytes": partition_bytes}
    return spark.read.format("fixed_records").options(**options).load(path)


def _bytes_of(batches: Iterator[pa.RecordBatch], keep: int):
    """Of batches whose last column is binary, the first ``keep`` columns repeated for every byte, the place of each
    byte in its row, and the bytes, in batches of about BATCH_BYTES."""
    for batch in batches:
        size = pc.binary_length(batch.column(keep)).to_numpy()
        part = np.cumsum(size) // BATCH_BYTES
        for k in np.unique(part):
            some = np.flatnonzero(part == k)
            rows = batch.slice(int(some[0]), len(some))
            own = size[some]
            data = np.frombuffer(b"".join(x.as_py() for x in rows.column(keep)), np.uint8).astype(np.int64)
            place = np.arange(len(data)) - np.repeat(np.cumsum(own) - own, own)
            at = pa.array(np.repeat(np.arange(len(own)), own))
            yield [rows.column(i).take(at) for i in range(keep)], place, data


def read_bed(spark: SparkSession, path: str, samples: int, *, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(snp, byte_idx, byte) of a SNP-major .bed file."""
    rows = fixed_records(spark, path, PLINK_MAGIC, max(1, -(-samples // 4)), suffix=".bed", partition_bytes=partition_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (snp,), place, data in _bytes_of(batches, 1):
            yield pa.RecordBatch.from_arrays([snp, pa.array(place), pa.array(data)], names=["snp", "byte_idx", "byte"])

    return rows.select("record", "content").mapInArrow(run, "snp long, byte_idx long, byte long")


def chromosome_of(file: str) -> "F.Column":
    """The chromosome in the name of a file: {prefix}.{chrom}.{suffix}."""
    return F.regexp_extract(file, r"([^./]+)\.[^./]+$", 1)


def read_assignments(spark: SparkSession, path: str, haplotypes: int, *, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(chrom, window, hap, sample, cluster) of the .bca file, or of all in a folder: a record is a window."""
    rows = fixed_records(spark, path, MAGIC, haplotypes, suffix=".bca", partition_bytes=partition_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chrom, window), place, data in _bytes_of(batches, 2):
            yield pa.RecordBatch.from_arrays([chrom, window, pa.array(place), pa.array(place // 2), pa.array(data)], names=["chrom", "window", "hap", "sample", "cluster"])

    return rows.select(chromosome_of("file").alias("chrom"), "record", "content").mapInArrow(run, "chrom string, window long, hap long, sample long, cluster long")


def read_spans(spans: DataFrame, keys: list[str], magic: bytes, *, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(keys, content) of (keys, file, start, length): the bytes of every span.

    Spans are sorted by file and place and dealt to tasks of about ``partition_bytes``, so a task reads
    neighbours from files that it opens once, and checks the head of each.
    """
    total = spans.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = int(max(1, -(-total // partition_bytes)))
    dealt = spans.select(*keys, "file", "start", "length").repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f = None
        try:
            for batch in batches:
                out = []
                for file, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                    if file != path:
                        if f is not None:
                            f.close()
                        system, inner = located(file)
                        path, f = file, system.open_input_file(inner)
                        checked(f, magic, path)
                    f.seek(start)
                    data = f.read(length)
                    if len(data) < length:
                        raise ValueError(f"{path} ends inside a record")
                    out.append(data)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "content"])
        finally:
            if f is not None:
                f.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.select(*keys).schema.fields) + ", content binary"
    return dealt.mapInArrow(run, schema)


def _placed(windows: DataFrame, files: DataFrame, length: "F.Column") -> DataFrame:
    """Windows with their file, the place of their bytes and how many they are: windows lie one behind the other."""
    before = Window.partitionBy("chrom").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    w = windows.withColumn("length", length.cast("long")).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)) + len(MAGIC))
    return w.join(files, "chrom")


def read_medians(files: DataFrame, windows: DataFrame, *, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(chrom, window, cluster, j, allele) of .bcm files. files: (chrom, file); windows: (chrom, window, size, k)."""
    spans = _placed(windows.select("chrom", "window", "size", "k"), files, F.col("k") * F.col("size"))
    rows = read_spans(spans, ["chrom", "window", "size"], MAGIC, partition_bytes=partition_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chrom, window, size), place, data in _bytes_of(batches, 3):
            n = size.to_numpy()
            yield pa.RecordBatch.from_arrays([chrom, window, pa.array(place // n), pa.array(place % n), pa.array(data)], names=["chrom", "window", "cluster", "j", "allele"])

    return rows.mapInArrow(run, "chrom string, window long, cluster long, j long, allele long")


def read_loglik(files: DataFrame, windows: DataFrame, *, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(chrom, window, c1, c2, ll) of .blk files. files: (chrom, file); windows: (chrom, window, k)."""
    spans = _placed(windows.select("chrom", "window", "k"), files, 4 * F.col("k") * F.col("k"))
    rows = read_spans(spans, ["chrom", "window", "k"], MAGIC, partition_bytes=partition_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(2).to_numpy()
            size = k * k
            at = np.repeat(np.arange(len(k)), size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            values = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), "<f4").astype(float)
            own = k[at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(place // own), pa.array(place % own), pa.array(values)], names=["chrom", "window", "c1", "c2", "ll"])

    return rows.mapInArrow(run, "chrom string, window long, c1 long, c2 long, ll double")
