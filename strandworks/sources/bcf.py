"""BCF2 files: BGZF blocks of typed binary records, decoded by numpy, a file dealt over many tasks.

A light pass hops over the blocks of a file: the head of a block says where the next one begins, its last
bytes how much text it holds, so every block gets its place in the unpacked file without being unpacked.
Runs of blocks are ranges. Records ignore the borders of blocks, and nothing marks where one begins: each
range looks for the first place from which all of its bytes read as records of the file's samples, and
says where its last record ends, behind its own blocks if need be. That end must be the next range's
beginning; where one is not, the ranges are found to be wrong and the scan raises. Then each range is decoded.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.functions.store import written
from strandworks.sources.records import PARTITION_BYTES, located, sizes

#: Fixed values of the format: numpy types of its integers by code, and what marks a vector's end.
INTEGERS = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 3: np.dtype("<i4")}
SIZES = {0: 0, 1: 1, 2: 2, 3: 4, 5: 4, 7: 1}
#: Largest block of BGZF, bytes of its head that are read to know its size, and bytes of a record before its alleles.
BLOCK, HEAD, FIXED = 1 << 16, 64, 32
END = {1: -127, 2: -32767, 3: -2147483647}


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, count, place of the values) of a typed vector."""
    kind, n, at = data[at] & 15, data[at] >> 4, at + 1
    if n == 15:
        inner, _, at = _typed(data, at)
        n = int(np.frombuffer(data, INTEGERS[inner], 1, at)[0])
        at += SIZES[inner]
    return kind, n, at


def _dictionaries(header: str) -> tuple[list[str], dict[int, str]]:
    """Names of contigs in order, and of filters, infos and formats by their number."""
    contigs, names = [], {0: "PASS"}
    for line in header.splitlines():
        m = re.match(r"##(contig|FILTER|INFO|FORMAT)=<.*?\bID=([^,>]+)", line)
        if not m:
            continue
        if m[1] == "contig":
            contigs.append(m[2])
        elif m[2] not in names.values():
            given = re.search(r"\bIDX=(\d+)", line)
            names[int(given[1]) if given else len(names)] = m[2]
    return contigs, names


def records(content: bytes):
    """(chromosome, position from 1, alleles per sample with -1 for missing, phased per sample) of every
    record that has genotypes; others than biallelic ones raise. Haploid calls fill the second place with -1."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    contigs, names, _, at = _opened(data)
    yield from _parsed(data, at, len(data), contigs, names)


def _opened(data: bytes):
    """(contigs, names, samples, place of the first record) of an unpacked file's beginning."""
    if data[:4] != b"BCF\x02":
        raise ValueError("not a BCF2 file")
    (length,) = struct.unpack_from("<I", data, 5)
    header = data[9 : 9 + length].decode("utf-8", "replace")
    columns = next((line for line in header.splitlines() if line.startswith("#CHROM")), "").rstrip("\0").split("\t")
    return *_dictionaries(header), len(columns) - 9, 9 + length


def _parsed(data: bytes, at: int, stop: int, contigs: list[str], names: dict[int, str]):
    """The records that begin in at..stop-1."""
    while at < stop:
        shared, individual = struct.unpack_from("<II", data, at)
        start, at = at + 8, at + 8 + shared + individual
        chrom, pos, _, _, info, fmt = struct.unpack_from("<iiifII", data, start)
        samples = fmt & 0xFFFFFF
        if not samples:
            continue
        if info >> 16 != 2:
            raise ValueError(f"not biallelic: {contigs[chrom]}:{pos + 1}")
        place = start + shared
        for _ in range(fmt >> 24):
            kind, _, place = _typed(data, place)
            key = int(np.frombuffer(data, INTEGERS[kind], 1, place)[0])
            kind, n, place = _typed(data, place + SIZES[kind])
            if names.get(key) == "GT" and kind in INTEGERS:
                v = np.frombuffer(data, INTEGERS[kind], samples * n, place).reshape(samples, n).astype(np.int64)
                alleles = np.where(v == END[kind], -1, (v >> 1) - 1)
                if n < 2:
                    alleles = np.concatenate((alleles, np.full((samples, 2 - n), -1)), 1)
                yield contigs[chrom], pos + 1, alleles[:, :2], (v[:, 1] & 1 == 1) if n > 1 else np.zeros(samples, bool)
            place += samples * n * SIZES[kind]


# --- ranges of blocks ---

def _block_size(head: bytes) -> int | None:
    """Bytes of a BGZF block, from its first ones; None if it is none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    (extra,), at = struct.unpack_from("<H", head, 10), 12
    while at + 6 <= min(len(head), 12 + extra):
        tag, (n,) = head[at : at + 2], struct.unpack_from("<H", head, at + 2)
        if tag == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def block_ranges(f, size: int, partition_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, byte behind, first unpacked byte, unpacked byte behind) of runs of blocks; one run with
    unpacked ends of -1 for a file that has no BGZF blocks. Reads some 70 bytes of each block."""
    at = begin = unpacked = first = 0
    f.seek(0)
    head = f.read(HEAD)
    if _block_size(head) is None:
        yield 0, size, 0, -1
        return
    while at < size:
        n = _block_size(head)
        if n is None:
            raise ValueError(f"no block at byte {at}")
        f.seek(at + n - 4)
        both = f.read(4 + HEAD)
        at, unpacked, head = at + n, unpacked + struct.unpack_from("<I", both)[0], both[4:]
        if at - begin >= partition_bytes or at >= size:
            yield begin, at, first, unpacked
            begin, first = at, unpacked


def _unpacked(f, begin: int) -> Iterator[bytes]:
    """The blocks from a byte on, unpacked one by one."""
    while True:
        f.seek(begin)
        block = f.read(BLOCK)
        n = _block_size(block)
        if n is None:
            return
        (extra,) = struct.unpack_from("<H", block, 10)
        yield zlib.decompress(block[12 + extra : n - 8], -15)
        begin += n


class _Stretch:
    """The unpacked bytes of a range, and of as many blocks behind it as are asked for."""

    def __init__(self, f, begin: int, end: int, first: int, stop: int):
        self.blocks, self.first, self.stop = _unpacked(f, begin), first, stop
        self.data = bytearray()
        self.reach(stop - first)
        self.own = min(len(self.data), stop - first)

    def reach(self, n: int) -> bool:
        """Whether there are so many bytes, after reading on."""
        while len(self.data) < n and (more := next(self.blocks, None)) is not None:
            self.data += more
        return len(self.data) >= n

    def chain(self, at: int, contigs: int, samples: int) -> int | None:
        """The end of the last record that begins in the range, if all bytes from ``at`` on read as records."""
        while at < self.own:
            if not self.reach(at + FIXED):
                return None
            shared, individual, chrom, pos, _, _, info, fmt = struct.unpack_from("<IIiiifII", self.data, at)
            if shared < FIXED - 8 or not 0 <= chrom < contigs or pos < -1 or fmt & 0xFFFFFF != samples or info >> 16 == 0:
                return None
            if not self.reach(at + 8 + shared + individual):
                return None
            at += 8 + shared + individual
        return at

    def entry(self, contigs: int, samples: int) -> tuple[int, int] | None:
        """(place of the first record, end of the last); None if no record begins in the range."""
        mark, at = samples.to_bytes(3, "little"), -1
        self.reach(self.own + FIXED)
        while (at := self.data.find(mark, at + 1)) >= 0 and at - 28 < self.own:
            if at >= 28 and (end := self.chain(at - 28, contigs, samples)) is not None:
                return at - 28, end
        return None


def _header(f):
    """``_opened`` of a packed file, from as many blocks as it takes."""
    data = bytearray()
    for block in _unpacked(f, 0):
        data += block
        if len(data) >= 9 and len(data) >= 9 + struct.unpack_from("<I", data, 5)[0]:
            break
    return _opened(bytes(data))


RANGE = "file string, part long, begin long, end long, first long, stop long"


def ranges(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(file, part, begin, end, first, stop) of the file, or of a folder's .bcf files: one task a file."""
    files = spark.createDataFrame(sizes(path, ".bcf"), "file string, size long")  # a row per file
    files = files.repartition(max(1, min(1000, files.count())), "file")

    def run(it):
        for pdf in it:
            for file, size in zip(pdf["file"], pdf["size"], strict=True):
                system, inner = located(file)
                with system.open_input_file(inner) as f:
                    got = list(block_ranges(f, int(size), partition_bytes))
                yield pd.DataFrame([(file, k, *x) for k, x in enumerate(got)], columns=["file", "part", "begin", "end", "first", "stop"])

    return written(files.mapInPandas(run, RANGE))


def entries(found: DataFrame) -> DataFrame:
    """Ranges with (entry, exit), the unpacked places where their first record begins and their last one ends.

    Every range's exit must be the entry of the next one that has any, else the scan raises.
    """

    def run(it):
        for pdf in it:
            entry, leave = [], []
            for file, begin, end, first, stop in zip(pdf["file"], pdf["begin"], pdf["end"], pdf["first"], pdf["stop"], strict=True):
                if stop < 0:
                    entry.append(0)
                    leave.append(-1)
                    continue
                system, inner = located(file)
                with system.open_input_file(inner) as f:
                    contigs, _, samples, opened = _header(f)
                    s = _Stretch(f, begin, end, first, stop)
                    if first <= opened < stop:
                        end_ = s.chain(opened - first, len(contigs), samples)
                        if end_ is None:
                            raise ValueError(f"{file} does not hold records behind its header")
                        got = (opened - first, end_)
                    else:
                        got = s.entry(len(contigs), samples) if stop > opened else None
                entry.append(None if got is None else first + got[0])
                leave.append(None if got is None else first + got[1])
            yield pdf.assign(entry=pd.array(entry, "Int64"), exit=pd.array(leave, "Int64"))

    n = found.count()
    df = written(found.repartitionByRange(max(1, n), "file", "part").mapInPandas(run, RANGE + ", entry long, exit long"))
    after = F.lead("entry").over(Window.partitionBy("file").orderBy("part"))
    bad = df.where("entry is not null").withColumn("next", after).where("next is not null and next <> exit")
    if bad.limit(1).count():
        raise ValueError(f"records of {bad.first().file} cannot be told apart at the borders of ranges: read it with a larger partition_bytes")
    return df


def read_bcf(spark: SparkSession, path: str, *, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(chrom, pos, hap, sample, allele, phased): two rows per sample and record, missing alleles null.

    Ranges of about ``partition_bytes`` packed bytes are decoded in a task each; a file that is plain or packed
    otherwise than in blocks is decoded whole in one. The record that a range ends with is read beyond it.
    """
    parts = entries(ranges(spark, path, partition_bytes)).where("entry is not null")
    parts = parts.repartitionByRange(max(1, parts.count()), "file", "part")

    def run(it):
        for pdf in it:
            for row in pdf.itertuples():
                system, inner = located(row.file)
                with system.open_input_file(inner) as f:
                    if row.stop < 0:
                        found = records(f.read())
                    else:
                        contigs, names, _, _ = _header(f)
                        s = _Stretch(f, row.begin, row.end, row.first, row.stop)
                        s.reach(int(row.exit) - row.first)
                        found = _parsed(bytes(s.data), int(row.entry) - row.first, int(row.exit) - row.first, contigs, names)
                    for chrom, pos, alleles, phased in found:
                        n = len(alleles)
                        flat = pd.Series(alleles.ravel(), dtype="Int64")
                        yield pd.DataFrame({
                            "chrom": chrom, "pos": pos, "hap": np.arange(2 * n), "sample": np.repeat(np.arange(n), 2),
                            "allele": flat.mask(flat < 0), "phased": np.repeat(phased, 2),
                        })

    return parts.mapInPandas(run, "chrom string, pos long, hap long, sample long, allele long, phased boolean")
