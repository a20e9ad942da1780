import gzip
import struct

import pytest

from strandworks.sources import bcf

HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="ok">
##contig=<ID=chr1>
##contig=<ID=chr2>
##INFO=<ID=AC,Number=A,Type=Integer,Description="x">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
#CHROM\tPOS\n\0"""


def text(s):
    return bytes([len(s) << 4 | 7]) + s.encode()


def record(chrom, pos, alleles, gt, ploidy=2):
    shared = struct.pack("<iiifII", chrom, pos - 1, 1, 0.0, len(alleles) << 16 | 1, 2 << 24 | len(gt))
    shared += text(".") + b"".join(map(text, alleles)) + bytes([0x11, 0]) + bytes([0x11, 1, 0x11, 5])
    dp = bytes([0x11, 2, 0x11]) + bytes([9] * len(gt))
    calls = bytes([0x11, 3, ploidy << 4 | 1]) + b"".join(bytes(x) for x in gt)
    return struct.pack("<II", len(shared), len(dp + calls)) + shared + dp + calls


def code(a, b, phased=True):
    return [(a + 1) << 1, (b + 1) << 1 | phased]


def test_bcf_records(spark, tmp_path):
    body = record(0, 5, ["A", "C"], [code(0, 1), code(1, 1, False), code(-1, 0)])
    body += record(1, 9, ["A", "C"], [[4, 0x81], code(0, 0), code(0, 1)])
    data = b"BCF\x02\x02" + struct.pack("<I", len(HEADER)) + HEADER.encode() + body
    (tmp_path / "x.bcf").write_bytes(gzip.compress(data[:100]) + gzip.compress(data[100:]))
    rows = bcf.read_bcf(spark, str(tmp_path / "x.bcf")).collect()
    got = {(r.chrom, r.pos, r.hap): r.allele for r in rows}
    assert got == {
        ("chr1", 5, 0): 0, ("chr1", 5, 1): 1, ("chr1", 5, 2): 1, ("chr1", 5, 3): 1, ("chr1", 5, 4): None, ("chr1", 5, 5): 0,
        ("chr2", 9, 0): 1, ("chr2", 9, 1): None, ("chr2", 9, 2): 0, ("chr2", 9, 3): 0, ("chr2", 9, 4): 0, ("chr2", 9, 5): 1,
    }
    assert {(r["sample"], r.phased) for r in rows if r.pos == 5} == {(0, True), (1, False), (2, True)}
    with pytest.raises(ValueError, match="chr1:6"):
        list(bcf.records(data + record(0, 6, ["A", "C", "G"], [code(0, 2)] * 3)))
