"""Byte-level byte-pair encoding: pre-tokens found by scans over arrays (``pretokens``), merged once per distinct
one, decoded back.

The slices that the scans cut go through a cache of merged ids; the end of every token in bytes is kept, so
that any stretch of a text can be decoded from the ids that cover it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import free_name, staying, table
from strandworks.llm.pretokens import sliced, windows
from strandworks.llm.token_counts import PATTERN, VOCABULARY, VOCABULARY_BYTES

#: Pre-tokens whose ids a worker remembers, and the longest of them in bytes.
CACHE, CACHED_BYTES = 1 << 18, 64

class Codec:
    """Ids of pre-tokens by the merges of a vocabulary of ranks, and bytes of ids."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.bytes[rank] = piece
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.merges = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every pre-token, as 32-bit integers; short ones are merged once and remembered.

        The merges within one pre-token are the library's; it splits nothing here."""
        known, merged = self.known, self.merges._encode_single_piece
        if len(known) > CACHE:
            known.clear()
        fresh = set(pieces).difference(known)
        for p in fresh:
            known[p] = array("i", merged(p)).tobytes()
        out = list(map(known.__getitem__, pieces))
        for p in fresh:
            if len(p) > CACHED_BYTES:
                del known[p]
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        strings = [(t or b"").decode("utf-8", "replace") for t in texts]
        ids, counts = [], np.zeros(len(strings), np.int64)
        for places, parts in windows(strings):
            for part, found in parts:
                got, n = self._together(part, found)
                ids.append(got)
                counts[places] += n
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def _together(self, strings: list[str], found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        _, slices, until = sliced(strings, found)
        tokens = self.of(slices)
        flat, sizes = np.frombuffer(b"".join(tokens), np.int32), np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        return flat, np.diff(np.append(0, np.cumsum(sizes))[until])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def _codec(digest: str, ranks: bytes) -> Codec:
    return Codec(ranks)


def codec(ranks: bytes) -> Codec:
    return _codec(hashlib.sha256(ranks).hexdigest(), ranks)


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary, read on the driver and broadcast; never more than VOCABULARY_BYTES."""
    with open(vocabulary, "rb") as f:
        ranks = f.read(VOCABULARY_BYTES + 1)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(ranks)


INTS = T.ArrayType(T.IntegerType())


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, text: str = "text", *, vocabulary: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """Append ``ids``, the text's tokens, and ``ends``, the byte behind each; with ``decoded`` also the bytes that
    the ids give back, made in the same pass.

    A null or empty text has no tokens (empty arrays, no bytes). Bytes that are no UTF-8 are read as U+FFFD. Every
    row is encoded by itself, so repeated rows get equal values and ties cannot occur; an empty table stays empty.
    Columns named like the appended ones are replaced, all others stay. A very long text is split in windows,
    in one task and in time and memory proportional to it.
    """
    shared = _shared(docs, vocabulary)
    fields = [T.StructField("ids", INTS), T.StructField("ends", INTS)] + [T.StructField("decoded", T.BinaryType())] * decoded

    def kernel(texts: list[bytes | None]) -> dict:
        own = codec(shared.value)
        ids, counts = own.encode(texts)
        until = np.append(0, np.cumsum(counts))
        ends = np.append(0, np.cumsum(own.lengths[ids]))
        made = {"ids": _lists(ids, counts), "ends": _lists(ends[1:] - np.repeat(ends[until[:-1]], counts), counts)}
        if decoded:
            made["decoded"] = [own.decode(ids[a:b]) for a, b in pairwise(until.tolist())]
        return made

    return append_columns(docs, text, fields, kernel)


def decode(df: DataFrame, ids: str = "ids", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Append ``decoded``, the bytes of the ids, in order. Null or empty ids give no bytes; a null or unknown id raises.

    A column named decoded is replaced; repeated rows get equal values, an empty table stays empty.
    """
    shared = _shared(df, vocabulary)
    keep = staying(df, ["decoded"])
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])
    inner = df.select(df[ids].alias(free_name(df, "__ids")), *[df[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            out = [b"".join(own.bytes[i] for i in x or ()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return inner.mapInArrow(run, schema)


def covering(ids: str, ends: str, start: Column, stop: Column) -> Column:
    """Of an encoded row: (ids, skip), the ids that cover the bytes start..stop-1 of the text, and how many bytes of
    their first one lie before ``start``. Decoding them gives any stretch of a text without the rest of it."""
    before = F.size(F.filter(ends, lambda e: e <= start))
    through = F.size(F.filter(ends, lambda e: e < stop)) + 1
    skip = start - F.when(before > 0, F.element_at(ends, F.greatest(before, F.lit(1)))).otherwise(0)
    return F.struct(F.slice(ids, before + 1, F.greatest(through - before, F.lit(0))).alias("ids"), skip.alias("skip"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as counts and digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = encode(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
