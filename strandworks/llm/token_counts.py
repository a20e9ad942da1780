"""Edit-aware token counts: a segment tree over the pre-tokens of every document, kept as a table.

A text is split once into pre-tokens, which the merges of byte-pair encoding never cross, so the
text's count is the sum of theirs. The tree's leaves are blocks of pre-tokens, its nodes sums of
characters and tokens. ``trees`` makes a store: a row per document with its text and the sums of its
leaves (some 12 bytes for 350 characters), from which the nodes above follow by addition. ``edited``
takes edits to the store: an edit descends to the block of its place, splits that block again from a
pre-token that cannot see the edit until the new pieces fall in step with the old ones behind it, and
adds the differences along the paths to the root. Blocks without an edit are neither split nor encoded,
and the new row takes the next edits.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandworks.llm import pretokens
from strandworks.llm.arrow_map import PIECE_BYTES, append_columns
from strandworks.llm.common import materialize, numbered, staying, table

#: A vocabulary file of ranks, and the pattern that splits texts before its merges (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a new leaf; a leaf that grows beyond four times that is dealt to new ones.
LEAF = 64
#: Longest part of the vocabulary's file, and entries of a worker's cache of counts.
VOCABULARY_BYTES, CACHE = 64 << 20, 1 << 18

_SPLIT = regex.compile(PATTERN)


@functools.cache
def _odd() -> frozenset[str]:
    """Code points of which the pattern's engine has another idea than the classes of ``pretokens``."""
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    own = {kind: set(regex.findall(pattern, every)) for kind, pattern in ((pretokens.LETTER, r"\p{L}"), (pretokens.NUMBER, r"\p{N}"))}
    table_ = pretokens.classes()
    return frozenset().union(*(own[kind] ^ {chr(c) for c in np.flatnonzero(table_ == kind)} for kind in own))


def split(text: str) -> list[str]:
    """The pre-tokens of a short text: by the pattern, unless a code point of it is in doubt."""
    if text.isascii() or _odd().isdisjoint(text):
        return _SPLIT.findall(text)
    at = pretokens.starts(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist()
    return [text[a:b] for a, b in itertools.pairwise([*at, len(text)])]


class Counter:
    """Tokens of a pre-token, remembered up to CACHE entries."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.known: dict[str, int] = {}
        self.known_bytes: dict[bytes, int] = {}

    def all_bytes(self, pieces: list[bytes]) -> np.ndarray:
        known = self.known_bytes
        if len(known) > CACHE:
            known.clear()
        single = self.bpe._encode_single_piece
        for p in set(pieces).difference(known):
            known[p] = len(single(p))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def all(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        single = self.bpe._encode_single_piece
        for p in set(pieces).difference(known):
            known[p] = len(single(p))
        return [known[p] for p in pieces]


@functools.lru_cache(2)
def _counter(digest: str, ranks: bytes) -> Counter:
    return Counter(ranks)


def counter(ranks: bytes) -> Counter:
    return _counter(hashlib.sha256(ranks).hexdigest(), ranks)


class PieceTree:
    """Texts of leaves, their numbers of pre-tokens, and sums of characters and tokens above them.

    leaves: (characters, tokens, pre-tokens) of a stored tree, for the same text; else the text is split.
    """

    def __init__(self, text: str, count: Counter, leaves: list[tuple[int, int, int]] | None = None):
        self.count = count
        self.encoded = 0  # pre-tokens encoded after the first build
        if leaves is None:
            parts = self._dealt(split(text))
        else:
            parts, at = [], 0
            for chars, tokens, pieces in leaves:
                parts.append((text[at : at + chars], tokens, pieces))
                at += chars
        self._build(parts)

    def _dealt(self, pieces: list[str]) -> list[tuple[str, int, int]]:
        """(text, tokens, pre-tokens) of new leaves."""
        tokens = self.count.all(pieces)
        return [("".join(pieces[i : i + LEAF]), sum(tokens[i : i + LEAF]), len(pieces[i : i + LEAF])) for i in range(0, len(pieces), LEAF)]

    def _build(self, parts: list[tuple[str, int, int]]) -> None:
        parts = parts or [("", 0, 0)]
        self.parts, self.pieces = [t for t, _, _ in parts], [n for _, _, n in parts]
        self.base = 1
        while self.base < len(parts):
            self.base *= 2
        rest = [0] * (self.base - len(parts))
        self.chars, self.tokens = [0] * self.base + [len(t) for t in self.parts] + rest, [0] * self.base + [n for _, n, _ in parts] + rest
        for i in range(self.base - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaves(self) -> list[tuple[int, int, int]]:
        """Characters, tokens and pre-tokens of the leaves that are not empty."""
        return [(len(t), self.tokens[self.base + i], n) for i, (t, n) in enumerate(zip(self.parts, self.pieces, strict=True)) if n]

    def _split(self, leaf: int) -> list[str]:
        """The pre-tokens of a leaf; two characters behind it are all that its last one can see."""
        text, after = self.parts[leaf], ""
        for t in self.parts[leaf + 1 :]:
            after += t[:2]
            if len(after) > 1:
                break
        out, at = [], 0
        for p in split(text + after[:2]):
            if at >= len(text):
                break
            out.append(p)
            at += len(p)
        return out

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_pieces(self) -> int:
        return sum(self.pieces)

    def text(self) -> str:
        return "".join(self.parts)

    def tokens_before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``at``."""
        leaf, start = self._leaf(at)
        total, i = 0, self.base + leaf
        while i > 1:
            if i & 1:
                total += self.tokens[i - 1]
            i >>= 1
        pieces = self._split(leaf)
        for p, t in zip(pieces, self.count.all(pieces), strict=True):
            start += len(p)
            if start > at:
                break
            total += t
        return total

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one, past the end), and its first character."""
        at = min(at, max(0, self.n_chars - 1))
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return min(i - self.base, len(self.parts) - 1), start

    def _set(self, leaf: int, text: str, tokens: int, pieces: int) -> None:
        self.parts[leaf], self.pieces[leaf] = text, pieces
        i = self.base + leaf
        chars, total = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += chars
            self.tokens[i] += total
            i >>= 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end-1 by ``new``; places beyond the text mean its end."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        # The splitter looks at most two characters beyond a piece: pieces ending before start - 1 stand.
        leaf, begin = self._leaf(max(0, start - 2))
        pieces = self._split(leaf)
        k = 0
        while k < len(pieces) and begin + len(pieces[k]) < start - 1:
            begin += len(pieces[k])
            k += 1
        # old pieces from begin on, taken leaf by leaf until the new ones are in step with them
        kept, old = pieces[:k], pieces[k:]
        last = leaf
        while True:
            length = sum(map(len, old))
            whole = last == len(self.parts) - 1
            if begin + length > end or whole:
                joined = "".join(old)
                made = split(joined[: start - begin] + new + joined[end - begin :])
                step = self._step(old, made, begin, end, len(new) - (end - start), length, whole)
                if step is not None:
                    break
            last += 1
            old = old + self._split(last)
        n_old, n_new = step
        tokens = sum(self.tokens[self.base + i] for i in range(leaf, last + 1)) + sum(self.count.all(made[:n_new])) - sum(self.count.all(old[:n_old]))
        self.encoded += n_new + n_old
        now = kept + made[:n_new] + old[n_old:]
        for i in range(leaf + 1, last + 1):
            self._set(i, "", 0, 0)
        self._set(leaf, "".join(now), tokens, len(now))
        if len(now) > 4 * LEAF:
            every = list(zip(self.parts, self.tokens[self.base :], self.pieces, strict=False))
            self._build([*every[:leaf], *self._dealt(now), *every[leaf + 1 :]])

    @staticmethod
    def _step(old, made, begin: int, end: int, shift: int, length: int, whole: bool) -> tuple[int, int] | None:
        """How many old and new pieces lie before the first border that both share behind the edit."""
        limit = begin + length  # new borders within two characters of the cut-off are not final
        borders, at = {}, begin
        for i, p in enumerate(old):
            if at >= end:
                borders[at + shift] = i
            at += len(p)
        at = begin
        for j, p in enumerate(made):
            if at in borders and at - shift >= end and (whole or at - shift <= limit - 2):
                return borders[at], j
            at += len(p)
        return (len(old), len(made)) if whole else None


LEAVES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("chars", "tokens", "pieces")]))
_ARROW_LEAVES = to_arrow_type(LEAVES)


def _shared(docs: DataFrame, vocabulary: str):
    """The vocabulary, read on the driver and broadcast; never more than VOCABULARY_BYTES."""
    with open(vocabulary, "rb") as f:
        ranks = f.read(VOCABULARY_BYTES + 1)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(ranks)


def _rows(tree: PieceTree) -> list[dict]:
    return [{"chars": c, "tokens": t, "pieces": p} for c, t, p in tree.leaves()]


def trees(docs: DataFrame, text: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Append ``tree``, the leaves of the text's tree, to every row: the store that ``edited`` works on.

    A null or empty text has no leaves. Every row has its own tree, repeated rows equal ones; an empty table
    stays empty. A column named tree is replaced. A very long text is split in one task, in time and memory
    proportional to it.
    """
    shared = _shared(docs, vocabulary)
    kernel = lambda texts: {"tree": _leaves([(t or b"").decode("utf-8", "replace") for t in texts], counter(shared.value))}
    return append_columns(docs, text, [T.StructField("tree", LEAVES)], kernel)


def _leaves(strings: list[str], count: Counter) -> pa.Array:
    """The leaves of every text's new tree, those of all texts of a window in one go."""
    made: list = [None] * len(strings)
    for places, parts in pretokens.windows(strings):
        done = [(length, count.all_bytes(slices), until) for length, slices, until in (pretokens.sliced(*part) for part in parts)]
        if len(parts) > 1:  # a long text
            done = [(np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done]), np.array([0, sum(len(x[0]) for x in done)]))]
        length, tokens, until = done[0]
        for i, a, b in zip(places, until[:-1].tolist(), until[1:].tolist(), strict=True):
            made[i] = (length[a:b], tokens[a:b])
    sizes, columns = [], [[], [], []]
    for length, tokens in made:
        at = np.arange(0, len(length), LEAF)
        sizes.append(len(at))
        if len(at):
            columns[0].append(np.add.reduceat(length, at))
            columns[1].append(np.add.reduceat(tokens, at))
            columns[2].append(np.minimum(LEAF, len(length) - at))
    flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()).cast(pa.int32()) for c in columns]
    struct = _ARROW_LEAVES.value_type
    values = pa.StructArray.from_arrays(flat, fields=[struct.field(i) for i in range(3)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values, type=_ARROW_LEAVES)


def edited(store: DataFrame, edits: str = "edits", text: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """The store after the edits: text and tree replaced, n_reencoded (pre-tokens encoded) appended, the
    edits left out; all other columns and all rows stay.

    ``edits``: array of (start, end, new): characters start..end-1 are replaced, one edit after the
    other, each counting on the text that the former leave. Null texts are empty, null edits none (then
    the row keeps its text), a null member is skipped, a null place is the start, a null replacement empty;
    places outside the text mean its ends.
    """
    shared = _shared(store, vocabulary)
    keep = [c for c in staying(store, [text, "tree", edits, "n_reencoded"])]
    schema = T.StructType([*[store.schema[c] for c in keep], T.StructField(text, T.StringType()), T.StructField("tree", LEAVES), T.StructField("n_reencoded", T.LongType())])

    def change(t: str, leaves: list, wanted: list | None) -> tuple:
        wanted = [e for e in wanted or () if e is not None]
        if not wanted:
            return t, leaves or [], 0
        tree = PieceTree(t or "", counter(shared.value), [(x["chars"], x["tokens"], x["pieces"]) for x in leaves or ()])
        for e in wanted:
            tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
        return tree.text(), _rows(tree), tree.encoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                made = [change(*x) for x in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)]
                columns = [pa.array(list(x), type=t) for x, t in zip(zip(*made, strict=True), (pa.string(), _ARROW_LEAVES, pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[3:], *columns], names=[*keep, text, "tree", "n_reencoded"])

    names = ["__text", "__tree", "__edits", *[f"c{i}" for i in range(len(keep))]]
    return store.select(store[text], store["tree"], store[edits], *[store[c] for c in keep]).toDF(*names).mapInArrow(run, schema)


def total(tree: str, what: str) -> "F.Column":
    """Sum of a stored tree's leaves: chars, tokens or pieces."""
    return F.expr(f"aggregate({tree}, 0L, (a, x) -> a + x.{what})")


def edited_counts(docs: DataFrame, edits: str = "edits", text: str = "text", *, vocabulary: str = VOCABULARY, digest: bool = False) -> DataFrame:
    """Append n_tokens, n_tokens_edited, n_pieces, n_reencoded (and edited_sha256) to every row.

    For a table that is edited once: its trees are made and edited in one pass and not kept. Edits and odd
    values as in ``edited``. Columns with the names of the appended ones are replaced.
    """
    appended = ["n_tokens", "n_tokens_edited", "n_pieces", "n_reencoded"] + ["edited_sha256"] * digest
    keep = staying(docs, appended)
    inner, at = numbered(docs)
    inner = inner.select(*[at(c) for c in keep], F.coalesce(at(text), F.lit("")).alias("text"), F.col(at(edits)).alias("edits"))
    store = trees(inner, vocabulary=vocabulary)
    store = store.withColumns({"n_tokens": total("tree", "tokens"), "n_pieces": total("tree", "pieces")})
    out = edited(store, vocabulary=vocabulary).withColumns({"n_tokens_edited": total("tree", "tokens"), "edited_sha256": F.sha2("text", 256)})
    return out.select(*[F.col(at(c)).alias(c) for c in keep], *appended)


#: The registered query's edits: a redaction at a quarter, a cut at half, a quotation at three quarters.
_EDITS = """array(
  named_struct('start', length(t) div 4, 'end', length(t) div 4 + 12, 'new', '[REDACTED]'),
  named_struct('start', length(t) div 2, 'end', length(t) div 2 + 40, 'new', ''),
  named_struct('start', 3 * length(t) div 4, 'end', 3 * length(t) div 4, 'new', concat(' "', substring(t, 1, 20), '"')))"""


def example_edits(text: str) -> "F.Column":
    return F.expr(_EDITS.replace("(t)", f"(coalesce(`{text}`, ''))").replace("(t,", f"(coalesce(`{text}`, ''),"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each, by the written store of their trees."""
    store = materialize(trees(table(spark, sf_dir, "documents").select("doc_id", "text")), "token-trees")
    store = store.withColumns({"n_tokens": total("tree", "tokens"), "n_pieces": total("tree", "pieces"), "edits": example_edits("text")})
    out = edited(store)
    return out.select("doc_id", "n_tokens", total("tree", "tokens").alias("n_tokens_edited"), "n_pieces", "n_reencoded", F.sha2(F.coalesce("text", F.lit("")), 256).alias("edited_sha256"))
