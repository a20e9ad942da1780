"""Exact substring dedup by prefix-free parsing.

Every place of a text starts a window of LENGTH bytes. The least rolling hash among a window's
GRAM-byte strings is its trigger, and neighbouring windows with one trigger form a phrase, so phrases
overlap by LENGTH - 1 bytes, every window lies in exactly one, and equal windows have equal triggers,
whatever stands around them. The texts stay in blocks of about BLOCK bytes, dealt once by a hash of
the id; between blocks and triggers only packed arrays travel:

1.  block -> trigger: the triggers of a block, each once;
2.  trigger -> block: those that another document has too. Phrases with any other trigger are done,
    which is most of the text;
3.  block -> trigger: the dictionary of the rest, each distinct phrase of the block once, with the
    least and largest id that hold it (the parse, as far as the order of documents needs it);
4.  trigger -> block: where a trigger has several phrases, a suffix array of them orders all their
    windows; each run of equal ones takes the least id of its phrases. Phrases come back as runs of
    windows with that id, if some document of the block comes later;
5.  in the block, windows whose id is less than the document's own are cut out of the text.

A trigger that stands in very many phrases (in a sentence that every document has, say) is hot: step 2
tells the blocks so, and its windows travel one by one, dealt by their own hash instead of the trigger's,
so that no group holds more than HOT phrases of a trigger. Runs of one trigger (in periodic text) are
cut into phrases of at most RUN windows.

The hashes have 64 bits (36 of them travel in steps 1 and 2, where a chance match costs a search only);
two windows are taken for equal only if trigger and bytes agree, those of hot triggers if trigger and a
second hash do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import table

LENGTH, GRAM = 50, 24
#: Bytes of text in a block, at first and at most, and in a piece of it that is parsed at once. Beyond
#: 64 GB of text blocks grow with its square root, so that the packed arrays between blocks stay long.
BLOCK, MOST, PIECE = 4 << 20, 32 << 20, 1 << 20
#: Phrases of a trigger that one group orders at most, and windows of a phrase.
HOT, RUN = 16384, 4096
#: Blocks, or as much of the triggers, in a partition, and partitions at most.
TOGETHER, PARTITIONS = 4, 1 << 15

_LOW = (1 << 36) - 1
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _rolling(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM values from each place, by joining neighbours of doubling length."""
    parts, done, h, n = [], 0, x, 1
    while True:
        if GRAM & n:
            parts.append((h, n))
            done += n
        if done == GRAM:
            break
        h = h[:-n] * np.uint64(0xD1342543DE82EF95 + 2 * n) + h[n:]
        h ^= h >> np.uint64(29)
        n *= 2
    size, at = len(x) - GRAM + 1, 0
    out = np.zeros(max(0, size), np.uint64)
    for h, n in reversed(parts):
        out = out * np.uint64(0xA0761D6478BD642F) + h[at : at + size]
        at += n
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xE7037ED1A0B428DB)
    return out ^ (out >> np.uint64(30))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value among the ``width`` values from each place."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


class Piece:
    """Some texts end to end, and their phrases: start, number of windows, trigger, text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.border = np.concatenate(([0], np.cumsum(size)))
        self.start = self.windows = self.doc = np.zeros(0, np.int64)
        self.trigger = np.zeros(0, np.uint64)
        if len(self.data) < LENGTH:
            return
        least = _least(_rolling(_BYTE[self.data]), LENGTH - GRAM + 1)
        n = len(least)
        doc = np.repeat(np.arange(len(texts)), size)[:n]
        inside = np.arange(LENGTH, n + LENGTH) <= self.border[doc + 1]
        first = np.ones(n, bool)
        first[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first &= inside
        # a phrase ends before the next one, or where its text's windows end
        self.start = np.flatnonzero(first)
        self.doc = doc[self.start]
        stop = np.append(self.start[1:], n)
        self.windows = np.minimum(stop, self.border[self.doc + 1] - LENGTH + 1) - self.start
        self.trigger = least[self.start]
        if len(self.windows) and self.windows.max() > RUN:
            parts = -(-self.windows // RUN)
            whole = np.repeat(np.arange(len(parts)), parts)
            skip = (np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
            self.start, self.doc, self.trigger = self.start[whole] + skip, self.doc[whole], self.trigger[whole]
            self.windows = np.minimum(RUN, self.windows[whole] - skip)

    def _sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomials of the bytes from a to b, moved to one place."""
        power, inverse = _powers(len(self.data) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * power[:-1], dtype=np.uint64)))
        return (total[b] - total[a]) * inverse[a]

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at the given places, other than those of phrases."""
        h = self._sums(at, at + LENGTH) + np.uint64(0x2545F4914F6CDD1D)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def fingerprints(self, some: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of the given phrases."""
        a, b = self.start[some], self.start[some] + self.windows[some] + LENGTH - 1
        h = self._sums(a, b) + (b - a).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _texts(group: pa.Table):
    """Pieces of a block's documents: (rows, ids, texts)."""
    ids = group.column("id").to_pylist()
    texts = group.column("text").to_pylist()
    part, size = [], 0
    for i in range(len(ids)):
        part.append(i)
        size += len(texts[i])
        if size >= PIECE:
            yield part, [ids[k] for k in part], [texts[k] for k in part]
            part, size = [], 0
    if part:
        yield part, [ids[k] for k in part], [texts[k] for k in part]


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _pack5(x: np.ndarray) -> bytes:
    """The low 40 bits of every value, five bytes each."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(data: list[bytes]) -> np.ndarray:
    b = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 5)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :5] = b
    return out.view(np.uint64).ravel()


def _short(trigger: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """36 bits of a trigger, and its bucket above them. Triggers of a bucket that agree in those bits
    are searched for needlessly, not taken for equal."""
    return ((trigger >> np.uint64(4)) & np.uint64(_LOW)) | (bucket.astype(np.uint64) << np.uint64(36))


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return start, np.append(start[1:], len(key))


def _bucket(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


ENTRY = "bucket long, block long, n long, entries binary"


def _rows(rows: list[tuple], names: str) -> pa.Table:
    columns = [x.split() for x in names.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    data = list(zip(*rows, strict=True)) if rows else [[]] * len(columns)
    return pa.table({n: pa.array(list(d), type=types[t]) for (n, t), d in zip(columns, data, strict=True)})


def _triggers(buckets: int):
    """Step 1: (bucket, block, triggers); the lowest bit says that two of the block's documents have it, the
    next three how many phrases of the block, as a power of eight."""

    def run(key, group):
        block = key[0].as_py()
        trigger, doc = [], []
        for _, ids, texts in _texts(group):
            p = Piece(texts)
            trigger.append(p.trigger)
            doc.append(np.array(ids, np.int64)[p.doc])
        trigger, doc = np.concatenate(trigger), np.concatenate(doc)
        order = np.argsort(trigger, kind="stable")
        trigger, doc = trigger[order] & ~np.uint64(15), doc[order]
        a, b = _cuts(trigger)
        if not len(a):
            return _rows([], "bucket long, block long, trigger binary")
        several = np.minimum.reduceat(doc, a) != np.maximum.reduceat(doc, a)
        bucket = _bucket(trigger[a], buckets)
        many = np.minimum(np.log2(b - a) / 3, 7).astype(np.uint64)
        entry = (trigger[a] & np.uint64(_LOW << 4)) | (many << np.uint64(1)) | several.astype(np.uint64)
        order = np.argsort(bucket, kind="stable")
        entry, bucket = entry[order], bucket[order]
        return _rows([(int(bucket[i]), block, _pack5(entry[i:j])) for i, j in zip(*_cuts(bucket), strict=True)], "bucket long, block long, trigger binary")

    return run


SHARED = "block long, bucket long, trigger binary"


def _shared(most: int):
    """Step 2: the triggers that another document has too, for every block; the low bit marks hot ones."""

    def run(key, group):
        bucket = key[0].as_py()
        packed = group.column("trigger").to_pylist()
        entry = _unpack5(packed)
        blocks = np.repeat(np.array(group.column("block").to_pylist(), np.int64), [len(x) // 5 for x in packed])
        order = np.argsort(entry, kind="stable")
        entry, blocks = entry[order], blocks[order]
        a, b = _cuts(entry >> np.uint64(4))
        if not len(a):
            return _rows([], SHARED)
        shared = (b - a > 1) | (np.bitwise_or.reduceat(entry & np.uint64(1), a) > 0)
        phrases = np.add.reduceat(np.int64(8) << (3 * ((entry >> np.uint64(1)) & np.uint64(7)).astype(np.int64)), a)
        keep = np.repeat(shared, b - a)
        entry = ((entry >> np.uint64(4)) << np.uint64(1)) | np.repeat(phrases >= most, b - a).astype(np.uint64)
        entry, blocks = entry[keep], blocks[keep]
        order = np.argsort(blocks, kind="stable")
        entry, blocks = entry[order], blocks[order]
        return _rows([(int(blocks[i]), bucket, _pack5(entry[i:j])) for i, j in zip(*_cuts(blocks), strict=True)], SHARED)

    return run


def _among(x: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted array, and where."""
    at = np.minimum(np.searchsorted(ordered, x), max(0, len(ordered) - 1))
    return (ordered[at] == x if len(ordered) else np.zeros(len(x), bool)), at


def _distinct(trigger: np.ndarray, window: np.ndarray, low: np.ndarray, high: np.ndarray | None = None):
    """Each window once, with the least and the largest id."""
    high = low if high is None else high
    order = np.lexsort((window, trigger))
    t, w = trigger[order], window[order]
    a = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (w[1:] != w[:-1]))))
    return t[a], w[a], np.minimum.reduceat(low[order], a), np.maximum.reduceat(high[order], a)


def _pack_entries(trigger, phrase, low, high, texts: list[bytes]) -> bytes:
    """Phrases of a block: ids as places in a list of them, everything but the hashes compressed."""
    ids, at = np.unique(np.concatenate((low, high)), return_inverse=True)
    size = np.array([len(t) for t in texts], np.int32)
    rest = b"".join((np.int32(len(ids)).tobytes(), _pack(ids), _pack(at.astype(np.int32)), _pack(size), b"".join(texts)))
    return _pack(trigger) + _pack(phrase) + zstandard.ZstdCompressor(level=3).compress(rest)


def _unpack_entries(n: int, data: bytes):
    trigger, phrase = np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64, n, 8 * n)
    rest = zstandard.ZstdDecompressor().decompress(data[16 * n :])
    k = int(np.frombuffer(rest, np.int32, 1)[0])
    ids, at = np.frombuffer(rest, np.int64, k, 4), np.frombuffer(rest, np.int32, 2 * n, 4 + 8 * k)
    size = np.frombuffer(rest, np.int32, n, 4 + 8 * k + 8 * n)
    return trigger, phrase, ids[at[:n]], ids[at[n:]], size, rest[4 + 8 * k + 12 * n :]


def _dictionary(buckets: int):
    """Step 3: distinct phrases of a block whose trigger is shared."""

    def run(key, docs, replies):
        if not docs.num_rows or not replies.num_rows:
            return _rows([], ENTRY)
        block = key[0].as_py()
        packed = replies.column("trigger").to_pylist()
        of = np.repeat(np.array(replies.column("bucket").to_pylist(), np.int64), [len(x) // 5 for x in packed])
        reply = _unpack5(packed)
        shared = _short((reply >> np.uint64(1)) << np.uint64(4), of)
        order = np.argsort(shared, kind="stable")
        shared, hot = shared[order], (reply[order] & np.uint64(1)) > 0
        got: list[list] = [[], [], [], [], []]
        single: list[list] = [[], [], [], []]  # windows of hot triggers: trigger, hash, least and largest id
        for _, ids, texts in _texts(docs):
            p = Piece(texts)
            hit, at = _among(_short(p.trigger, _bucket(p.trigger, buckets)), shared)
            key_of = np.array(ids, np.int64)
            if len(some := np.flatnonzero(hit & hot[at])):
                starts = _expand(p.start[some], p.windows[some])
                of_phrase = np.repeat(some, p.windows[some])
                for x, y in zip(single, _distinct(p.trigger[of_phrase], p.window_hashes(starts), key_of[p.doc[of_phrase]]), strict=True):
                    x.append(y)
            some = np.flatnonzero(hit & ~hot[at])
            if not len(some):
                continue
            phrase, doc = p.fingerprints(some), key_of[p.doc[some]]
            order = np.argsort(phrase, kind="stable")
            a, _ = _cuts(phrase[order])
            low, high = np.minimum.reduceat(doc[order], a), np.maximum.reduceat(doc[order], a)
            one = some[order[a]]
            data = p.data.tobytes()
            text = [data[s : s + n] for s, n in zip(p.start[one].tolist(), (p.windows[one] + LENGTH - 1).tolist(), strict=True)]
            for x, y in zip(got, (p.trigger[one], phrase[order[a]], low, high, text), strict=True):
                x.append(y)
        rows = []
        if single[0]:
            trigger, window, low, high = map(np.concatenate, single)
            trigger, window, low, high = _distinct(trigger, window, low, high)
            bucket = _bucket(window, buckets)
            order = np.argsort(bucket, kind="stable")
            for i, j in zip(*_cuts(bucket[order]), strict=True):
                k = order[i:j]
                rows.append((int(bucket[k[0]]), block, len(k), _pack_entries(trigger[k], window[k], low[k], high[k], [b""] * len(k))))
        if not got[0]:
            return _rows(rows, ENTRY)
        trigger, phrase, low, high = map(np.concatenate, got[:4])
        text = [t for part in got[4] for t in part]
        order = np.argsort(phrase, kind="stable")
        a, _ = _cuts(phrase[order])
        low, high = np.minimum.reduceat(low[order], a), np.maximum.reduceat(high[order], a)
        one = order[a]
        trigger, phrase = trigger[one], phrase[one]
        bucket = _bucket(trigger, buckets)
        order = np.argsort(bucket, kind="stable")
        for i, j in zip(*_cuts(bucket[order]), strict=True):
            k = order[i:j]
            rows.append((int(bucket[k[0]]), block, len(k), _pack_entries(trigger[k], phrase[k], low[k], high[k], [text[one[x]] for x in k])))
        return _rows(rows, ENTRY)

    return run


def window_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rank of the LENGTH bytes at each start, equal for equal bytes, in the order of a suffix array.

    Prefix doubling from 8 bytes, which a word holds, over all places; the last step joins two
    overlapping parts for the wanted places only.
    """
    n = len(data)
    x = np.zeros(n, np.uint64)
    for k in range(8):
        x[: n - k] = (x[: n - k] << np.uint64(8)) | data[k:]
        if k:
            x[n - k :] <<= np.uint64(8)
    rank, length = np.unique(x, return_inverse=True)[1].astype(np.int64), 8
    while 2 * length < LENGTH:
        after = np.full(n, -1, np.int64)
        after[: n - length] = rank[length:]
        rank, length = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64), 2 * length
    return np.unique(rank[starts] * (n + 1) + rank[starts + LENGTH - length], return_inverse=True)[1]


RUNS = "block long, phrase binary, runs binary, windows binary, first binary, hot binary"


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _order(key, group):
    """Step 4: for the phrases of each block, runs of windows with the least id that has them."""
    counts = group.column("n").to_pylist()
    parts = [_unpack_entries(n, x) for n, x in zip(counts, group.column("entries").to_pylist(), strict=True)]
    trigger, phrase, low, high, size = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:5])
    size = size.astype(np.int64)
    data = np.frombuffer(b"".join(x[5] for x in parts), np.uint8)
    block = np.repeat(np.array(group.column("block").to_pylist(), np.int64), counts)
    del parts
    rows = []
    if len(single := np.flatnonzero(size == 0)):
        # windows of hot triggers: those that come before one of the block's documents, each a run of its own
        t, w = trigger[single], phrase[single]
        order = np.lexsort((w, t))
        a = np.flatnonzero(np.concatenate(([True], (t[order][1:] != t[order][:-1]) | (w[order][1:] != w[order][:-1]))))
        least = np.empty(len(single), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(low[single][order], a), np.diff(np.append(a, len(single))))
        ahead = np.flatnonzero(least < high[single])
        ahead = ahead[np.argsort(block[single][ahead], kind="stable")]
        for i, j in zip(*_cuts(block[single][ahead]), strict=True):
            k = ahead[i:j]
            k = k[np.argsort(w[k], kind="stable")]
            one = np.ones(len(k), np.int32)
            rows.append((int(block[single][k[0]]), _pack(w[k]), _pack(one), _pack(one), _pack(least[k]), _pack(np.unique(t[k]))))
        rest = np.flatnonzero(size)
        if not len(rest):
            return _rows(rows, RUNS)
        trigger, phrase, low, high, size, block = (x[rest] for x in (trigger, phrase, low, high, size, block))
    offset = np.cumsum(size) - size
    order = np.lexsort((phrase, trigger))
    # distinct phrases: trigger, least id, place of their bytes
    a, b = _cuts(phrase[order])
    least = np.minimum.reduceat(low[order], a)
    one = order[a]
    t, n_windows = trigger[one], size[one] - LENGTH + 1
    owner = np.empty(len(order), np.int64)
    owner[order] = np.repeat(np.arange(len(a)), b - a)
    ta, tb = _cuts(t)
    several = np.repeat(tb - ta > 1, tb - ta)
    first = np.cumsum(n_windows) - n_windows
    value = np.repeat(least, n_windows)  # of every window of every distinct phrase
    some = np.flatnonzero(several)
    if len(some):
        # their bytes end to end; windows never cross the seams
        length = size[one[some]]
        text = data[_expand(offset[one[some]], length)]
        at = _expand(np.cumsum(length) - length, n_windows[some])
        rank = window_ranks(text, at)
        where = _expand(first[some], n_windows[some])
        lows = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lows, rank, value[where])
        value[where] = lows[rank]
    # back to the blocks: phrases with a window that comes before one of the block's documents
    ahead = np.minimum.reduceat(value, first)
    wanted = np.flatnonzero(ahead[owner] < high)
    if not len(wanted):
        return _rows(rows, RUNS)
    wanted = wanted[np.argsort(block[wanted], kind="stable")]
    edge = np.ones(len(value), bool)
    edge[1:] = value[1:] != value[:-1]
    edge[first] = True
    run_start = np.flatnonzero(edge)
    run_size = np.diff(np.append(run_start, len(value)))
    run_of = np.searchsorted(run_start, first)
    runs = np.diff(np.append(run_of, len(run_start)))
    for i, j in zip(*_cuts(block[wanted]), strict=True):
        k = wanted[i:j]
        k = k[np.argsort(phrase[k], kind="stable")]
        r = _expand(run_of[owner[k]], runs[owner[k]])
        rows.append((int(block[k[0]]), _pack(phrase[k]), _pack(runs[owner[k]].astype(np.int32)), _pack(run_size[r].astype(np.int32)), _pack(value[run_start[r]]), b""))
    return _rows(rows, RUNS)


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_text: bool):
    """Step 5: cut the windows that an earlier document has."""

    def run(key, docs, replies):
        names = RESULT + ", kept binary" * keep_text
        if not docs.num_rows:
            return _rows([], names)
        col = lambda name, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in replies.column(name).to_pylist()]])
        phrase, runs, windows, value = col("phrase", np.uint64), col("runs", np.int32).astype(np.int64), col("windows", np.int32).astype(np.int64), col("first", np.int64)
        run_of = np.cumsum(runs) - runs
        order = np.argsort(phrase, kind="stable")
        ordered = phrase[order]
        shift = np.cumsum(windows) - windows
        hot = np.unique(col("hot", np.uint64))
        rows = []
        for _, ids, texts in _texts(docs):
            p = Piece(texts)
            diff = np.zeros(len(p.data) + 1, np.int32)
            if len(p.start) and len(phrase):
                hit, at = _among(p.fingerprints(np.arange(len(p.start))), ordered)
                some, which = np.flatnonzero(hit), order[at[hit]]
                r = _expand(run_of[which], runs[which])
                occurrence = np.repeat(some, runs[which])
                start = p.start[occurrence] + shift[r] - np.repeat(shift[run_of[which]], runs[which])
                cut = value[r] < np.array(ids, np.int64)[p.doc[occurrence]]
                np.add.at(diff, start[cut], 1)
                np.add.at(diff, (start + windows[r] + LENGTH - 1)[cut], -1)
                if len(some := np.flatnonzero(_among(p.trigger, hot)[0])):
                    start = _expand(p.start[some], p.windows[some])
                    hit, at = _among(p.window_hashes(start), ordered)
                    start, doc_of = start[hit], np.repeat(p.doc[some], p.windows[some])[hit]
                    cut = value[run_of[order[at[hit]]]] < np.array(ids, np.int64)[doc_of]
                    np.add.at(diff, start[cut], 1)
                    np.add.at(diff, start[cut] + LENGTH, -1)
            gone = np.cumsum(diff[:-1]) > 0
            for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                mask = gone[p.border[i] : p.border[i + 1]]
                removed = int(mask.sum())
                spans, kept = 0, text
                if removed:
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = p.data[p.border[i] : p.border[i + 1]][~mask].tobytes()
                rows.append((doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
        return _rows(rows, names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, keep_text: bool = False, block: int | None = None, hot: int = HOT) -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every input row.

    A byte goes if a window of LENGTH bytes over it also starts in a document with a smaller key. A
    null text is empty; a null key counts as larger than any other and comes back as null. Rows that
    share a key do not count as earlier than each other. Texts below LENGTH bytes stay whole; a very long
    one is parsed in one piece. Keys are integers: others are cast, and raise or become null as the session
    says. An empty table gives an empty result. ``kept``: the bytes left (a cut may split a character).
    """
    base = docs.select(
        F.coalesce(docs[key].cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("text"),
    )
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    block = block or min(MOST, max(BLOCK, int(BLOCK * (total / (64 << 30)) ** 0.5)))
    blocks = max(1, -(-total // block))
    # partitions grow with the text, whatever the session's number of them; groups in one stream past each other
    deal = lambda df, by: df.repartition(min(-(-blocks // TOGETHER), PARTITIONS), by).groupBy(by)
    # by id and text, so that rows of one key, or without any, are dealt as others are
    base = base.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"), "id", "text")
    by_block = deal(base, "block")
    entries = by_block.applyInArrow(_triggers(blocks), "bucket long, block long, trigger binary")
    shared = deal(entries, "bucket").applyInArrow(_shared(hot), SHARED)
    phrases = by_block.cogroup(deal(shared, "block")).applyInArrow(_dictionary(blocks), ENTRY)
    runs = deal(phrases, "bucket").applyInArrow(_order, RUNS)
    out = by_block.cogroup(deal(runs, "block")).applyInArrow(_cut(keep_text), RESULT + ", kept binary" * keep_text)
    return out.withColumn("id", F.when(F.col("id") < (1 << 63) - 1, F.col("id"))).withColumnRenamed("id", key)


def op5_pfp_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of earlier documents leave of every document."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS p FROM d)),
c AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS m FROM w) WHERE m < doc_id),
s AS (SELECT doc_id, p, lag(p) OVER o AS before FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR before + {LENGTH} < p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM s),
spans AS (SELECT doc_id, n, min(p) AS a, max(p) + {LENGTH} AS b FROM g GROUP BY doc_id, n),
cut AS (SELECT doc_id, n, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY n), 0) AS from_ FROM spans),
r AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY n) AS head
      FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(r.n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
