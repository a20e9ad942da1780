"""Pre-tokens of byte-level encodings, located by scans over arrays of code points.

Every code point has a class (letter, number, white space, other). With up to two code points of
lookahead it becomes a symbol, and a symbol is a function on the few states of the splitting pattern.
Composition of such functions is associative: the code points of a piece are cut into blocks, the
functions of all blocks are composed side by side, a doubling scan over the blocks gives the state in
front of each, and a last pass flags the code points that open a pre-token. No pattern is matched
against a text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import tiktoken

#: Code points that are split at once, and those of a block.
WINDOW, BLOCK = 1 << 20, 128
#: Classes of code points; GAP stands between the texts of a piece.
LETTER, NUMBER, OTHER, BLANK, SPACE, GAP = range(6)
#: Symbols: the first three classes, a space before a word, other white space before a word, white space before
#: white space, apostrophes that open a contraction of one or two letters, and the gap.
S_LETTER, S_NUMBER, S_OTHER, S_PREFIX, S_BLANK, S_RUN, S_SHORT, S_LONG, S_GAP = range(9)
#: States: what a code point continues, if it can.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_PREFIX, IN_RUN, LAST_OF_SHORT, FIRST_OF_LONG = range(8)
#: The letters of contractions (fixed values of the pattern).
SHORT, LONG = "stmd", ("re", "ve", "ll")
_GAP_CHAR = "\ud800"  # no text that was decoded holds a surrogate


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, opens a pre-token) by symbol and state."""
    after, opens = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_PREFIX: AFTER_PREFIX, S_BLANK: FREE, S_RUN: IN_RUN, S_SHORT: LAST_OF_SHORT, S_LONG: FIRST_OF_LONG, S_GAP: FREE}
    for symbol, state in run.items():
        after[symbol] = state

    def stays(symbol: int, states: dict[int, int]) -> None:
        for state, then in states.items():
            after[symbol, state], opens[symbol, state] = then, False

    stays(S_LETTER, {IN_LETTERS: IN_LETTERS, AFTER_PREFIX: IN_LETTERS, FIRST_OF_LONG: LAST_OF_SHORT, LAST_OF_SHORT: FREE})
    stays(S_NUMBER, {IN_NUMBERS: IN_NUMBERS, AFTER_PREFIX: IN_NUMBERS})
    for symbol in (S_OTHER, S_SHORT, S_LONG):
        stays(symbol, {IN_OTHERS: IN_OTHERS, AFTER_PREFIX: IN_OTHERS})
    stays(S_RUN, {IN_RUN: IN_RUN})
    return after, opens


AFTER, OPENS = _tables()


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by the character tables of the library that the ids must agree with."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        single = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[_points(bytes(single.encode_ordinary(every)).decode())] = kind
    out[0x20], out[ord(_GAP_CHAR)] = SPACE, GAP
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(points: np.ndarray) -> np.ndarray:
    kind = classes()[points]
    nxt = np.append(kind[1:], GAP)
    white, before_word = kind >= BLANK, nxt < BLANK
    out = np.where(white, np.where(before_word, np.where(kind == SPACE, S_PREFIX, S_BLANK), S_RUN), kind).astype(np.uint8)
    out[kind == GAP] = S_GAP
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        behind = np.append(points, np.zeros(2, np.uint32))
        a, b = behind[at + 1], behind[at + 2]
        out[at[np.isin(a, _points(SHORT))]] = S_SHORT
        for x, y in LONG:
            out[at[(a == ord(x)) & (b == ord(y))]] = S_LONG
    return out


def starts(points: np.ndarray) -> np.ndarray:
    """Places of the code points that open a pre-token (and of the gaps)."""
    n = len(points)
    blocks = -(-n // BLOCK)
    symbols = np.full(blocks * BLOCK, S_GAP, np.intp)
    symbols[:n] = _symbols(points)
    steps = np.ascontiguousarray(symbols.reshape(blocks, BLOCK).T) * 8
    after, opens = AFTER.ravel(), OPENS.ravel()
    # the function of every block, then of all up to it
    f = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in steps:
        f = after[row[:, None] + f]
    reach = 1
    while reach < blocks:
        f[reach:] = np.take_along_axis(f[reach:], f[:-reach], 1)
        reach *= 2
    state = np.append(np.uint8(FREE), f[:-1, FREE])
    flags = np.empty((BLOCK, blocks), bool)
    for k, row in enumerate(steps):
        at = row + state
        flags[k], state = opens[at], after[at]
    return np.flatnonzero(flags.T.ravel()[:n])


def _cuts(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """(part, places in it that open a pre-token) of a long text. A part ends where a pre-token does: at the last
    place that a window shows for certain, two code points before its end."""
    at, size = 0, WINDOW
    while at < len(text):
        window = text[at : at + size]
        found = starts(_points(window))
        if at + size < len(text):
            found = found[found <= len(window) - 3]
            if len(found) < 2:  # a pre-token longer than the window
                size *= 2
                continue
            window, found = window[: found[-1]], found[:-1]
        yield window, found
        at, size = at + len(window), WINDOW


def sliced(strings: list[str], found: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code points of every pre-token, its UTF-8 bytes, number of pre-tokens before each text and in all).

    found: the places that open pre-tokens, if they are known, of a single text.
    """
    points = _points(_GAP_CHAR.join(strings))
    if found is None:
        found = starts(points) if len(points) else np.zeros(0, np.int64)
    gap = points == ord(_GAP_CHAR)
    width = (~gap).view(np.uint8) + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
    width[gap] = 0
    offset = np.append(0, np.cumsum(width, dtype=np.int64))
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.cumsum(sizes + 1) - sizes - 1
    length = np.diff(found, append=len(points))
    inner = ~gap[found]
    found, length = found[inner], length[inner]
    data = "".join(strings).encode()
    slices = [data[a:b] for a, b in pairwise([*offset[found].tolist(), len(data)])]
    return length, slices, np.append(np.searchsorted(found, first), len(found))


def windows(strings: list[str]) -> Iterator[tuple[list[int], list[tuple[list[str], np.ndarray | None]]]]:
    """(places of texts, [(texts, where pre-tokens open)]): texts that fit into a window come together, a longer one
    by itself, in parts."""
    batch: list[int] = []
    room = WINDOW
    for i, s in enumerate(strings):
        if len(s) > room:
            if batch:
                yield batch, [([strings[k] for k in batch], None)]
            batch, room = [], WINDOW
        if len(s) > WINDOW:
            yield [i], [([part], found) for part, found in _cuts(s)]
        else:
            batch.append(i)
            room -= len(s) + 1
    if batch:
        yield batch, [([strings[k] for k in batch], None)]
