"""Hidden Markov kernels over many chains at once: numpy arrays of (chain, block, source).

A chain costs time and memory in proportion to its blocks; all chains of a batch with as many blocks move
through a block together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def moves(q: np.ndarray, alpha: np.ndarray, simple: bool) -> np.ndarray:
    """(chain, to, from): log of moving between sources."""
    stay = np.exp(-alpha)[:, None, None]
    same = np.eye(q.shape[1], dtype=bool)[None]
    with np.errstate(divide="ignore"):
        if simple:
            return np.where(same, -alpha[:, None, None], np.log((1 - stay) * q[:, :, None]))
        return np.log((1 - stay) * q[:, :, None] + np.where(same, stay, 0.0))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def best_paths(e: np.ndarray, q: np.ndarray, alpha: np.ndarray, simple: bool) -> np.ndarray:
    """The most likely source of every block; the lowest of equals."""
    t, (n, blocks, k) = moves(q, alpha, simple), e.shape
    back = np.zeros((n, blocks, k), np.int16)
    a = e[:, 0] + np.log(q)
    for b in range(1, blocks):
        s = a[:, None, :] + t
        back[:, b] = s.argmax(2)
        a = s.max(2) + e[:, b]
    path = np.zeros((n, blocks), np.int64)
    path[:, -1] = a.argmax(1)
    rows = np.arange(n)
    for b in range(blocks - 1, 0, -1):
        path[:, b - 1] = back[rows, b, path[:, b]]
    return path


def forward(e: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.empty_like(e)
    out[:, 0] = e[:, 0] + np.log(q)
    for b in range(1, e.shape[1]):
        out[:, b] = _lse(out[:, b - 1][:, None, :] + t, 2) + e[:, b]
    return out


def likelihoods(e: np.ndarray, q: np.ndarray, alpha: np.ndarray, simple: bool) -> np.ndarray:
    return _lse(forward(e, q, moves(q, alpha, simple))[:, -1], 1)


def posteriors(e: np.ndarray, q: np.ndarray, alpha: np.ndarray, simple: bool) -> np.ndarray:
    t = moves(q, alpha, simple)
    f = forward(e, q, t)
    total = _lse(f[:, -1], 1)[:, None]
    after = np.zeros_like(f[:, 0])
    for b in range(e.shape[1] - 1, -1, -1):
        if b < e.shape[1] - 1:
            after = _lse(t + e[:, b + 1][:, :, None] + after[:, :, None], 1)
        f[:, b] = np.exp(f[:, b] + after - total)
    return f


def over_batches(kernel: Callable, name: str, type_: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (chrom, hap, alpha, q, e) in; (chrom, hap, alpha, name) with the kernel's list or number out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.array(batch.column("q").to_pylist(), float)
            size = np.diff(batch.column("e").offsets.to_numpy())
            values = batch.column("e").flatten().flatten().to_numpy().reshape(-1, q.shape[1])
            start, alpha = np.cumsum(size) - size, batch.column("alpha").to_numpy()
            for blocks in np.unique(size):
                some = np.flatnonzero(size == blocks)
                e = values[(start[some][:, None] + np.arange(blocks)).ravel()].reshape(len(some), blocks, -1)
                made = pa.array(kernel(e, q[some], alpha[some]).tolist(), type=type_)
                keep = batch.select(["chrom", "hap", "alpha"]).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*keep.columns, made], names=["chrom", "hap", "alpha", name])

    return run
