"""Summaries of all rows of bounded size: counters of hashed items and bit sets, added up over the partitions.

Exact counters have a constant size (8 MB). ``levels`` is sized to the input up to 2**25 counters of a byte (32 MB), and
bit sets take 32 MB at most, so that all of them may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.shingles import FEW, U, slices
from gaugeframe.sources.scratch import freed

COUNTERS = 1 << 20
PIECES = 16


def counts(df: DataFrame, items: Callable[[pa.RecordBatch], np.ndarray], counters: int = COUNTERS) -> np.ndarray:
    """How often each hashed item modulo ``counters`` occurs in all rows (uint64)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for b in slices(batches):
            total += np.bincount((items(b) % np.uint64(counters)).astype(np.int64), minlength=counters)
        if total.any():
            yield _pieces(total.astype(np.uint64))

    return _sum(df.mapInArrow(part, "piece int, data binary"), np.uint64, lambda a, b: a + b)


class Levels(NamedTuple):
    """Upper bounds for how often items occur, in steps of an eighth of a power of 2."""

    level: np.ndarray  #: uint8; 0: once at most
    total: int  #: occurrences of all items

    def of(self, items: np.ndarray) -> np.ndarray:
        return self.level[(items % U(len(self.level))).astype(np.int64)] if len(self.level) else np.zeros(len(items), np.uint8)

    def often(self, level: np.ndarray) -> np.ndarray:
        """Estimated occurrences: what a counter holds beyond the average share that other items have in it."""
        return np.maximum(1, np.exp2(level / 8) - self.total / max(1, len(self.level)))


def levels(df: DataFrame, items: Callable[[pa.RecordBatch], np.ndarray], expected: int) -> Levels:
    """Counters for about ``expected`` different hashed items, at least 2**16 and at most 2**25. Partitions send what is
    not zero; each range of 2**16 counters is added up in a task of its own or with others, and only bytes come here."""
    size = 1 << min(25, max(16, (int(expected) - 1).bit_length()))
    ranges = size >> 16

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, np.uint32), 0
        for b in slices(batches, FEW):
            every = items(b) % U(size)
            seen += len(every)
            if seen < 2**32:  # no counter can be full yet
                np.add.at(total, every.astype(np.int64), np.uint32(1))
                continue
            at, n = np.unique(every, return_counts=True)
            at = at.astype(np.int64)
            total[at] += np.minimum(n, 2**32 - 1 - total[at]).astype(np.uint32)  # a partition's counter stays at the most
        at = np.flatnonzero(total)
        edge = np.searchsorted(at, np.arange(ranges + 1) << 16)
        some = np.flatnonzero(np.diff(edge))
        if len(some):
            blobs = [(at[i:j] & 0xFFFF).astype(np.uint16).tobytes() + total[at[i:j]].tobytes() for i, j in zip(edge[some], edge[some + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["piece", "data"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                buf = x.as_buffer()
                n = len(buf) // 6
                total = got.setdefault(k, np.zeros(1 << 16, np.uint64))
                total[np.frombuffer(buf, np.uint16, n)] += np.frombuffer(buf[2 * n :].to_pybytes(), np.uint32)
        for k, x in got.items():
            level = np.minimum(255, np.ceil(8 * np.log2(np.maximum(x, 1))))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.astype(np.uint8).tobytes()], pa.binary()), pa.array([int(x.sum())], pa.int64())], ["piece", "data", "total"])

    with freed(df.sparkSession):
        rows = df.mapInArrow(part, "piece int, data binary").repartitionById(min(ranges, 64), F.col("piece") % min(ranges, 64)).mapInArrow(fold, "piece int, data binary, total bigint").collect()
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r.piece << 16 : (r.piece + 1) << 16] = np.frombuffer(r.data, np.uint8)
    return Levels(out, sum(r.total for r in rows))


def bits(df: DataFrame, items: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """A bit set (uint8) of ``size`` bits, a power of 2, with the bit of each hashed item modulo ``size``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // 8, np.uint8)
        for b in slices(batches):
            at = np.unique(items(b) % U(size)).astype(np.int64)
            if len(at):
                byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
                first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
                total[byte[first]] |= np.bitwise_or.reduceat(bit, first)
        if total.any():
            yield _pieces(total)

    out = _sum(df.mapInArrow(part, "piece int, data binary"), np.uint8, lambda a, b: a | b)
    return out if len(out) else np.zeros(size // 8, np.uint8)


def size_for(n: int, per_item: int = 16) -> int:
    """Bits for n items, between 2**13 and 2**28 (32 MB)."""
    return 1 << min(28, max(13, int(n * per_item).bit_length()))


def has(found: np.ndarray, items: np.ndarray) -> np.ndarray:
    at = items % np.uint64(8 * len(found))
    return (found[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pieces(a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in np.split(a, PIECES)], pa.binary())], ["piece", "data"])


def _sum(df: DataFrame, kind: type, add: Callable) -> np.ndarray:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                a = np.frombuffer(x.as_buffer(), kind)
                got[k] = add(got[k], a) if k in got else a
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v.tobytes() for v in got.values()], pa.binary())], ["piece", "data"])

    with freed(df.sparkSession):
        rows = df.repartitionById(PIECES, F.col("piece")).mapInArrow(fold, "piece int, data binary").collect()
    return np.concatenate([np.frombuffer(r.data, kind) for r in sorted(rows, key=lambda r: r.piece)]) if rows else np.zeros(0, kind)
