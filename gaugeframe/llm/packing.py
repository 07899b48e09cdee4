"""Problem 7: items in containers of fixed capacity, with as few containers and as little unused space as possible.

Method: non-negative least squares. Items larger than the capacity are cut into full containers and a rest. Shallow
combinations of lengths (up to three different ones, with repeats) that fill the capacity up to a small window are
enumerated; their repeat counts are solved against the histogram of lengths, weighted by length, by accelerated
projected gradients and rounded down. What that leaves is solved again as long as half of it finds a place, at most
``SOLVES`` times; then the rest is packed greedily, largest first into the fullest container that has room, equal items
into equal containers at once.

Only the histogram (as many rows as the capacity, at most) and the plan (runs of equal items in consecutive containers)
are on the driver. Neither grows with the number of items, but for its logarithm: a run of the greedy part ends with a
size or with a group of equal containers, whatever the number of items in it. Items learn their rank among those of their size from counts by partition, never from a sort of one
size in one task.

Cases: null and empty texts are in no container (their size is 0 tokens); blank texts are packed; a repeated row is an
item of its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import Saved

COLUMNS = 20_000
LARGEST = 1 << 20  # of a capacity: bounds the histogram
ROUNDS = 400
SOLVES = 8


class Plan(NamedTuple):
    """Runs: items first .. first + count - 1 of a size go to the containers from ``container`` on, ``each`` to one."""

    size: np.ndarray
    first: np.ndarray
    count: np.ndarray
    container: np.ndarray
    each: np.ndarray
    containers: int


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, window: int, columns: int = COLUMNS) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((index of a size, repeats), ...) that fill the capacity up to ``window``; at most ``columns``."""
    out: dict[tuple[tuple[int, int], ...], None] = {}

    def fit(room: int) -> int:
        return int(np.searchsorted(sizes, room, side="right")) - 1

    def add(*parts: tuple[int, int]) -> None:
        total: dict[int, int] = {}
        for k, n in parts:
            if n:
                total[k] = total.get(k, 0) + n
        if capacity - sum(int(sizes[k]) * n for k, n in total.items()) <= window and all(counts[k] >= n for k, n in total.items()):
            out.setdefault(tuple(sorted(total.items())))

    some = np.unique(np.linspace(0, len(sizes) - 1, min(len(sizes), 24)).astype(int))
    for a in range(len(sizes) - 1, -1, -1):
        most = int(min(capacity // sizes[a], counts[a]))
        for i in sorted({1, 2, 3, most // 2, most - 1, most} - {0}):
            if i < 1 or i > most:
                continue
            room = capacity - i * int(sizes[a])
            add((a, i))
            for j in (1, 2, 3, 4, 6, 8, 16, 32):
                b = fit(room // j)
                if b >= 0:
                    add((a, i), (b, j))
                    left = room - j * int(sizes[b])
                    if (c := fit(left)) >= 0:
                        add((a, i), (b, j), (c, 1))
            for b in some:
                if sizes[b] <= room and (c := fit(room - int(sizes[b]))) >= 0:
                    add((a, i), (int(b), 1), (c, 1))
    every = list(out)
    return every if len(every) <= columns else [every[i] for i in np.linspace(0, len(every) - 1, columns).astype(int)]


def least_squares(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, target: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with least |A x - target|, A sparse; accelerated projected gradients."""
    x = y = np.zeros(n)
    v = np.ones(n)
    for _ in range(30):
        v = np.bincount(cols, value * np.bincount(rows, value * v[cols], len(target))[rows], n)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    step, t = 1 / max(norm * 1.05, 1e-12), 1.0
    for _ in range(rounds):
        r = np.bincount(rows, value * y[cols], len(target)) - target
        z = np.maximum(y - step * np.bincount(cols, value * r[rows], n), 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / u * (z - x), z, u
    return x


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """sizes ascending, 1 .. capacity, with how many items have each."""
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    box = 0

    def put(parts: tuple[tuple[int, int], ...], times: int) -> None:
        nonlocal box
        for k, n in parts:
            runs.append((int(sizes[k]), int(used[k]), n * times, box, n))
            used[k] += n * times
            left[k] -= n * times
        box += times

    full = np.flatnonzero(sizes == capacity)
    if len(full) and left[full[0]]:
        put(((int(full[0]), 1),), int(left[full[0]]))
    for _ in range(SOLVES):  # what rounding and an unfinished fit leave is solved again
        before = int(left.sum())
        every = patterns(sizes, left, capacity, max(1, capacity // 128)) if before else []
        if not every:
            break
        rows = np.array([k for p in every for k, _ in p])
        cols = np.repeat(np.arange(len(every)), [len(p) for p in every])
        value = np.array([n * sizes[k] for p in every for k, n in p], float) / capacity
        x = least_squares(rows, cols, value, left * sizes / capacity, len(every))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            times = int(min(max(1, np.floor(x[i])), min(left[k] // n for k, n in every[i])))
            if times:
                put(every[i], times)
        if left.sum() > 0.5 * before:
            break
    # the rest, largest first, each into the fullest container with room; equal items and containers in runs
    open_at: dict[int, list[tuple[int, int]]] = {}  # room -> (first container, how many)
    free = 0  # bit s is set if a container has room s
    for k in range(len(sizes) - 1, -1, -1):
        s = int(sizes[k])
        while (items := int(left[k])) > 0:
            fitting = free >> s
            if fitting:
                room = s + (fitting & -fitting).bit_length() - 1
                at, boxes = open_at[room].pop()
                if not open_at[room]:
                    free &= ~(1 << room)
            else:
                room, at = capacity, box
                boxes = -(-items // (capacity // s))
                box += boxes
            each = room // s
            n = min(items, boxes * each)
            runs.append((s, int(used[k]), n, at, each))
            used[k] += n
            left[k] -= n
            whole, rest = divmod(n, each)
            for rest_room, first, many in ((room - each * s, at, whole), (room - rest * s, at + whole, int(rest > 0)), (room, at + whole + int(rest > 0), boxes - whole - int(rest > 0))):
                if rest_room and many:
                    open_at.setdefault(rest_room, []).append((first, many))
                    free |= 1 << rest_room
    a = np.array(runs, np.int64).reshape(-1, 5)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return Plan(*a.T, box)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece int, start bigint, size bigint, container bigint): every item of 1 or more, in containers 0, 1, ..."""
    if not 0 < capacity <= LARGEST:
        raise ValueError(f"a capacity of {capacity} is not between 1 and {LARGEST}")
    size = F.col("size")
    cut = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(size_col).cast("bigint").alias("size")).filter("size > 0")
    pieces = cut.select("id", size.alias("whole"), F.explode(F.sequence(F.lit(0), F.ceil(size / capacity).cast("int") - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    pieces = pieces.select("id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("whole") - start).alias("size"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        name = TaskContext.get().partitionId()
        for b in batches:
            s = b.column(3).to_numpy()
            order = np.argsort(s, kind="stable")
            first = np.flatnonzero(np.r_[True, s[order][1:] != s[order][:-1]]) if len(s) else np.zeros(0, np.int64)
            rank = np.empty(len(s), np.int64)
            rank[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
            rank += seen[s]
            seen += np.bincount(s, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name] * len(s), pa.int32()), pa.array(rank)], ["id", "piece", "start", "size", "part", "rank"])

    schema = "id bigint, piece int, start bigint, size bigint, part int, rank bigint"
    rows = Saved(pieces.mapInArrow(ranked, schema)).df
    counts = rows.groupBy("size", "part").agg(F.count("*").alias("n"))
    counts = Saved(counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n"))).df
    hist = counts.groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").collect()  # at most ``capacity`` rows
    plan = solve(np.array([r["size"] for r in hist], np.int64), np.array([r.n for r in hist], np.int64), capacity)
    shared = items.sparkSession.sparkContext.broadcast(plan)
    placed = rows.join(counts.select("size", "part", "before"), ["size", "part"]).select("id", "piece", "start", "size", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        key = (p.size << 40) | p.first
        for b in batches:
            s, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            at = np.searchsorted(key, (s << 40) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(p.container[at] + (rank - p.first[at]) // p.each[at])], ["id", "piece", "start", "size", "container"])

    return placed.mapInArrow(place, "id bigint, piece int, start bigint, size bigint, container bigint")
