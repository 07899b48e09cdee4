"""Candidate pairs from an inverted index, compared tile by tile, with exclusive-or and bit counts.

Every text is known by the 64-bit hash of its set of triples (*class*: copies are one class, whatever their number). A
set is a bit vector over all triples, whose population count n is the size of the set. Three facts lose no pair:

* If two sets are similar enough, they share one of the *rarest* keys of each (prefix filter); any fixed
  order of keys will do, so rarity may come from counters of bounded size. A key that occurs once has no partner.
* A key that stands at place i in this order has n - i keys from there on, which bounds the population count of a partner
  with which it is the first key in common (``reach``).
* The bit vectors folded to 256 bits differ in no more bits than the sets in triples, so differing bits beyond the radius
  that the threshold allows rule a pair out (``alike``).

``emit`` packs the entries (key, class, n, reach: 16 bytes) of many texts into one binary row for each bucket, so the JVM
moves a few blobs instead of tens of millions of rows; an entry takes the same room whatever the number of buckets.
``compare`` and ``compare_apart`` sort a bucket by key and population count, and of each key look only at the tile of
partners whose population counts lie within reach. Pairs within reach grow faster than the input, so entries may bring
their folded bit vectors (32 bytes more): then a pair is weighed where it meets and what is ruled out is never written.
Such entries are made in ``turns``, a share of the buckets at a time. ``compare_apart`` takes bits of the keys ``after`` an
entry's own instead: few are left after frequent keys, where most pairs meet by chance. ``alike`` fetches the bit vectors
for pairs of entries without them.

A key so frequent that its list would not fit one task is split into a grid of cells (``LIST`` entries a side), each a
list of its own; no list is cut. How frequent a key is, is its counter less the average share of other keys in it, so
crowded counters don't make all keys frequent.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import sketches
from gaugeframe.llm.shingles import FEW, U, mix, slices
from gaugeframe.sources.scratch import Saved

BITS = 256  # of a folded bit vector
AFTER = 192  # of a bit vector of the keys after an entry's own
TILE = 1 << 20  # pairs compared at once
APART = 1 << 16  # the same where few pairs are left, which stay in the processor's cache
HELD = 1 << 20  # entries or pairs that a task holds before it hands them on
LIST = 1 << 16  # entries of a key in a list
PER_BUCKET = 2_000_000  # entries in a bucket, about
KEPT = 64 << 20  # bytes of pairs that a task keeps in memory before they go to a file of its own
COUNTED = 1 << 22  # pairs that are counted at once
MOST = (1 << 16) - 1  # of population counts and reaches that are stored; larger ones count as this, which loses nothing


class Entries(NamedTuple):
    """Of a batch, by entry: class (uint64; its lowest bit is the side, 0 or 1), key, population count, reach, and estimated
    occurrences of the key in all rows."""

    cls: np.ndarray
    key: np.ndarray
    n: np.ndarray
    reach: np.ndarray
    often: np.ndarray
    fold: np.ndarray | None = None  #: bit vectors (bytes or uint64, by entry), for pairs that are weighed in their bucket

    def take(self, at: np.ndarray) -> Entries:
        return Entries(*(x if x is None else x[at] for x in self))

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(*(None if x[0] is None else np.concatenate(x) for x in zip(*parts)))


def folded(doc: np.ndarray, items: np.ndarray, docs: int) -> np.ndarray:
    """uint8 [docs, BITS / 8]: bit h(t) is set for each item t."""
    on = np.zeros((docs, BITS), np.uint8)
    on[doc, (mix(items + U(0xABCDEF)) % U(BITS)).astype(np.int64)] = 1
    return np.packbits(on, axis=1)


def after(items: np.ndarray, size: np.ndarray, of: np.ndarray | None = None, bits: int = AFTER) -> np.ndarray:
    """uint64 [items, bits / 64]: of docs that have so many items, one doc after another, bits of the items that come after
    each item in its doc; ``of`` gives the places of the items for which they are wanted."""
    by = np.argsort(-size, kind="stable")
    last = np.cumsum(size)[by] - 1
    docs = (len(size) - np.cumsum(np.bincount(size)))[:-1]  # by k, those that have a k-th item from the end
    # last items of all docs first, then those before them, and so on
    ends = np.cumsum(docs)
    at = last[np.arange(len(items)) - np.repeat(ends - docs, docs)] - np.repeat(np.arange(len(docs)), docs)
    bit = (mix(items + U(0xABCDEF)) % U(bits))[at]
    own = np.zeros((len(items), bits // 64), U)
    own.ravel()[np.arange(len(items)) * (bits // 64) + (bit >> U(6)).astype(np.int64)] = U(1) << (bit & U(63))
    out = np.zeros_like(own)
    for m, j, i in zip(docs[1:].tolist(), ends[1:].tolist(), (ends - docs).tolist()):
        np.bitwise_or(out[i : i + m], own[i : i + m], out=out[j - m : j])
    row = np.empty(len(items), np.int64)
    row[at] = np.arange(len(items))
    return out[row if of is None else row[of]]


def rarest(doc: np.ndarray, items: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts each doc's rarest items first, and each one's place in its doc. Items come ordered by doc and
    value, so that ties stay in order of the value."""
    order = np.argsort((doc.astype(np.int64) << 8) | level, kind="stable")
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return order, np.arange(len(doc)) - np.repeat(at, np.diff(np.r_[at, len(doc)]))


def similar_reach(n: np.ndarray, place: np.ndarray, least: float, matches: int = 1) -> np.ndarray:
    """The most triples that a partner of Jaccard similarity ``least`` may have if an item at this place is one of the
    first ``matches`` in common."""
    return np.floor((n - place + matches - 1) * (1 + least) / least - n + 1e-6).astype(np.int64)


def by_rarity(doc: np.ndarray, items: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The items (48 bits, ordered by doc) of each doc in the order of ``rarest``."""
    every = (((doc & 255) << 56) | (level.astype(np.int64) << 48)).astype(U) | items
    edge = np.searchsorted(doc, np.arange(0, (doc[-1] if len(doc) else 0) + 257, 256))
    for i, j in zip(edge[:-1], edge[1:]):
        every[i:j].sort()
    return every & U((1 << 48) - 1)


def prefix(n: np.ndarray, place: np.ndarray, least: float, matches: int = 1) -> np.ndarray:
    """Whether an item is among those of which a partner that has ``least`` of the set must have ``matches``."""
    return place < n - np.ceil(least * n - 1e-6) + matches


def buckets_for(entries: int) -> int:
    return int(min(1 << 20, max(4, -(-entries // PER_BUCKET))))


def _celled(e: Entries) -> Entries:
    """Entries of frequent keys in each cell of the key's grid that they belong to: part p goes to (p, q) of all q."""
    grid = np.maximum(1, np.ceil(np.asarray(e.often, np.float64) / LIST)).astype(np.int64)
    if (grid == 1).all():
        return e
    part = (mix(e.cls & ~U(1)) % grid.astype(U)).astype(np.int64)
    q = np.arange(grid.sum()) - np.repeat(np.cumsum(grid) - grid, grid)
    e = e.take(np.repeat(np.arange(len(grid)), grid))
    p, g = np.repeat(part, grid), np.repeat(grid, grid)
    cell = mix(e.key + (np.minimum(p, q) * g + np.maximum(p, q)).astype(U) * U(0x9E3779B97F4A7C15)) >> U(16)
    return e._replace(key=np.where(g > 1, cell, e.key))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(16)) % U(buckets)).astype(np.uint32)


def turn_of(key: np.ndarray, buckets: int, turns: int) -> np.ndarray:
    return _bucket(key, buckets) % np.uint32(turns)


def _blobs(to: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
    """(bucket, blob): of the rows of parts that go to a bucket, the columns one after another."""
    order = np.argsort(to.astype(np.uint16) if to.max(initial=0) < 1 << 16 else to, kind="stable")
    to, parts = to[order], [x[order] for x in parts]
    edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    rows = [b"".join(x[i:j].tobytes() for x in parts) for i, j in zip(edge[:-1], edge[1:])]
    return pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "blob"])


def _columns(blobs: list[pa.Buffer], kinds: list[type]) -> list[np.ndarray]:
    wide = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for buf in blobs:
        m, at = len(buf) // wide, 0
        for into, kind in zip(out, kinds):
            into.append(np.frombuffer(buf, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)]


def emit(df: DataFrame, of: Callable[[pa.RecordBatch], Entries], buckets: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(bucket int, blob binary): the entries of the batches of df by bucket of their key; of ``turns`` turns, each has
    buckets of its own."""
    return packed(df, of, buckets, turn, turns).repartitionById(-(-buckets // turns), F.col("bucket"))


def packed(df: DataFrame, of: Callable[[pa.RecordBatch], Entries], buckets: int, turn: int = 0, turns: int = 1, most: int = 1 << 21) -> DataFrame:
    """``emit`` before the shuffle; ``most``: see ``slices``."""

    def blobs(held: list[Entries]) -> pa.RecordBatch:
        e = Entries.joined(held)
        fold = [] if e.fold is None else list(np.ascontiguousarray(e.fold).view(U).T)
        return _blobs(_bucket(e.key, buckets) // np.uint32(turns), [e.cls, (mix(e.key) >> U(32)).astype(np.uint32), *(np.minimum(x, MOST).astype(np.uint16) for x in (e.n, e.reach)), *fold])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, most):
            e = _celled(of(b))
            if turns > 1:
                own = turn_of(e.key, buckets, turns) == turn
                e = e if own.all() else e.take(np.flatnonzero(own))
            if len(e.key):
                held.append(e)
                size += len(e.key) * (1 if e.fold is None else 3)  # an entry takes three times the room then
            if size >= HELD:
                yield blobs(held)
                held, size = [], 0
        if held:
            yield blobs(held)

    return df.mapInArrow(part, "bucket int, blob binary")


def places_of(df: DataFrame, of: Callable[[pa.RecordBatch], Entries], buckets: int, roots: DataFrame) -> DataFrame:
    """(node, root, places binary): of roots (node, root), those whose class has entries, with the buckets of these."""
    n = roots.count()
    bits = sketches.bits(roots.select("node"), lambda b: b.column(0).to_numpy().view(U) * U(0x9E3779B97F4A7C15) >> U(20), sketches.size_for(n))
    known = df.sparkSession.sparkContext.broadcast(bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, FEW):
            e = _celled(of(b))
            some = sketches.has(known.value, e.cls * U(0x9E3779B97F4A7C15) >> U(20))
            cls, bucket = e.cls[some], _bucket(e.key[some], buckets)
            order = np.lexsort((bucket, cls))
            cls, bucket = cls[order], bucket[order]
            new = np.r_[True, cls[1:] != cls[:-1]] if len(cls) else np.zeros(0, bool)
            fresh = new | np.r_[True, bucket[1:] != bucket[:-1]] if len(cls) else new
            cls, bucket, new = cls[fresh], bucket[fresh], new[fresh]
            edge = np.r_[np.flatnonzero(new), len(cls)]
            yield pa.RecordBatch.from_arrays([pa.array(cls[edge[:-1]].view(np.int64)), pa.array([bucket[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary())], ["node", "places"])

    at = df.mapInArrow(places, "node bigint, places binary").groupBy("node").agg(F.first("places").alias("places"))  # copies have the same ones
    return roots.join(at, "node").select("node", "root", "places")


def packed_roots(of: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """(bucket int, blob binary): of the roots of ``places_of``, each one in all buckets of the turn where its class has entries."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                places = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(2)]
                size = np.array(list(map(len, places)))
                to = np.concatenate(places)
                own = to % np.uint32(turns) == turn
                yield _blobs(to[own] // np.uint32(turns), [np.repeat(b.column(k).to_numpy().view(U), size)[own] for k in (0, 1)])

    return of.select("node", "root", "places").mapInArrow(spread, "bucket int, blob binary")


def _load(blobs: list[pa.Buffer], folds: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """cls; key, side (of a class) and n in one number; reach; bit vectors (uint64 [entries, BITS / 64]), if entries bring
    them: ordered by that number and the class, each entry once."""
    c, key, n, reach, *fold = _columns(blobs, [U, np.uint32, np.uint16, np.uint16, *[U] * (BITS // 64 * folds)])
    both = (key.astype(U) << U(17)) | ((c & U(1)) << U(16)) | n.astype(U)
    order = np.lexsort((c, both))
    c, both = c[order], both[order]
    fresh = np.r_[True, (c[1:] != c[:-1]) | (both[1:] != both[:-1])]
    order = order[fresh]
    return c[fresh], both[fresh], reach[order], np.stack([x[order] for x in fold], axis=1) if folds else None


def _load_apart(blobs: list[pa.Buffer], roots: list[pa.Buffer], bits: int = AFTER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_load`` for entries with bits of the keys ``after`` them, and the root of each. Those of the commonest root of each key
    are of side 0, all others of side 1. Copies are left: they have the same root, so they don't meet."""
    c, key, n, reach, *fold = _columns(blobs, [U, np.uint32, np.uint16, np.uint16, *[U] * (bits // 64)])
    node, of = _columns(roots, [U, U])
    order = np.argsort(node)
    node, of = node[order], of[order]
    at = np.minimum(np.searchsorted(node, c), max(0, len(node) - 1))
    root = np.where(node[at] == c, of[at], c) if len(node) else c
    pair = (key.astype(U) << U(32)) | (mix(root) >> U(32))
    order = np.argsort(pair)
    pair = pair[order]
    group = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    count, of_key = np.diff(np.r_[group, len(pair)]), pair[group] >> U(32)
    run = np.flatnonzero(np.r_[True, of_key[1:] != of_key[:-1]])
    most = np.maximum.reduceat((count << 32) | np.arange(len(group)), run) & 0xFFFFFFFF  # the largest group of each key
    common = np.repeat(root[order[group[most]]], np.diff(np.r_[group[run], len(pair)]))
    both = (pair >> U(32) << U(17)) | np.where(root[order] == common, U(0), U(1 << 16)) | n[order].astype(U)
    by = np.argsort(both)
    order = order[by]
    return c[order], both[by], reach[order], np.stack([x[order] for x in fold], axis=1), root[order]


def _tiles(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all i and lo[i] <= j < hi[i], about ``most`` at once."""
    size = np.maximum(hi - lo, 0)
    some = np.flatnonzero(size)
    total = np.cumsum(size[some])
    i = 0
    while i < len(some):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right"))
        at = some[i : max(j, i + 1)]
        s = size[at]
        yield np.repeat(at, s), np.arange(s.sum()) - np.repeat(np.cumsum(s) - s - lo[at], s)
        i = max(j, i + 1)


def _pairs(blobs: list[pa.Buffer], contained: bool, roots: list[pa.Buffer] | None = None, least: float | None = None, bits: int = AFTER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the entries of a bucket that lie within each other's reach; with roots, of those of different roots only;
    with least, of those whose bit vectors don't rule out that similarity: with roots, they are of the keys after an
    entry's own (``bits`` of them), else of all."""
    if not blobs:
        return
    if roots is None:
        cls, both, reach, fold = _load(blobs, least is not None)
    else:
        cls, both, reach, fold, root = _load_apart(blobs, roots, bits)
        spare = _spare(both, reach, fold, least)
    n = (both & U(MOST)).astype(np.uint16)
    key = both >> U(17) << U(17)
    side = (both & U(1 << 16)) != 0
    spans = []
    if contained:  # an entry of side 0 against those of side 1 with so many triples at least
        spans.append((np.searchsorted(both, key | U(1 << 16) | reach.astype(U), side="left"), np.where(side, 0, np.searchsorted(both, key | U((1 << 17) - 1), side="right"))))
    else:  # an entry against those after it in its key and side
        own = key | (both & U(1 << 16))
        after = np.where(reach >= n, np.searchsorted(both, own | reach.astype(U), side="right"), 0)
        if roots is None:
            spans.append((np.arange(1, len(cls) + 1), after))
        else:  # entries of a list's commonest root stand on side 0, and only meet the others
            spans.append((np.arange(1, len(cls) + 1), np.where(side, after, 0)))
            spans.append((np.searchsorted(both, key, side="left"), np.where(side, np.searchsorted(both, key | reach.astype(U), side="right"), 0)))
    for i, j in chain.from_iterable(_tiles(lo, hi, TILE if roots is None else APART) for lo, hi in spans):
        ok = reach.take(j) >= n.take(i)
        i, j = i[ok], j[ok]
        if roots is not None:
            ok = root.take(i) != root.take(j)
            i, j = i[ok], j[ok]
        if roots is not None:
            most = np.minimum(spare.take(i), spare.take(j)) + np.bitwise_count(fold.take(i, axis=0) & fold.take(j, axis=0)).sum(1, dtype=np.int64)
            ok = most >= (n.take(i).astype(np.int64) + n.take(j)) * (least / (1 + least)) - 1e-6
            i, j = i[ok], j[ok]
        elif least is not None:
            differ = np.bitwise_count(fold.take(i, axis=0) ^ fold.take(j, axis=0)).sum(1, dtype=np.int64)
            ok = differ <= (1 - least) / (1 + least) * (n.take(i).astype(np.int64) + n.take(j)) + 1e-6
            i, j = i[ok], j[ok]
        if len(i):
            a, b = cls.take(i), cls.take(j)
            if not contained:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield a, b


def _spare(both: np.ndarray, reach: np.ndarray, fold: np.ndarray, least: float) -> np.ndarray:
    """Of each entry, its own key and the keys after it less the bits they set. If an entry's key is the first one that it
    has in common with another, they have no more keys in common than this and the bits that both have set."""
    n = (both & U(MOST)).astype(np.int64)
    left = np.floor((reach + 1 + n) * (least / (1 + least)) + 1e-6).astype(np.int64)  # see similar_reach
    left[(n == MOST) | (reach == MOST)] = 1 << 30  # not known
    return left - np.bitwise_count(fold).sum(1, dtype=np.int64)


def compare(blobs: DataFrame, contained: bool = False, least: float | None = None) -> DataFrame:
    """(a bigint, b bigint): classes that share a key and lie within reach of each other; pairs may come more than once.
    least, for entries with bit vectors: without the pairs whose bit vectors rule out that Jaccard similarity.

    contained False: similarity, a < b as unsigned numbers. True: a is of side 0 and b of side 1; the reach of a is the
    least population count of a partner, that of b the largest."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _pairs([x.as_buffer() for batch in batches for x in batch.column(1)], contained, least=least):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    return blobs.mapInArrow(part, "a bigint, b bigint")


SHORT = (1 << 40) - 1  # the part of a class that ``_by_class`` packs for the second one of a pair


def compare_apart(entries: DataFrame, roots: DataFrame, buckets: int, least: float, bits: int = AFTER) -> DataFrame:
    """(a bigint, b bigint; a < b as unsigned numbers): classes of different roots whose Jaccard similarity may be ``least``:
    all that have it, and few others; pairs may come more than once.

    entries, roots: ``packed`` and ``packed_roots`` of a turn (a class without a root is its own) of so many buckets; each
    entry brings the bit vector (``bits``) of the keys ``after`` it. A pair is weighed at every key where it meets and is not counted,
    as it passes at the first key that it has in common if it is similar enough."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: tuple[list, list] = ([], [])
        for batch in batches:
            for is_root, x in zip(batch.column(1).to_pylist(), batch.column(2)):
                every[is_root].append(x.as_buffer())
        held, size = [], 0
        for pair in chain(_pairs(every[0], False, every[1], least, bits), [None]):
            if pair is not None:
                held.append(pair)
                size += len(pair[0])
            if held and (pair is None or size >= HELD):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in held]).view(np.int64)) for k in (0, 1)], ["a", "b"])
                held, size = [], 0

    both = entries.withColumn("is_root", F.lit(0)).unionByName(roots.withColumn("is_root", F.lit(1))).select("bucket", "is_root", "blob")
    return both.repartitionById(buckets, F.col("bucket")).mapInArrow(found, "a bigint, b bigint")


def _by_class(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """(bucket, blob) of pairs (a, b), each a once with 40 bits of each b, by the range of hashes of a that is a task's;
    ``held`` is emptied, so that its pairs are in memory once while they are put in order."""
    a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    held.clear()
    order = np.argsort(mix(a))
    a = a[order]
    b = b[order] & U(SHORT)
    del order
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    ends = np.r_[first, len(a)]
    a, size = a[first], np.diff(ends).astype(np.uint32)
    short = b.view(np.uint8).reshape(-1, 8)[:, :5]
    to = ((mix(a) >> U(32)) * U(parts) >> U(32)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    rows = [np.uint64(j - i).tobytes() + a[i:j].tobytes() + size[i:j].tobytes() + short[ends[i] : ends[j]].tobytes() for i, j in zip(edge[:-1], edge[1:])]
    return pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "blob"])


def _kept(blobs: Iterator[pa.Buffer]) -> list[memoryview]:
    """The blobs, which lie in a file that is mapped and goes with them if they are more than ``KEPT`` bytes."""
    held, size, ends, file = [], 0, [0], None
    for x in blobs:
        held.append(x)
        size += len(x)
        ends.append(ends[-1] + len(x))
        if size >= KEPT:
            file = file or tempfile.TemporaryFile()
            file.writelines(held)
            held, size = [], 0
    if file is None:
        return [memoryview(x) for x in held]
    file.writelines(held)
    file.flush()
    every = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    return [every[i:j] for i, j in zip(ends, ends[1:])]


def _met(blobs: Iterator[pa.Buffer], matches: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, 40 bits of b) of the pairs that stand ``matches`` times in the blobs of a part, about ``COUNTED`` at once: the
    pairs of a range of hashes of a, by which each blob is ordered."""
    every = []
    for x in _kept(blobs):
        k = int(np.frombuffer(x, U, 1)[0])
        every.append((np.frombuffer(x, U, k, 8), np.frombuffer(x, np.uint32, k, 8 + 8 * k), np.frombuffer(x, np.uint8, -1, 8 + 12 * k).reshape(-1, 5)))
    ranges = -(-sum(len(short) for _, _, short in every) // COUNTED)
    edges = [np.searchsorted(((mix(a) >> U(32)) * U(parts * ranges) >> U(32)) % U(ranges), np.arange(ranges + 1)) for a, _, _ in every]
    at = [np.r_[0, np.cumsum(size, dtype=np.int64)][edge] for (_, size, _), edge in zip(every, edges)]
    for r in range(ranges):
        left, right = [], []
        for (a, size, short), edge, pos in zip(every, edges, at):
            left.append(np.repeat(a[edge[r] : edge[r + 1]], size[edge[r] : edge[r + 1]]))
            wide = np.zeros((len(left[-1]), 8), np.uint8)
            wide[:, :5] = short[pos[r] : pos[r + 1]]
            right.append(wide.view(U).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        del left, right
        pair = mix(a * U(0x9E3779B97F4A7C15) + b)
        ordered = np.sort(pair)
        often = np.unique(ordered[: len(ordered) - matches + 1][ordered[matches - 1 :] == ordered[: len(ordered) - matches + 1]]) if len(ordered) >= matches else ordered[:0]
        del ordered
        found = np.searchsorted(often, pair)
        hit = np.flatnonzero(often[np.minimum(found, len(often) - 1)] == pair) if len(often) else np.zeros(0, np.int64)
        hit = hit[np.unique(pair[hit], return_index=True)[1]]
        yield a[hit], b[hit]


def alike(pairs: DataFrame, folds: DataFrame, least: float, contained: bool = False) -> DataFrame:
    """pairs (a, b) whose folded bit vectors (folds: cls, n, fold) don't rule out ``least``; contained: the share of a's
    triples that b has, else the Jaccard similarity."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(v.as_buffer() for v in b.column(k)), U).reshape(b.num_rows, -1) for k in (4, 5))
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            differ = np.bitwise_count(x & ~y if contained else x ^ y).sum(1, dtype=np.int64)
            radius = (1 - least) * na if contained else (1 - least) / (1 + least) * (na + nb)
            keep = pa.array(differ <= radius + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    joined = pairs.select("a", "b").join(folds.withColumnsRenamed({"cls": "a", "n": "n_a", "fold": "fold_a"}), "a").join(folds.withColumnsRenamed({"cls": "b", "n": "n_b", "fold": "fold_b"}), "b")
    return joined.select("a", "b", "n_a", "n_b", "fold_a", "fold_b").mapInArrow(part, "a bigint, b bigint")


def shared(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, set_a, set_b; sets as packed 48-bit triples): (a, b, n_a int, n_b int, both int), exactly. If pairs have
    n_a and n_b, these stand for the sizes of the sets."""
    sizes = [c for c in ("n_a", "n_b") if c in pairs.columns]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                x = b.slice(s, 1024)
                (ta, na), (tb, nb) = unpack(x.column(2)), unpack(x.column(3))
                k = np.arange(x.num_rows, dtype=np.int64)
                every = np.sort(np.concatenate([(np.repeat(k, m).astype(U) << U(48)) | t for t, m in ((ta, na), (tb, nb))]))
                same = every[1:][every[1:] == every[:-1]] >> U(48)
                n = [x.column(4), x.column(5)] if sizes else [pa.array(v, pa.int32()) for v in (na, nb)]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *n, pa.array(np.bincount(same.astype(np.int64), minlength=x.num_rows), pa.int32())], ["a", "b", "n_a", "n_b", "both"])

    return pairs.select("a", "b", "set_a", "set_b", *sizes).mapInArrow(part, "a bigint, b bigint, n_a int, n_b int, both int")


def pack(items: np.ndarray) -> bytes:
    return np.ascontiguousarray(items).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def packs(items: np.ndarray, size: np.ndarray) -> pa.Array:
    """``pack`` of the items of docs that have so many, one doc after another."""
    ends = np.r_[0, np.cumsum(6 * size)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(pack(items))])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, ends, raw = column.cast(pa.binary()).buffers()
    if not len(column):
        return np.zeros(0, U), np.zeros(0, np.int64)
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    out = np.zeros(((ends[-1] - ends[0]) // 6, 8), np.uint8)
    if len(out):
        out[:, :6] = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].reshape(-1, 6)
    return out.view(U).ravel(), np.diff(ends) // 6
