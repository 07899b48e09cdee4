"""Problem 5: clusters of mutually similar records, each with its size and most typical members.

``mixture`` and ``clusters`` follow the method named for the problem: expectation-maximisation of a Gaussian mixture
with regularised covariances on standardised, reduced features; the Bayesian information criterion chooses the number
of components, and the members of highest density represent a cluster. Every iteration adds up sufficient statistics
over all rows on the executors.

``linked`` gives the clusters of the problem's statement (links of a Jaccard similarity of 0.2 or more, directly or
through others, 10 members at least). A mixture divides space into a few ellipsoids and can't say which records are
linked, so these clusters come from min-hash links: bands of two minima; in a band's list each class is tied to the
list's first member, or else to the one before it, never to all. Links are checked exactly on the triple sets before the
first components are formed. Links that this misses are then found without loss: ``across`` looks at all pairs of classes
of different components by the prefix filter of problem 4, and the links it finds join the components. Texts are read
twice, for the counters of their triples and for the sets of those that occur more than once; all steps read these.

Cases: null, empty and short texts (under 12 words) are in no linked cluster; in ``clusters`` texts without words have
zero features and fall in whichever component lies nearest; copies are one class for the links and count as members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import tiles
from gaugeframe.llm.classes import common_sets, rarity, unpacked, verified_sets
from gaugeframe.llm.graph import components
from gaugeframe.llm.shingles import FEW, U, mix, slices, words
from gaugeframe.llm.sketches import Levels
from gaugeframe.sources.scratch import Saved, freed, save

ROWS = 2  # minima in a band
BANDS = 6  # bands in a group; a group's minima also give an estimate
GROUPS = 5
CHUNK = 1 << 19  # classes compared at once
SPLIT = 500_000  # texts for one task of a group


def minima(row: np.ndarray, t: np.ndarray, rows: int, groups: range = range(GROUPS)) -> np.ndarray:
    """uint16 [rows, groups * BANDS * ROWS]: hashed minima of each row's triples under as many orders, those of the groups."""
    k = GROUPS * BANDS * ROWS
    first = groups.start * BANDS * ROWS
    out = np.zeros((rows, len(groups) * BANDS * ROWS), np.uint16)
    if not len(row):
        return out
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    t32 = (mix(t) >> U(32)).astype(np.uint32)
    factors = (mix(np.arange(k, dtype=U) + U(991)) | U(1)).astype(np.uint32)
    shifts = (mix(np.arange(k, dtype=U) + U(17)) >> U(20)).astype(np.uint32)
    for i in range(first, first + out.shape[1]):
        least = np.minimum.reduceat((t32 ^ shifts[i]) * factors[i], at)
        out[row[at], i - first] = ((least * np.uint32(0x9E3779B1)) ^ (least >> np.uint32(7)) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def _band_keys(m: np.ndarray) -> list[np.ndarray]:
    x = m.astype(U)
    return [(x[:, b * ROWS] << U(16)) | x[:, b * ROWS + 1] for b in range(BANDS)]


def candidates(sets: DataFrame, similar: int = 4) -> Saved:
    """(a, b; a < b): classes with a band in common and ``similar`` equal minima of the group's twelve. In several parts a
    text goes to up to six cells a group, so that each group is then a turn of its own."""
    parts = max(1, -(-sets.count() // SPLIT))
    return _together([_candidates(sets, similar, parts, g) for g in ([range(GROUPS)] if parts == 1 else [range(g, g + 1) for g in range(GROUPS)])])


def _together(turns: list[DataFrame]) -> Saved:
    """The different rows of all turns, each of which is written before the next one begins."""
    if len(turns) == 1:
        return Saved(turns[0].distinct())
    found = [Saved(x.distinct()) for x in turns]
    every = Saved(reduce(DataFrame.union, [x.df for x in found]).distinct())
    for x in found:
        x.drop()
    return every


def _candidates(sets: DataFrame, similar: int, parts: int, groups: range) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, FEW):
            cls, _, size, t = unpacked(b)
            m = minima(np.repeat(np.arange(len(cls)), size), t, len(cls), groups)
            ids, blobs = [], []
            for g in range(len(groups)):
                own = m[:, g * BANDS * ROWS : (g + 1) * BANDS * ROWS]
                # a text goes to each part that one of its bands needs
                part = np.stack([mix(k + U(b)) % U(parts) for b, k in enumerate(_band_keys(own))], axis=1)
                cells = [(g * parts + p, np.flatnonzero((part == p).any(1))) for p in np.unique(part)]
                for cell, x in cells:
                    if len(x):
                        ids.append(cell)
                        blobs.append(np.array([len(x), cell % parts], np.uint32).tobytes() + cls[x].tobytes() + own[x].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["cell", "blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _tied(batches, parts, similar):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    cells = sets.select("cls", "n", "data").mapInArrow(emit, "cell int, blob binary").repartitionById(len(groups) * parts, F.col("cell"))
    return cells.mapInArrow(compare, "a bigint, b bigint")


def _tied(batches: Iterator[pa.RecordBatch], parts: int, similar: int) -> Iterator[np.ndarray]:
    """uint64 [pairs, 2] of a cell. Of each band only the lists of the cell's own part are kept, about ``SPLIT`` at most;
    what a text has in other bands is compared in their cells."""
    heads = [(np.zeros(0, U), np.zeros((0, BANDS * ROWS), np.uint16)) for _ in range(BANDS)]  # first of each list so far
    for part, cls, m in _chunks(batches):
        out = []
        for b, keys in enumerate(_band_keys(m)):
            own = mix(keys + U(b)) % U(parts) == U(part)
            c, mm = np.concatenate([heads[b][0], cls[own]]), np.concatenate([heads[b][1], m[own]])
            key = _band_keys(mm)[b]
            order = np.argsort(key, kind="stable")
            key, c, mm = key[order], c[order], mm[order]
            first = np.r_[True, key[1:] != key[:-1]][: len(key)]
            at = np.flatnonzero(first)
            heads[b] = c[at], mm[at]
            i = np.flatnonzero(~first)
            for j in (np.repeat(at, np.diff(np.r_[at, len(key)])), np.arange(len(key)) - 1):
                x, y = c[i], c[j[i]]
                keep = (x != y) & ((mm[i] == mm[j[i]]).sum(1) >= similar)
                out.append(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], axis=1))
                i = i[~keep]  # what the first member does not resemble is tied to the one before it
        pairs = np.concatenate(out)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        yield pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)][: len(pairs)]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The cell's part, classes and minima, each class once in a chunk, in order of the class."""
    part = 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        for x in b.column(1):
            buf = x.as_buffer()
            n, part = map(int, np.frombuffer(buf, np.uint32, 2))
            held.append((np.frombuffer(buf, U, n, 8), np.frombuffer(buf, np.uint16, n * BANDS * ROWS, 8 + 8 * n).reshape(n, -1)))
        if sum(len(c) for c, _ in held) >= CHUNK:
            yield part, *_merged(held)
            held = []
    if held:
        yield part, *_merged(held)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cls, at = np.unique(np.concatenate([c for c, _ in held]), return_index=True)
    return cls, np.concatenate([m for _, m in held])[at]


TURNS = 4  # shares of the lists, each made and compared by itself
SHARED = 4  # occurrences of triples for each counter; there are more only when counters have reached their largest number


def plan(level: Levels) -> tuple[int, int]:
    """(turns, bits of the keys after an entry's own). Where counters are shared by many triples, those that occur once are
    not known, which makes lists longer, and the order is more of chance, which leaves more keys after one where pairs meet
    by chance: twice the turns, and as many bits as tell such pairs apart."""
    return (2 * TURNS, 320) if level.total > SHARED * len(level.level) else (TURNS, tiles.AFTER)


def across(sets: DataFrame, roots: DataFrame, least: float, level: Broadcast[Levels]) -> DataFrame:
    """(a, b): every pair of classes of different roots with a Jaccard similarity of at least ``least``.

    sets: ``common_sets``; roots: (node, root); a class without one is its own root. The prefix filter of problem 4 loses no
    pair, and pairs of one root, which can tell nothing new, are never formed. At low similarities most pairs of a list meet
    by chance in one key, so an entry brings the bits of the keys after its own, and a pair that cannot have enough in
    common from this key on is never written."""

    turns, bits = plan(level.value)

    def entries(b: pa.RecordBatch, turn: int | None = None) -> tiles.Entries:
        cls, n, size, t = unpacked(b)
        doc = np.repeat(np.arange(len(cls)), size)
        place = np.arange(len(t)) - np.repeat(np.cumsum(size) - n, size)  # what occurs once has no partner and comes first
        v = level.value.of(t)
        often = level.value.often(np.arange(256))
        keep = tiles.prefix(np.repeat(n, size), place, least)
        if turn is not None:  # keys in several lists may be of any turn, which ``packed`` finds out
            keep &= (tiles.turn_of(t, buckets, turns) == turn) | (often > tiles.LIST)[v]
        keep = np.flatnonzero(keep)
        fold = None if turn is None else tiles.after(t, size, keep, bits)
        doc, place = doc[keep], place[keep]
        return tiles.Entries(cls[doc], t[keep], n[doc], tiles.similar_reach(n[doc], place, least), often[v[keep]], fold)

    rows = sets.select("cls", "n", "data")
    buckets = turns * tiles.buckets_for(int(level.value.total * (1 - least)) + 1)
    of = Saved(tiles.places_of(rows, entries, buckets, roots))
    found = _together([tiles.compare_apart(tiles.packed(rows, lambda b, k=k: entries(b, k), buckets, k, turns, FEW), tiles.packed_roots(of.df, k, turns), buckets // turns, least, bits) for k in range(turns)])
    of.drop()
    return _links(sets, found.df, least)


PAIRS = 0.5  # pairs for each text whose sets are moved at once


def _links(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs that are exactly so similar. Each takes the room of a set or two, so many of them are checked in pieces."""
    pieces = max(1, math.ceil(pairs.count() / max(1.0, PAIRS * sets.count())))

    def links(piece: DataFrame) -> DataFrame:
        return verified_sets(sets, piece).filter(F.col("both") * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b")

    if pieces == 1:
        return links(pairs)
    return _together([links(pairs.filter(F.pmod(F.xxhash64("a"), F.lit(pieces)) == k)) for k in range(pieces)]).df


def linked(df: DataFrame, id_col: str, text_col: str, least: float = 0.2, smallest: int = 10) -> DataFrame:
    """(first_id, id): each member but the first of each cluster of at least ``smallest`` rows."""
    level = df.sparkSession.sparkContext.broadcast(rarity(df.select(F.col(text_col).cast("string").alias("text"))))
    sets = save(common_sets(df, id_col, text_col, level))
    found = candidates(sets)
    edges = save(_links(sets, found.df, least))
    found.drop()
    roots = save(components(edges))
    rest = across(sets, roots, least, level)
    for end in "ab":  # links across join whole components
        rest = rest.join(roots.withColumnsRenamed({"node": end, "root": f"root_{end}"}), end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).select("a", "b")
    joined = components(rest).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    rows = sets.select("id", "cls").distinct().join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("id", F.coalesce("root", "cls").alias("root"))
    rows = Saved(rows.join(joined, "root", "left").select("id", F.coalesce("whole", "root").alias("root"))).df
    size = rows.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter(F.col("n") >= smallest)
    return rows.join(size, "root").filter("id > first_id").select("first_id", "id")


# --- Gaussian mixture -------------------------------------------------------------------------------------------------

WIDE = 256  # hashed word counts
REDUCED = 8


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, v binary): square roots of hashed word counts over the text's length, as float32 [WIDE]."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _hashed(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "v"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string")).mapInArrow(part, "id bigint, v binary")


def _hashed(texts: list[str | None]) -> np.ndarray:
    w = words(texts)
    v = np.bincount(w.doc * WIDE + (w.hash % U(WIDE)).astype(np.int64), minlength=len(texts) * WIDE).reshape(-1, WIDE).astype(np.float64)
    return np.sqrt(v / np.maximum(v.sum(1, keepdims=True), 1)).astype(np.float32)


SUMS = 8  # tasks that add up the partitions' sums


def _gather(df: DataFrame, of, size: int) -> np.ndarray:
    """Sum over all rows of a vector of fixed size that ``of`` gives for a batch. Partitions are added up in ``SUMS`` tasks,
    whose sums come to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in slices(batches):
            if b.num_rows:
                total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["k", "s"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(1):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    with freed(df.sparkSession):
        rows = df.mapInArrow(part, "k int, s binary").repartitionById(SUMS, F.col("k")).mapInArrow(fold, "s binary").collect()
    return sum(np.frombuffer(r.s, np.float64) for r in rows)


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), -1).astype(np.float64)


def reduced(df: DataFrame, id_col: str, text_col: str, keep: int = REDUCED) -> DataFrame:
    """(id, x binary): the leading principal components of the features, each of mean 0 and variance 1 (float32)."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def moments(b: pa.RecordBatch) -> np.ndarray:
        v = _hashed(b.column(1).to_pylist()).astype(np.float64)
        return np.r_[len(v), v.sum(0), (v.T @ v).ravel()]

    got = _gather(texts, moments, 1 + WIDE + WIDE * WIDE)
    n = max(got[0], 1)
    mean = got[1 : 1 + WIDE] / n
    cov = got[1 + WIDE :].reshape(WIDE, WIDE) / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    value, vector = np.linalg.eigh(cov / np.outer(dev, dev))
    lead = np.argsort(-value)[:keep]
    turn = (vector[:, lead] * np.sign(vector[np.abs(vector[:, lead]).argmax(0), lead])) / dev[:, None] / np.sqrt(np.maximum(value[lead], 1e-9))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = ((_hashed(b.column(1).to_pylist()) - mean) @ turn).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    return texts.mapInArrow(part, "id bigint, x binary")


def _terms(x: np.ndarray) -> np.ndarray:
    """1, x_i and x_i x_j (i <= j) of each row: a Gaussian's log density is linear in them, and their sums are its statistics."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def _log_density(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """[rows, components]: log of weight times density."""
    return _terms(x) @ _linear(model)


def _linear(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """[terms, components]: what ``_terms`` are multiplied with."""
    weight, mean, cov = model
    i, j = np.triu_indices(mean.shape[1])
    inverse = np.linalg.inv(cov)
    pull = np.einsum("kij,kj->ki", inverse, mean)
    rest = np.log(weight) - 0.5 * (np.einsum("ki,ki->k", pull, mean) + np.linalg.slogdet(cov)[1] + mean.shape[1] * np.log(2 * np.pi))
    return np.concatenate([rest[:, None], pull, -inverse[:, i, j] * np.where(i == j, 0.5, 1.0)], axis=1).T


def _split(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twice as many components: each one parted along its longest axis."""
    weight, mean, cov = model
    value, axis = np.linalg.eigh(cov)
    step = 0.5 * np.sqrt(value[:, -1])[:, None] * axis[:, :, -1]
    less = cov - 0.75 * value[:, -1][:, None, None] * np.einsum("ki,kj->kij", axis[:, :, -1], axis[:, :, -1])
    return np.r_[weight, weight] / 2, np.concatenate([mean - step, mean + step]), np.concatenate([less, less])


def mixture(points: DataFrame, k: int, rounds: int = 500, ridge: float = 1e-2, dims: int = REDUCED, close: float = 1e-4, start: tuple | None = None) -> tuple[tuple, float]:
    """EM for k components over all rows (x binary, standardised): (weights, means, covariances) and the BIC.

    start: a model of k / 2 components, which are split; None: random means. Rounds end when the mean log-likelihood of a
    row gains less than ``close``; a fit that has not come there after ``rounds`` is an error."""
    if start is not None:
        model = _split(start)
    else:
        model = (np.full(k, 1 / k), np.random.default_rng(42).standard_normal((k, dims)), np.repeat(np.eye(dims)[None], k, 0))
    i, j = np.triu_indices(dims)
    width = 1 + dims + len(i)
    likelihood, n, was = 0.0, 0.0, -np.inf
    for _ in range(rounds):

        def stats(b: pa.RecordBatch, linear: np.ndarray = _linear(model)) -> np.ndarray:
            t = _terms(_matrix(b.column(0)))
            d = t @ linear
            top = d.max(1, keepdims=True)
            np.exp(d - top, out=d)
            total = d.sum(1)
            d /= total[:, None]
            return np.r_[len(t), (np.log(total) + top[:, 0]).sum(), (d.T @ t).ravel()]

        s = _gather(points.select("x"), stats, 2 + k * width)
        n, likelihood = s[0], s[1]
        done = abs(likelihood - was) <= close * max(n, 1)
        was = likelihood
        if done:  # of the model as it stands
            break
        sums = s[2:].reshape(k, width)
        mass = np.maximum(sums[:, 0], 1e-9)
        mean = sums[:, 1 : 1 + dims] / mass[:, None]
        second = np.zeros((k, dims, dims))
        second[:, i, j] = second[:, j, i] = sums[:, 1 + dims :] / mass[:, None]
        cov = np.where((mass > 1)[:, None, None], second - np.einsum("ki,kj->kij", mean, mean), 0) + ridge * np.eye(dims)
        model = (np.maximum(mass / max(n, 1), 1e-12), mean, cov)
    else:
        raise RuntimeError(f"{k} components have not converged after {rounds} rounds")
    free = k - 1 + k * dims + k * dims * (dims + 1) / 2
    return model, free * np.log(max(n, 2)) - 2 * likelihood


def fitted(points: DataFrame, choices: tuple[int, ...] | None = None, rounds: int = 500) -> tuple:
    """The model of least BIC among ``choices``; None: 4 components, then twice as many, by splitting those there are, as
    long as the BIC falls, and 16 at least."""
    if choices is not None:
        return min((mixture(points, k, rounds) for k in choices), key=lambda m: m[1])[0]
    tried = [mixture(points, 4, rounds)]
    while len(tried) < 3 or tried[-1][1] < tried[-2][1]:
        tried.append(mixture(points, 2 * len(tried[-1][0][0]), rounds, start=tried[-1][0]))
    return min(tried, key=lambda m: m[1])[0]


def _assigned(points: DataFrame, model: tuple) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            d = _log_density(_matrix(b.column(1)), model)
            at = d.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d[np.arange(len(d)), at])], ["id", "cluster", "density"])

    return points.mapInArrow(part, "id bigint, cluster int, density double")


def assigned(df: DataFrame, id_col: str, text_col: str, choices: tuple[int, ...] | None = None, rounds: int = 500) -> DataFrame:
    """(id, cluster, density): the mixture component of every row."""
    points = Saved(reduced(df, id_col, text_col)).df
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "id bigint, cluster int, density double")
    return _assigned(points, fitted(points, choices, rounds))


def clusters(df: DataFrame, id_col: str, text_col: str, choices: tuple[int, ...] | None = None, typical: int = 3, rounds: int = 500) -> DataFrame:
    """(cluster, size, rank, id, density): the ``typical`` members of highest density of each mixture component.

    The components are those of the number among ``choices`` with the least BIC (see ``fitted``). Ties in density go to
    the smaller id.
    """
    points = Saved(reduced(df, id_col, text_col)).df
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "cluster int, size bigint, rank int, id bigint, density double")
    model = fitted(points, choices, rounds)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each cluster in a partition, with the counts; a cluster's rows never meet in one task."""
        held = None
        count = np.zeros(len(model[0]), np.int64)
        for b in batches:
            t = b.to_pandas()
            count += np.bincount(t.cluster, minlength=len(count))
            held = t if held is None else pd.concat([held, t])
            held = held.sort_values(["cluster", "density", "id"], ascending=[True, False, True]).groupby("cluster").head(typical)
        if held is not None:
            held["n"] = np.where(held.groupby("cluster").cumcount() == 0, count[held.cluster], 0)
            yield pa.RecordBatch.from_pandas(held[["id", "cluster", "density", "n"]], preserve_index=False)

    import pandas as pd
    from pyspark.sql import Window

    few = _assigned(points, model).mapInArrow(best, "id bigint, cluster int, density double, n bigint")
    by = Window.partitionBy("cluster")
    return (
        few.withColumn("size", F.sum("n").over(by))
        .withColumn("rank", F.row_number().over(by.orderBy(F.desc("density"), "id")))
        .filter(F.col("rank") <= typical)
        .select("cluster", "size", "rank", "id", "density")
    )
