"""Texts as classes of equal triple sets: membership, triple sets of wanted classes, and exact checks of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import sketches, tiles
from gaugeframe.llm.shingles import FEW, U, set_hashes, slices, triples, words


def class_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, triple) of each text and the class of each; the lowest bit of a class is 0; 0 is for texts without triples."""
    doc, t = triples(words(texts))
    return doc, t, set_hashes(doc, t, len(texts)) & ~U(1)


def expected(df: DataFrame, text_col: str) -> int:
    """About how many different triples the texts have: one for each 24 characters."""
    return int((df.agg(F.sum(F.length(text_col))).first()[0] or 0) // 24) + 1


def rarity(texts: DataFrame) -> sketches.Levels:
    """How often triples occur in all texts (the first column)."""
    return sketches.levels(texts, lambda b: triples(words(b.column(0).to_pylist()))[1], expected(texts, texts.columns[0]))


def members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id bigint, cls bigint, n int, fold binary) of the texts that have triples: class, number of triples, folded set."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, t, cls = class_of(b.column(1).to_pylist())
            has = pa.array(cls != 0)
            n = np.bincount(doc, minlength=len(cls))
            fold = tiles.folded(doc, t, len(cls))
            every = pa.FixedSizeBinaryArray.from_buffers(pa.binary(fold.shape[1]), len(fold), [None, pa.py_buffer(np.ascontiguousarray(fold))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([x.filter(has) for x in (b.column(0), pa.array(cls.view(np.int64)), pa.array(n, pa.int32()), every)], ["id", "cls", "n", "fold"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string")).mapInArrow(part, "id bigint, cls bigint, n int, fold binary")


def folds(m: DataFrame) -> DataFrame:
    """(cls, n, fold), each class of ``members`` once."""
    return m.groupBy("cls").agg(F.first("n").alias("n"), F.first("fold").alias("fold"))


def first_of_each(cls: np.ndarray) -> np.ndarray:
    """Index of the first text of each class other than 0."""
    c, at = np.unique(cls, return_index=True)
    return at[c != 0]


def of_first(doc: np.ndarray, t: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (doc, triple) of the first text of each class."""
    first = np.zeros(len(cls), bool)
    first[first_of_each(cls)] = True
    keep = first[doc]
    return doc[keep], t[keep]


def sets_of(df: DataFrame, text_col: str, wanted: np.ndarray) -> DataFrame:
    """(cls bigint, data binary): triple sets, once each, of the classes that the bit set ``wanted`` may hold."""
    bits = df.sparkSession.sparkContext.broadcast(wanted)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            doc, t, cls = class_of(b.column(0).to_pylist())
            at = first_of_each(cls)
            at = at[sketches.has(bits.value, mixed(cls[at]))]
            at = np.array([i for i in at if cls[i] not in seen], np.int64)
            if len(seen) < 1_000_000:  # repeats beyond are only dropped later
                seen.update(int(c) for c in cls[at])
            lo, hi = np.searchsorted(doc, at, side="left"), np.searchsorted(doc, at, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(cls[at].view(np.int64)), pa.array([tiles.pack(t[i:j]) for i, j in zip(lo, hi)], pa.binary())], ["cls", "data"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(part, "cls bigint, data binary")


def common_sets(df: DataFrame, id_col: str, text_col: str, level: Broadcast[sketches.Levels]) -> DataFrame:
    """(id bigint, cls bigint, n int, data binary) of the texts that have triples: class, number of triples, and those that
    may occur in other texts (by counters of all texts, ``rarity``), rarest first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, FEW):
            doc, t, cls = class_of(b.column(1).to_pylist())
            n = np.bincount(doc, minlength=len(cls))
            v = level.value.of(t)
            doc, t, v = doc[v > 0], t[v > 0], v[v > 0]
            data = tiles.packs(tiles.by_rarity(doc, t, v), np.bincount(doc, minlength=len(cls)))
            has = pa.array(cls != 0)
            yield pa.RecordBatch.from_arrays([x.filter(has) for x in (b.column(0), pa.array(cls.view(np.int64)), pa.array(n, pa.int32()), data)], ["id", "cls", "n", "data"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string")).mapInArrow(part, "id bigint, cls bigint, n int, data binary")


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (cls, n, data) of ``common_sets``, each class with such triples once: class, n, number of these, and these."""
    cls = b.column(0).to_numpy().view(U)
    b = b.take(pa.array(first_of_each(cls)))
    t, size = tiles.unpack(b.column(2))
    some = size > 0
    return b.column(0).to_numpy().view(U)[some], b.column(1).to_numpy().astype(np.int64)[some], size[some], t


def mixed(cls: np.ndarray) -> np.ndarray:
    return (cls >> U(1)) * U(0x9E3779B97F4A7C15) >> U(20)


def verified(df: DataFrame, text_col: str, pairs: DataFrame) -> DataFrame:
    """Exact counts (a, b, n_a, n_b, both) for pairs (a, b) of classes, each pair once. Only wanted sets are moved."""
    sets = sets_of(df, text_col, _wanted(pairs)).groupBy("cls").agg(F.first("data").alias("data"))
    joined = pairs.join(sets.withColumnsRenamed({"cls": "a", "data": "set_a"}), "a").join(sets.withColumnsRenamed({"cls": "b", "data": "set_b"}), "b")
    return tiles.shared(joined)


def verified_sets(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``verified`` by the rows of ``common_sets``."""
    bits = sets.sparkSession.sparkContext.broadcast(_wanted(pairs))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = b.column(0).to_numpy().view(U)
            at = first_of_each(cls)
            yield b.take(pa.array(at[sketches.has(bits.value, mixed(cls[at]))]))

    some = sets.select("cls", "n", "data").mapInArrow(part, "cls bigint, n int, data binary").groupBy("cls").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    a, b = (some.withColumnsRenamed({"cls": x, "n": f"n_{x}", "data": f"set_{x}"}) for x in "ab")
    return tiles.shared(pairs.join(a, "a").join(b, "b"))


def _wanted(pairs: DataFrame) -> np.ndarray:
    """A bit set of the classes of pairs (a, b)."""

    def both(b: pa.RecordBatch) -> np.ndarray:
        return mixed(np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()]).view(U))

    return sketches.bits(pairs.select("a", "b"), both, sketches.size_for(2 * pairs.count()))
