"""Problem 1: records of evaluation splits that also stand, exactly or nearly, in training records.

Method: content-defined chunks, whose digests are joined across the splits and whose shared lengths are summed.

* ``fractions`` gives for each evaluation record the share of its words in chunks that some training record has. A rolling
  hash over two words cuts the normalised words, so that the same passage gives the same chunks wherever it stands.
* ``pairs`` gives the pairs of an evaluation and a training record with at least ``least`` of the evaluation record's
  word triples. The lengths of longer chunks can't bound how many triples are shared (a pair may share 0.7 of its triples
  and no chunk), so records are cut here at every word: a chunk is a word with the two after it, and the shared length of
  two records is the number of triples in common. An evaluation class enters the lists of its rarest digests, as many as
  any such partner must share one of, and a training class those of its digests that some evaluation class has entered;
  lists are cut where the sizes lie out of reach, pairs are weighed by their folded bit vectors and then exactly.

Cases: null, empty and short texts (under 12 words) are in no pair and have no fraction; a null split counts as the
request's, or as training; other splits are neither side; copies are one class until ``pairs`` expands them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import sketches, tiles
from gaugeframe.llm.classes import class_of, folds, members, of_first, rarity, verified
from gaugeframe.llm.shingles import MIN_WORDS, U, Words, mix, powers, slices, words
from gaugeframe.sources.scratch import Saved

CUT = 2
TRAIN = ("train", "training")
EVALUATION = ("test", "validation", "valid", "val", "dev", "eval")


def side_of(split: Column) -> Column:
    """0 for an evaluation split, 1 for a training split, null for others; case, blanks and a slice do not matter."""
    s = F.lower(F.regexp_replace(F.regexp_replace(split, r"\[[^\]]*\]", ""), r"(?U)^\s+|\s+$", ""))
    return F.when(s.isin(*EVALUATION), F.lit(0)).when(s.isin(*TRAIN), F.lit(1))


def sides(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """(sample_id, split, source, side): the split is the sample's, else its request's, else ``train``."""
    asked = requests.groupBy("request_id").agg(F.max("split").alias("asked"))
    return (
        samples.select("sample_id", "request_id", "split", "source")
        .join(asked, "request_id", "left")
        .select("sample_id", F.coalesce("split", "asked", F.lit("train")).alias("split"), "source")
        .withColumn("side", side_of(F.col("split")))
    )


def chunks(w: Words, cut: int = CUT, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, digest, words) of the chunks of each text, in order. A digest covers the word after the chunk too, which makes
    chunks of common words rarer; a text's last chunk has no such word."""
    h, d = w.hash, w.doc
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    before = np.r_[U(0), h[:-1]]
    before[np.r_[True, d[1:] != d[:-1]]] = 0
    last = (mix(before * U(0x9FB21C651E98DF25) + h) >> U(40)) % U(cut) == 0
    last |= np.r_[d[1:] != d[:-1], True]
    stop = np.flatnonzero(last)
    start = np.r_[0, stop[:-1] + 1]
    up, down = powers(len(h))
    total = np.cumsum(h * up)
    size = stop - start + 1
    after = np.minimum(stop + 1, (np.cumsum(w.count) - 1)[d[stop]])
    digest = mix((total[after] - np.where(start > 0, total[start - 1], U(0))) * down[start] + (after - start).astype(U))
    keep = w.count[d[stop]] >= min_words
    return d[stop][keep], digest[keep], size[keep]


def _distinct(doc: np.ndarray, digest: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each digest once for a doc, with the sum of its lengths."""
    if not len(doc):
        return doc, digest, size
    order = np.lexsort((digest, doc))
    doc, digest, size = doc[order], digest[order], size[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])])
    return doc[at], digest[at], np.add.reduceat(size, at)


def asking(requests: DataFrame) -> np.ndarray:
    """Bit set of the ids of the requests for an evaluation split: a request whose bit is not set asks for none."""
    ids = requests.groupBy("request_id").agg(F.max("split").alias("asked")).filter(side_of(F.col("asked")) == 0).select(F.col("request_id").cast("bigint"))
    return sketches.bits(ids, lambda b: mix(b.column(0).drop_null().to_numpy().view(U)), sketches.size_for(ids.count()))


def pairs(samples: DataFrame, requests: DataFrame, least: float = 0.7) -> DataFrame:
    """(evaluation_id, training_id): all pairs of rows; samples: sample_id, request_id, split, source, text."""
    spark = samples.sparkSession
    side = F.when(F.col("split").isNull(), 2).otherwise(F.coalesce(side_of(F.col("split")), F.lit(3)))
    text = samples.select(F.col("text").cast("string").alias("text"), side.alias("side"), F.col("request_id").cast("bigint").alias("request_id")).filter("side < 3")
    counted = rarity(text)
    level = spark.sparkContext.broadcast(counted)
    evaluation = spark.sparkContext.broadcast(asking(requests))

    def sided(b: pa.RecordBatch) -> np.ndarray:
        """0, 1, or 2 for a null split whose request may be for an evaluation split: such a text stands on both sides
        until the exact sides are joined."""
        s = b.column(1).to_numpy()
        ids = pc.fill_null(b.column(2), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
        asked = sketches.has(evaluation.value, mix(ids)) & pc.is_valid(b.column(2)).to_numpy(zero_copy_only=False)
        return np.where((s == 2) & ~asked, 1, s)

    def ranked(doc: np.ndarray, t: np.ndarray, cls: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the first text of each class among ``own``, rarest first: (doc, digest, level, place, digests of the text)."""
        doc, t = of_first(doc, t, np.where(own, cls, U(0)))
        n = np.bincount(doc, minlength=len(cls))
        v = level.value.of(t)
        order, place = tiles.rarest(doc, t, v)
        doc = doc[order]
        return doc, t[order], v[order], place, n[doc]

    def asked(b: pa.RecordBatch) -> np.ndarray:
        own = sided(b) != 1
        doc, t, v, place, n = ranked(*class_of(b.column(0).to_pylist()), own)
        return t[tiles.prefix(n, place, least) & (v > 0)]

    wanted = spark.sparkContext.broadcast(sketches.bits(text.filter("side <> 1"), asked, sketches.size_for(counted.total // 8)))

    def entries(b: pa.RecordBatch) -> tiles.Entries:
        s = sided(b)
        known = class_of(b.column(0).to_pylist())
        parts = []
        for one in (0, 1):
            doc, t, v, place, n = ranked(*known, (s == one) | (s == 2))
            # what occurs once has no partner, nor has a training digest under which no evaluation record is entered
            keep = tiles.prefix(n, place, least) & (v > 0) if one == 0 else sketches.has(wanted.value, t)
            doc, t, v, place, n = doc[keep], t[keep], v[keep], place[keep], n[keep]
            reach = np.ceil(least * n - 1e-6) if one == 0 else np.floor((n - place) / least + 1e-6)
            parts.append((known[2][doc] | U(one), t, n, reach.astype(np.int64), level.value.often(v)))
        return tiles.Entries(*(np.concatenate(x) for x in zip(*parts)))

    blobs = tiles.emit(text, entries, tiles.buckets_for(counted.total // 4 + 1))
    found = Saved(tiles.compare(blobs, contained=True).select("a", F.col("b").bitwiseAND(F.lit(-2)).alias("b")).distinct())
    m = Saved(members(samples, "sample_id", "text").distinct()).df
    near = Saved(tiles.alike(found.df, folds(m), least, contained=True))
    found.drop()
    exact = verified(samples, "text", near.df).filter(F.col("both") >= least * F.col("n_a") - 1e-6).select("a", "b")
    rows = Saved(m.select("id", "cls").join(sides(samples, requests).select(F.col("sample_id").alias("id"), "side"), "id").filter("side is not null").distinct()).df
    own = rows.filter("side = 0").select(F.col("id").alias("evaluation_id"), F.col("cls").alias("a"))
    training = rows.filter("side = 1").select(F.col("id").alias("training_id"), F.col("cls").alias("b"))
    return exact.join(own, "a").join(training, "b").select("evaluation_id", "training_id")


def digests(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """(sample_id, split, source, side, digest bigint, size int): the chunks of the records of either side."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, digest, size = _distinct(*chunks(words(b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(digest.view(np.int64)), pa.array(size, pa.int32())], ["sample_id", "digest", "size"])

    cut = samples.select(F.col("sample_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(part, "sample_id bigint, digest bigint, size int")
    return cut.join(sides(samples, requests).filter("side is not null"), "sample_id")


def fractions(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """(sample_id, split, source, words, overlap): for each evaluation record with enough words, the share of its words
    in chunks that stand in training records too."""
    d = Saved(digests(samples, requests)).df
    known = d.filter("side = 1").select("digest").distinct().withColumn("known", F.lit(1))
    own = d.filter("side = 0").join(known, "digest", "left")
    return (
        own.groupBy("sample_id", "split", "source")
        .agg(F.sum("size").alias("words"), F.sum(F.when(F.col("known") == 1, F.col("size")).otherwise(0)).alias("shared"))
        .select("sample_id", "split", "source", "words", (F.col("shared") / F.col("words")).alias("overlap"))
    )


def _evaluation_rows(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """(sample_id, split, source) of the evaluation records, the split in normal spelling."""
    split = F.lower(F.regexp_replace(F.regexp_replace("split", r"\[[^\]]*\]", ""), r"(?U)^\s+|\s+$", "")).alias("split")
    return sides(samples, requests).filter("side = 0").select("sample_id", split, "source")


def report(samples: DataFrame, requests: DataFrame, least: float = 0.7) -> DataFrame:
    """(split, source, records, overlapping): of the evaluation records of each split and source, those with a partner."""
    found = pairs(samples, requests, least).select(F.col("evaluation_id").alias("sample_id")).distinct().withColumn("found", F.lit(1))
    rows = _evaluation_rows(samples, requests).join(found, "sample_id", "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("found").alias("overlapping"))


def shares(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """(split, source, records, mean_overlap, whole): of the evaluation records with enough words of each split and source,
    the mean share of words in chunks that training records have too, and how many stand there wholly."""
    rows = _evaluation_rows(samples, requests).join(fractions(samples, requests).select("sample_id", "overlap"), "sample_id")
    return rows.groupBy("split", "source").agg(F.count("*").alias("records"), F.avg("overlap").alias("mean_overlap"), F.count_if(F.col("overlap") >= 1).alias("whole"))
