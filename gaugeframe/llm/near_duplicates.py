"""Problem 4: records that differ by small edits, as pairs and as groups.

Method: tiled exact comparison with exclusive-or and bit counts (``tiles``), skipping what lies beyond the radius by
population count. Which tiles there are comes from a lossless prefix filter: each class of equal triple sets enters the
lists of the rarest triples of which any partner of the given similarity must share one, and a list's tiles are cut where
population counts lie out of reach. A list's entries bring their bit vectors, so a pair is counted where it meets, and only
survivors are written; lists are made in ``TURNS`` turns, so that not all of them lie on disk at once. Survivors are
checked exactly on their triple sets. Nothing is sampled or capped, and no pair is lost.

Cases: null, empty and short texts (under 12 words) are in no pair; copies are one class and are expanded into pairs
only in ``pairs``; repeated rows (the same id twice) count once. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import tiles
from gaugeframe.llm.classes import class_of, members, of_first, rarity, verified
from gaugeframe.llm.graph import components
from gaugeframe.sources.scratch import Saved, save


TURNS = 3  # shares of the lists, each made and compared by itself


def class_pairs(df: DataFrame, text_col: str, least: float) -> DataFrame:
    """(a, b, n_a, n_b, both): all pairs of different classes with a Jaccard similarity of at least ``least``."""
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    counted = rarity(texts)
    level = df.sparkSession.sparkContext.broadcast(counted)

    def entries(b: pa.RecordBatch) -> tiles.Entries:
        doc, t, cls = class_of(b.column(0).to_pylist())
        doc, t = of_first(doc, t, cls)
        n = np.bincount(doc, minlength=len(cls))
        fold = tiles.folded(doc, t, len(cls))
        v = level.value.of(t)
        order, place = tiles.rarest(doc, t, v)
        doc, t, v = doc[order], t[order], v[order]
        keep = tiles.prefix(n[doc], place, least) & (v > 0)  # what occurs once has no partner
        doc, t, v, place = doc[keep], t[keep], v[keep], place[keep]
        return tiles.Entries(cls[doc], t, n[doc], tiles.similar_reach(n[doc], place, least), level.value.often(v), fold[doc])

    buckets = TURNS * tiles.buckets_for(int(counted.total * (1 - least)) + 1)
    found = [Saved(tiles.compare(tiles.emit(texts, entries, buckets, k, TURNS), least=least).distinct()) for k in range(TURNS)]
    near = Saved(reduce(DataFrame.union, [x.df for x in found]).distinct())
    for x in found:
        x.drop()
    exact = verified(df, text_col, near.df)
    return exact.filter(F.col("both") * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-6)


def pairs(df: DataFrame, id_col: str, text_col: str, least: float = 0.5) -> DataFrame:
    """(id_a, id_b; a < b): all pairs of rows, copies included."""
    m = Saved(members(df, id_col, text_col).select("id", "cls").distinct()).df
    found = class_pairs(df, text_col, least)
    a, b = (m.select(F.col("id").alias(f"id_{x}"), F.col("cls").alias(x)) for x in "ab")
    across = found.select("a", "b").join(a, "a").join(b, "b").select("id_a", "id_b")
    within = a.withColumnRenamed("a", "cls").join(b.withColumnRenamed("b", "cls"), "cls").filter("id_a < id_b").select("id_a", "id_b")
    return across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(within)


def groups(df: DataFrame, id_col: str, text_col: str, least: float = 0.5) -> DataFrame:
    """(id, group_id, group_size, links): one row for each row in a group of two or more; group_id is the smallest id.
    links counts the different texts that are linked to the row's text directly."""
    m = Saved(members(df, id_col, text_col).select("id", "cls").distinct()).df
    edges = save(class_pairs(df, text_col, least).select("a", "b"))
    links = edges.select("a").union(edges.select(F.col("b"))).groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("links"))
    label = components(edges)
    rows = m.select("id", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(links, "cls", "left")
    rows = save(rows.select("id", "root", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")))
    size = rows.groupBy("root").agg(F.count("*").alias("group_size"), F.min("id").alias("group_id")).filter("group_size > 1")
    return rows.join(size, "root").select("id", "group_id", "group_size", "links")
