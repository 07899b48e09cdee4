"""Connected components of an edge table, by alternating large-star and small-star steps.

(Kiveris and others, Connected Components in MapReduce and Beyond, SoCC 2014.) Each step is one aggregation and one
join over the edges; each round writes its edges below the shared checkpoint folder. Edges and components stay on the
executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import Saved, freed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each u's neighbours, larger ones only or smaller ones, are tied to the least of u and its neighbours."""
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if large:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the same components, those of a partition drawn together: each node is tied to the least one that it
    reaches within the partition, so that fewer edges and shorter ways are left for the rounds."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ends = np.stack([c.to_numpy() for c in b.columns])
            node, at = np.unique(ends, return_inverse=True)
            u, v = at.reshape(2, -1)
            low = np.arange(len(node))
            while True:
                was = low
                least = np.minimum(low[u], low[v])
                low = low.copy()
                np.minimum.at(low, u, least)
                np.minimum.at(low, v, least)
                low = np.minimum(low, low[low])
                if (low == was).all():
                    break
            tied = low != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[low[tied]])], ["u", "v"])

    return edges.mapInArrow(part, "u bigint, v bigint")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a bigint, b bigint): (node, root) of every node, root being the component's least node."""
    now = Saved(_contracted(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")).distinct())
    was = None
    for _ in range(most_rounds):
        done = Saved(_star(_star(now.df, large=True), large=False))
        now.drop()
        now = done
        with freed(now.spark):
            mark = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == was:
            break
        was = mark
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
