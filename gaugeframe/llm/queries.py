"""Registered queries of this subpackage; their SQL is in ``sql``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import abuse, clusters, encoding, hidden_copies, lookalikes, near_duplicates, packing, split_overlap
from gaugeframe.llm.sql import SQL
from gaugeframe.sources.scratch import save


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_overlap.pairs(_table(spark, sf_dir, "samples"), _table(spark, sf_dir, "analyze_requests"), 0.7)
    a, b = F.col("evaluation_id"), F.col("training_id")
    return found.select(F.least(a, b).alias("sample_id_a"), F.greatest(a, b).alias("sample_id_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.report(_table(spark, sf_dir, "samples"), _table(spark, sf_dir, "analyze_requests"), 0.7)


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.shares(_table(spark, sf_dir, "samples"), _table(spark, sf_dir, "analyze_requests"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text", "label")
    return hidden_copies.found(samples, "sample_id", "text", "label").withColumnRenamed("id", "sample_id")


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text", "label")
    return hidden_copies.collapsed(samples, "sample_id", "text", "label").withColumnRenamed("id", "sample_id")


ABUSIVE = 0.85  # expected severity


def _severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text")
    return abuse.scores(samples, abuse.fit(samples, _table(spark, sf_dir, "moderation_labels")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _severities(spark, sf_dir).filter(F.col("severity") >= ABUSIVE).select(F.col("id").alias("sample_id"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _severities(spark, sf_dir).withColumnRenamed("id", "sample_id")


def p3_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text", "source")
    return abuse.source_rates(samples, abuse.fit(samples, _table(spark, sf_dir, "moderation_labels")), ABUSIVE)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text")
    return near_duplicates.pairs(samples, "sample_id", "text", 0.5).select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text")
    return near_duplicates.groups(samples, "sample_id", "text", 0.5).withColumnRenamed("id", "sample_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text")
    return clusters.linked(samples, "sample_id", "text", 0.2, 10).withColumnRenamed("id", "sample_id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text")
    return clusters.clusters(samples, "sample_id", "text").withColumnRenamed("id", "sample_id")


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture component of every sample."""
    samples = _table(spark, sf_dir, "samples").select("sample_id", "text")
    return clusters.assigned(samples, "sample_id", "text").withColumnRenamed("id", "sample_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.decode(p6_ids(spark, sf_dir), "doc_id", "ids").withColumnRenamed("id", "doc_id")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, doc_id, piece, start, size, container) for every capacity of container_specs."""
    sized = save(p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("tokens")))
    specs = _table(spark, sf_dir, "container_specs").filter("capacity_tokens > 0").orderBy("spec_id").collect()  # a few rows: one plan each
    parts = [packing.pack(sized, "doc_id", "tokens", s.capacity_tokens).select(F.lit(s.spec_id).cast("bigint").alias("spec_id"), F.col("id").alias("doc_id"), "piece", "start", "size", "container") for s in specs]
    return reduce(DataFrame.unionByName, parts)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, capacity, items, tokens, containers, least_containers): how full the containers of each capacity are."""
    rows = save(p7_packing(spark, sf_dir))
    specs = _table(spark, sf_dir, "container_specs").select("spec_id", F.col("capacity_tokens").alias("capacity"))
    got = rows.groupBy("spec_id").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"), (F.max("container") + 1).alias("containers"))
    return got.join(specs, "spec_id").select("spec_id", "capacity", "items", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookalikes.pairs(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.canonical(_table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_report, p1_shares, p2_found, p2_collapsed, p3_found, p3_scores, p3_source_rates, p4_found, p4_groups, p5_found, p5_clusters, p5_members, p6_ids, p6_decoded, p7_packing, p7_fill, p8_found, p8_forms)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
