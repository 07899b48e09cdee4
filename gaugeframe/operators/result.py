"""What a check returns, and how flags of several checks are merged."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "_row_id"
FLAG_SCHEMA = "row_id bigint, flag string"
#: Flags that make a row critical.
CRITICAL_FLAGS = ("empty_text", "toxic_text", "possible_leakage")


@dataclass
class CheckResult:
    metrics: dict[str, Any]
    issues: list[dict[str, Any]] = field(default_factory=list)
    flags: DataFrame | None = None


def issue(severity: str, code: str, message: str, recommendation: str, **more: Any) -> dict[str, Any]:
    return {"severity": severity, "code": code, "message": message, "recommendation": recommendation, **more}


def missing_text(text_col: str) -> CheckResult:
    return CheckResult({}, [issue("critical", "missing_text_column", f"There is no text column named '{text_col}'.", "Name the column that holds the text, or map it to 'text'.")])


def not_run(reason: str, **more: Any) -> CheckResult:
    return CheckResult({"ran": False, "reason": reason, **more})


def flagged(df: DataFrame, id_col: str, flag: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("row_id"), F.lit(flag).alias("flag"))


def union_flags(flags: list[DataFrame | None], spark: SparkSession) -> DataFrame:
    some = [f for f in flags if f is not None]
    return reduce(DataFrame.unionByName, some) if some else spark.createDataFrame([], FLAG_SCHEMA)


def merge_flags(flags: DataFrame) -> DataFrame:
    """(row_id, flags array<string>, severity): each row's different flags in order."""
    merged = flags.groupBy("row_id").agg(F.sort_array(F.collect_set("flag")).alias("flags"))
    critical = F.arrays_overlap("flags", F.array(*map(F.lit, CRITICAL_FLAGS)))
    return merged.withColumn("severity", F.when(critical, F.lit("critical")).otherwise(F.lit("warning")))
