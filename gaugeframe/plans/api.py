"""Entry points: a report for a CSV file, an upload, a dataset or a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.operators.prepare import prepare
from gaugeframe.plans.report import Report, generate
from gaugeframe.sources.readers import Dataset, load_csv, load_csv_bytes, load_dataset


def analyze(data: Dataset, source: dict[str, Any], **options: Any) -> Report:
    ready = prepare(data.df, data.text_col, data.label_col)
    report = generate(ready.df, data.text_col, data.label_col, **options)
    report.data["meta"] |= {"input": source, "loader": data.meta, "preprocess": ready.meta}
    return report


def analyze_csv(spark: SparkSession, path: str, text_col: str | None = None, label_col: str | None = None, encoding: str | None = None, multiline: bool = True, **options: Any) -> Report:
    return analyze(load_csv(spark, path, text_col, label_col, encoding, multiline), {"type": "csv", "path": path}, **options)


def analyze_csv_bytes(spark: SparkSession, data: bytes, filename: str | None = None, text_col: str | None = None, label_col: str | None = None, encoding: str | None = None, **options: Any) -> Report:
    return analyze(load_csv_bytes(spark, data, filename, text_col, label_col, encoding), {"type": "csv_upload", "filename": filename}, **options)


def analyze_dataset(spark: SparkSession, name: str | DataFrame, split: str | None = "train", subset: str | None = None, text_col: str | None = None, label_col: str | None = None, max_rows: int | None = None, **options: Any) -> Report:
    source = {"type": "dataset", "dataset": name if isinstance(name, str) else None, "subset": subset, "split": split}
    return analyze(load_dataset(spark, name, split, subset, text_col, label_col, max_rows), source, **options)
