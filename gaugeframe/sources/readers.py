"""Datasets from files, bytes, tables or DataFrames, with their text and label columns in standard names."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.sources.roles import rename, resolve
from gaugeframe.sources.scratch import folder

#: Spellings that mean null in a CSV file, as common readers take them.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass
class Dataset:
    df: DataFrame
    text_col: str
    label_col: str | None
    meta: dict[str, Any] = field(default_factory=dict)


def standard(df: DataFrame, text_col: str | None = None, label_col: str | None = None, **meta: Any) -> Dataset:
    """The roles resolved and renamed to ``text`` and ``label``."""
    text, label = resolve(df, text_col, label_col)
    renamed, new = rename(df, text, label)
    return Dataset(renamed, "text", "label" if label else None, {"original_columns": list(df.columns), "renamed_columns": new, **meta})


def read_csv_frame(spark: SparkSession, path: str, encoding: str | None = None, multiline: bool = True) -> DataFrame:
    """A CSV file as a table: null spellings are nulled before the types are inferred, so "NA" makes no number a string.

    Column types are the narrowest of bigint, double, boolean and string that every value fits, found in one pass. A file
    whose quoted values hold line breaks can't be split over tasks; multiline False reads large files without such breaks
    in parallel."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, quote='"', escape='"', encoding=encoding or "UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    kinds = {"bigint": r"^\s*[+-]?\d{1,18}\s*$", "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", "boolean": r"^(True|False|true|false|TRUE|FALSE)$"}
    if not clean.columns:
        return clean
    row = clean.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(p)), F.lit(False)).alias(f"{k}{i}") for i, c in enumerate(clean.columns) for k, p in kinds.items()]).first()
    kind = [next((k for k in kinds if row[f"{k}{i}"]), "string") for i in range(len(clean.columns))]
    return clean.select(*[(F.col(f"`{c}`") if k == "string" else F.trim(F.col(f"`{c}`")).cast(k)).alias(c) for c, k in zip(clean.columns, kind)])


def load_csv(spark: SparkSession, path: str, text_col: str | None = None, label_col: str | None = None, encoding: str | None = None, multiline: bool = True) -> Dataset:
    return standard(read_csv_frame(spark, path, encoding, multiline), text_col, label_col)


def load_csv_bytes(spark: SparkSession, data: bytes, filename: str | None = None, text_col: str | None = None, label_col: str | None = None, encoding: str | None = None) -> Dataset:
    """An uploaded file: written to the shared scratch folder, then read as any CSV (quoted line breaks are kept)."""
    path = f"{folder(spark)}/gaugeframe/{uuid.uuid4().hex}.csv"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    got = load_csv(spark, path, text_col, label_col, encoding)
    if filename:
        got.meta["filename"] = filename
    return got


DEFAULT_SPLIT = "train"
ENDINGS = ("", ".parquet", ".json", ".jsonl", ".orc", ".csv")


def _inner(spark: SparkSession, path: str, part: str) -> str | None:
    """The subfolder or file of a folder, on any file system, that is named ``part``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at(path)) or not files.getFileStatus(at(path)).isDirectory():
        return None
    return next((x for x in (f"{path.rstrip('/')}/{part}{e}" for e in ENDINGS) if files.exists(at(x))), None)


def load_dataset(spark: SparkSession, name: str | DataFrame, split: str | None = DEFAULT_SPLIT, subset: str | None = None, text_col: str | None = None, label_col: str | None = None, max_rows: int | None = None) -> Dataset:
    """A DataFrame, a table, or a parquet, JSON, ORC or CSV path. Of a folder, the subfolder or file named by the subset and
    then that named by the split is taken. A subset, or a split other than the default one, that can't be found there is a
    ValueError, never ignored. ``max_rows`` (if above 0) takes the first rows in the order of the source."""
    asked = [("subset", subset), ("split", split)]
    path = name
    for what, part in asked:
        if part and not (what == "split" and part == DEFAULT_SPLIT and isinstance(name, DataFrame)):
            folder_like = isinstance(name, str) and ("/" in name or os.path.splitext(name)[1])
            inner = _inner(spark, path, part) if folder_like else None
            if inner is None and not (what == "split" and part == DEFAULT_SPLIT):
                raise ValueError(f"there is no {what} '{part}' in this dataset")
            path = inner or path
    if isinstance(path, DataFrame):
        df = path
    else:
        ending = os.path.splitext(path)[1].lower()
        if ending == ".csv":
            df = read_csv_frame(spark, path)
        elif ending in (".json", ".jsonl"):
            df = spark.read.json(path)
        elif ending == ".orc":
            df = spark.read.orc(path)
        elif "/" in path or ending:
            df = spark.read.parquet(path)
        else:
            df = spark.table(path)
    if max_rows is not None and max_rows > 0:
        df = df.limit(max_rows)
    return standard(df, text_col, label_col, dataset=name if isinstance(name, str) else None, subset=subset, split=split)


def write_json(path: str, payload: Any) -> None:
    """Indented UTF-8 JSON on the driver; folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, default=str)
