"""spark-submit -m gaugeframe (--csv PATH | --dataset NAME) [--out report.json] ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gaugeframe.plans.api import analyze_csv, analyze_dataset
from gaugeframe.sources.readers import write_json


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gaugeframe", description="A quality report of a dataset, as JSON.")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--csv", help="a CSV file")
    which.add_argument("--dataset", "--hf", help="a table, or a parquet, JSON, ORC or CSV path")
    for name, default in (("split", "train"), ("subset", None), ("text-col", None), ("label-col", None), ("flags-out", None)):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--max-rows", type=int, help="the first rows only, if above 0")
    p.add_argument("--max-semantic-samples", type=int, default=2000, help="rows looked at for near-duplicates; 0: all")
    p.add_argument("--no-hf-models", action="store_true", help="hashed vectors and heuristic toxicity; the command line has no others, so this changes nothing")
    p.add_argument("--single-line", action="store_true", help="the CSV file has no line breaks in values, and may be read in parallel")
    p.add_argument("--out", default="reports/report.json")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("gaugeframe").getOrCreate()
    options = {"max_semantic_samples": a.max_semantic_samples or None}
    if a.csv:
        report = analyze_csv(spark, a.csv, a.text_col, a.label_col, multiline=not a.single_line, **options)
    else:
        report = analyze_dataset(spark, a.dataset, a.split, a.subset, a.text_col, a.label_col, a.max_rows, **options)
    write_json(a.out, report.data)
    if a.flags_out:
        report.flags.write.mode("overwrite").parquet(a.flags_out)
    print(f"Report written to {a.out}")


if __name__ == "__main__":
    main()
