import json

import pytest
from pyspark.sql import functions as F

from gaugeframe.__main__ import main
from gaugeframe.operators.prepare import prepare, with_row_id
from gaugeframe.sources import readers, roles


def test_names():
    assert roles.normal_name(" My Text! ") == "my_text"
    assert roles.is_artifact("Unnamed: 0") and roles.is_artifact("_index") and roles.is_artifact("__index_level_0__")
    assert not roles.is_artifact("indexed")


def test_csv_roles(spark, tmp_path):
    p = tmp_path / "calls.csv"
    p.write_text('minutes,Review,Target\n7,"the line was ""busy"",\nthen dead",bad\nNA,quick help,good\n')
    got = readers.load_csv(spark, str(p))
    assert (got.text_col, got.label_col) == ("text", "label")
    assert got.meta["renamed_columns"] == {"Review": "text", "Target": "label"}
    rows = {r.label: r for r in got.df.collect()}
    assert rows["bad"].text == 'the line was "busy",\nthen dead' and rows["good"].minutes is None and dict(got.df.dtypes)["minutes"] == "bigint"
    q = tmp_path / "flat.csv"
    q.write_text("minutes,Review,Target\n7,short,bad\n8,long,good\n")
    assert readers.load_csv(spark, str(q), multiline=False).df.count() == 2
    again = readers.load_csv_bytes(spark, p.read_bytes(), "up.csv")
    assert again.meta["filename"] == "up.csv" and again.df.count() == 2


def test_text_by_score(spark):
    df = spark.createDataFrame([("ab", "a longer piece of writing", 1)], "code string, notes string, n int")
    assert roles.resolve(df) == ("notes", None)
    with pytest.raises(ValueError):
        roles.resolve(df.select("n"))
    with pytest.raises(ValueError):
        roles.resolve(df, text_col="nope")


def test_rename_collision(spark):
    df = spark.createDataFrame([("a", "b")], "text string, body string")
    with pytest.raises(ValueError):
        readers.standard(df, text_col="body")


def test_business_slots():
    assert roles.business_slots(["city", "locality", "area", "rent"]) == ["city", "locality", "area", "rent"]
    assert roles.business_slots(["parent_id", "x"]) == ["parent_id"]
    assert roles.category_column(["id", "home_state"]) == "home_state"


def test_row_ids_follow_partitions(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("cast(id as string) as text")
    got = with_row_id(df).collect()
    assert sorted(r._row_id for r in got) == list(range(1000))
    assert all(int(r.text) == r._row_id for r in got)
    assert with_row_id(df.limit(0)).count() == 0


def test_prepare(spark):
    df = spark.createDataFrame([("  a ", " x "), (None, "y"), (" ", None), ("b", " ")], "text string, label string").coalesce(1)
    got = prepare(df)
    assert got.meta == {"rows_before": 4, "rows_after": 2, "dropped_empty_text": 2}
    assert sorted((r._row_id, r.text, r.label) for r in got.df.collect()) == [(0, "a", "x"), (3, "b", None)]
    assert sorted(r.row_id for r in got.dropped.collect()) == [1, 2]
    with pytest.raises(ValueError):
        prepare(df, "nope")


def test_command_line(spark, tmp_path):
    p = tmp_path / "notes.csv"
    p.write_text("note,kind\nthe tap drips again,water\nthe lamp flickers,power\nthe tap drips again,water\n")
    out = tmp_path / "deep" / "report.json"
    main(["--csv", str(p), "--text-col", "note", "--label-col", "kind", "--single-line", "--no-hf-models", "--out", str(out)])
    got = json.loads(out.read_text())
    assert got["report_version"] == 1 and got["modules"]["duplicates"]["exact_duplicate_rows"] == 2


def test_saved_tables_leave_no_shuffle_files(spark):
    from gaugeframe.sources import scratch

    was = spark.conf.get(scratch.FREE)
    spark.conf.set(scratch.FREE, "false")
    try:
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
        assert scratch.save(df).count() == 7 and spark.conf.get(scratch.FREE) == "false"
    finally:
        spark.conf.set(scratch.FREE, was)


def test_splits_are_found_or_refused(spark, tmp_path):
    for name in ("train", "test"):
        spark.createDataFrame([(name, "x")], "text string, label string").write.parquet(f"file://{tmp_path}/de/{name}")
    at = f"file://{tmp_path}"
    assert readers.load_dataset(spark, at, "test", "de").df.first().text == "test"
    assert readers.load_dataset(spark, f"{at}/de/train").df.first().text == "train"
    for split, subset in (("dev", "de"), ("train", "fr")):
        with pytest.raises(ValueError, match="there is no"):
            readers.load_dataset(spark, at, split, subset)
    df = spark.createDataFrame([("a", "b")], "text string, label string")
    assert readers.load_dataset(spark, df).df.count() == 1
    with pytest.raises(ValueError):
        readers.load_dataset(spark, df, "test")


def test_medians_by_brackets(spark):
    import numpy as np

    from gaugeframe.operators.domain import medians

    rng = np.random.default_rng(4)
    x, y = rng.standard_normal(5001).tolist(), rng.integers(0, 5, 5000).astype(float).tolist() + [None]
    df = spark.createDataFrame([(float(a), b, None) for a, b in zip(x, y)], "x double, y double, z double").repartition(3)
    want = {"x": float(np.median(x)), "y": float(np.median(y[:-1])), "z": 0.0}
    assert medians(df, ["x", "y", "z"]) == want == medians(df, ["x", "y", "z"], most=20)
    assert medians(df.limit(0), ["x"]) == {"x": 0.0}
