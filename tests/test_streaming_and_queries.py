import __spark_entry__

from gaugeframe.streaming import running_profile


def test_running_profile(spark, tmp_path):
    data = spark.createDataFrame([("You idiot, so stupid.",), (None,), ("tiny",)], "text string")
    data.write.parquet(str(tmp_path / "in"))
    q = running_profile(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("totals").first()
    assert tuple(r) == (3, 1, 1, 5, 3, 1)


def test_entry_points():
    names = __spark_entry__.queries()
    assert "reading_ease" in names and set(__spark_entry__.oracle_sql()) <= set(names)
