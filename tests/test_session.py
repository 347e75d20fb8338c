"""Shared scratch tables and streams."""

import os

from pyspark.sql import functions as F

from lumenfold import session
from lumenfold.streaming import accumulate


def test_tables_are_written_and_deleted(spark):
    df = session.materialize(spark.range(10), "test")
    path = df._lumenfold_path.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 10 and path.startswith(session.shared_dir(spark).removeprefix("file://"))
    session.discard(df, spark.range(1))
    assert not os.path.exists(path)
    kept = session.materialize(spark.range(3), "test")._lumenfold_path.removeprefix("file://")
    session.clear_scratch(spark)
    assert not os.path.exists(kept)


def test_a_batch_run_again_is_not_added_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 3.0], 1.0), (1, [3.0, 5.0], 1.0)], "class_no int, pixels array<double>, weight double")
    for _ in range(2):
        accumulate.batch_sums(df).write.mode("overwrite").parquet(str(tmp_path / "sums" / "batch=0"))
    got = accumulate.class_averages(spark, str(tmp_path / "sums"), alpha=0.0).orderBy("p").collect()
    assert [r.average for r in got] == [2.0, 4.0]


def test_windows_drop_late_rows(spark, tmp_path):
    batches = [
        [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 05:00:00", "b")],
        [("2024-01-01 00:20:00", "a"), ("2024-01-01 09:00:00", "b")],
        [("2024-01-01 12:00:00", "b")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
        found = accumulate.windowed_counts(stream, "ts", "k").select("window.start", "k", "n")
        sink = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("k = 'a'").collect()
    assert [r.n for r in got] == [2]
