from pyspark.sql import functions as F

from hushgrid.sources.scratch import scratch
from hushgrid.streaming import tokens


def rows_of(spark, out):
    return sorted((r.session, r.kind, r.normalized, r.n) for r in spark.read.schema(tokens.OUT).parquet(out).collect())


def test_state_lives_across_runs_and_is_cleared(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), scratch(spark, "out"), scratch(spark, "state")
    schema = "session long, seq long, kind string, normalized string, clear boolean"
    for batch in (
        [(1, 1, "phone", "a", False), (1, 2, "phone", "b", False), (1, 3, "phone", "a", False), (2, 1, "email", "x", False)],
        [(1, 4, "phone", "a", False), (1, 5, "phone", "c", False)],
        [(1, 6, None, None, True), (1, 7, "phone", "c", False)],
    ):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        tokens.run_once(tokens.stream_tokens(stream), out, state)
    assert rows_of(spark, out) == [(1, "phone", "a", 1), (1, "phone", "b", 2), (1, "phone", "c", 1), (1, "phone", "c", 3), (2, "email", "x", 1)]


def test_latest_drafts(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x" * 6000)], "s int, at int, text string")
    assert [(r.s, r.text) for r in tokens.latest_drafts(df, "s", "at", "text").collect()] == [(1, "new")]


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([("2030-01-01 00:10:00", "a"), ("2030-01-01 00:50:00", "a"), ("2030-01-01 01:10:00", "a")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    out = scratch(spark, "windows")
    tokens.run_once(tokens.windowed_counts(stream, "ts", "1 hour", "0 seconds"), out, scratch(spark, "state"))
    assert [r.n for r in spark.read.parquet(out).orderBy("start").collect()][:1] == [2]
