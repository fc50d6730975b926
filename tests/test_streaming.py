"""Streams give what their batch twins give, and go on where they stopped."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialforge.operators import prefix
from trialforge.streaming import microbatch as M


def requests(spark):
    return spark.createDataFrame([("a", i, 0.1 * i, 10.0) for i in range(6)] + [("b", 9, 0.0, 500.0)], "key string, request_id long, at double, tokens double")


def test_rate_limits(spark):
    rows = {r["request_id"]: r for r in M.rate_limited(requests(spark), M.Limits(rpm=3, tpm=1000)).collect()}
    assert rows[0]["waited"] == rows[2]["waited"] == 0 and rows[9]["waited"] == 0
    assert rows[3]["granted_at"] == pytest.approx(20) and rows[5]["granted_at"] == pytest.approx(60)
    tight = {r["request_id"]: r for r in M.rate_limited(requests(spark), M.Limits(rpm=100, tpm=20)).collect()}
    assert tight[2]["granted_at"] == pytest.approx(30)
    assert M.Limits(500, 10_000).scaled(1000) == M.Limits(1000, 20_000)


@pytest.mark.parametrize("limits", [M.Limits(2, 100), M.Limits(0.5, 40), M.Limits(30, 900)])
def test_rate_limits_by_ranges(spark, monkeypatch, limits):
    """Keys cut into ranges of time wait as their fold says, in batches of a few rows; no worker gets a key as a whole."""
    monkeypatch.setattr(prefix, "LEAST", 100)
    rng = random.Random(5)
    rows = [(k, i, round(rng.uniform(0, 4000 * n / 100), rng.choice([0, 3])), float(rng.choice([1, 20, 50, 300]))) for k, n in (("a", 300), (None, 200), ("b", 101), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, request_id long, at double, tokens double").repartition(3)
    limited = M.rate_limited(df, limits)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r["key"], r["request_id"]): r["granted_at"] for r in limited.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("a", "b", "c", None):
        own = pd.DataFrame(sorted((r[2], r[1], r[3]) for r in rows if r[0] == key), columns=["at", "request_id", "tokens"])
        for i, granted in zip(own["request_id"], M._waits(limits, None, own)[0], strict=True):
            assert got.pop((key, i)) == pytest.approx(granted, abs=1e-6)
    assert not got
    plan = limited._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("MapInPandas passages") == 1 and plan.count("MapInPandas fold") == 1
    assert M.rate_limited(df.limit(0), limits).count() == 0


def test_rate_limit_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    schema = requests(spark).schema
    got = []

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        limited = M.rate_limited_stream(stream, M.Limits(rpm=3, tpm=1000))
        q = limited.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    requests(spark).where("request_id < 3 or request_id = 9").write.parquet(source)
    run()
    requests(spark).where("request_id >= 3 and request_id < 9").write.mode("append").parquet(source)
    run()
    want = {r["request_id"]: r["granted_at"] for r in M.rate_limited(requests(spark), M.Limits(rpm=3, tpm=1000)).collect()}
    assert {r["request_id"]: pytest.approx(r["granted_at"]) for r in got} == want


def test_windowed_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    counts = M.windowed_counts(stream, "event_type", "1 hour", "1 day")
    q = counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r[0], r[1]): r[2] for r in spark.table("windowed").collect()}
    assert got == {(r[0], r[1]): r[2] for r in M.windowed_counts(events, "event_type", "1 hour", "1 day").collect()}


def test_incremental(spark, tmp_path):
    seen = []
    schema = "k long"
    spark.range(3).select(F.col("id").alias("k")).write.parquet(f"file://{tmp_path}/in")
    for more in (0, 2):
        if more:
            spark.range(10, 12).select(F.col("id").alias("k")).write.mode("append").parquet(f"file://{tmp_path}/in")
        M.run_available(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), lambda df, i: seen.append(sorted(r["k"] for r in df.collect())), f"file://{tmp_path}/ck")
    assert seen == [[0, 1, 2], [10, 11]]


def test_handler_and_flush(spark):
    rows = spark.createDataFrame([("a", i, i * 1000) for i in range(5)], "key string, request_id long, ts_us long")
    batched = M.flushes(rows, "key", 3000, 2)
    assert sorted(r["size"] for r in M.flush_log(batched, "key").collect()) == [1, 2, 2]
    data = batched.select(F.col("key").alias("text"), "key", "slot", "batch", "request_id")
    done = M.handled(data, lambda xs: [x.upper() for x in xs], ["text", "request_id"]).collect()
    assert {r["result"] for r in done} == {"A"} and all(r["error"] is None for r in done)
    short = M.handled(data, lambda xs: xs[:1], ["text", "request_id"]).collect()
    assert sum(r["error"] is not None for r in short) == 4
    stats = M.flush_stats(M.flush_log(batched, "key"), "key").first()
    assert (stats["flushes"], stats["requests"], stats["batched_pct"]) == (3, 5, 80.0)


def test_group(spark):
    group = M.Group(spark)

    class Fake:
        def stop(self):
            pass

    group.start("a", Fake)
    group.start("b", Fake)
    with pytest.raises(ValueError):
        group.start("a", Fake)
    assert group.stop() == ["b", "a"]


def test_retries():
    """Delays are drawn up to ends that double; only listed exceptions are tried again."""
    drawn, slept = [], []

    def failing(times, error=OSError):
        left = [times]

        def call():
            left[0] -= 1
            if left[0] >= 0:
                raise error("no")
            return ["x"]

        return call

    def go(call):
        drawn.clear(), slept.clear()
        return M.retried(call, 3, 0.5, (OSError,), lambda a, b: drawn.append((a, b)) or b / 2, slept.append)

    assert go(failing(0)) == (["x"], None, 1) and slept == []
    assert go(failing(2)) == (["x"], None, 3) and drawn == [(0.0, 0.5), (0.0, 1.0)] and slept == [0.25, 0.5]
    result, error, attempts = go(failing(9))
    assert result is None and isinstance(error, OSError) and attempts == 4 and len(slept) == 3
    result, error, attempts = go(failing(1, KeyError))
    assert result is None and isinstance(error, KeyError) and attempts == 1 and slept == []


def test_handled_retries(spark, tmp_path):
    data = spark.createDataFrame([("a", 0, 0, 1, "x"), ("a", 0, 0, 2, "y"), ("b", 0, 0, 3, "z")], "key string, slot long, batch long, request_id long, text string")
    folder = str(tmp_path)

    def flaky(xs):
        import os

        mark = f"{folder}/{xs[0]}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        return [x.upper() for x in xs]

    rows = M.handled(data, flaky, ["text", "request_id"], retries=1, base=0.01, retryable=(OSError,)).collect()
    assert {(r["request_id"], r["result"], r["error"], r["attempts"]) for r in rows} == {(1, "X", None, 2), (2, "Y", None, 2), (3, "Z", None, 2)}
