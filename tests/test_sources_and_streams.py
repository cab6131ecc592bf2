import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaywave.sources import recordings as r
from quaywave.streaming import hopping


def test_cnt_ranges_channels_and_rate(spark, tmp_path):
    data = np.arange(200 * 4).reshape(200, 4)
    (tmp_path / "3_2.cnt").write_bytes(r.encode_cnt(data, ["FP1", "M1", "CZ", "VEO"], 1000))
    (tmp_path / "notes.cnt").write_bytes(b"no key in the name")
    rows = r.read_cnt(spark, str(tmp_path), [(0, 10, 20), (1, 50, 55)], rate=1000).orderBy("trial_idx", "channel").collect()
    assert [(x["subject"], x["session"], x["trial_idx"], x["channel_name"]) for x in rows] == [(3, 2, t, c) for t in (0, 1) for c in ("FP1", "CZ")]
    assert rows[1]["samples"] == data[10:20, 2].tolist()
    with pytest.raises(Exception, match="not 500"):
        r.read_cnt(spark, str(tmp_path), rate=500).collect()


def test_npy_collection_and_discovery(spark, tmp_path):
    for key, shape in (("1_1", (2, 3, 8)), ("1_2", (1, 3, 8))):
        np.save(tmp_path / f"{key}_raw.npy", np.arange(np.prod(shape), dtype=np.float32).reshape(shape))
    (tmp_path / "1_1.parquet").write_bytes(b"x")
    rows = r.read_npy(spark, str(tmp_path), decimate=3).orderBy("session", "row_idx", "channel").collect()
    assert len(rows) == 9 and rows[0]["samples"] == [0.0, 3.0, 6.0]
    found = r.discover(spark, str(tmp_path), "_raw.npy", ".parquet").collect()
    assert [(x["subject"], x["session"]) for x in found] == [(1, 1)]
    assert r.skipped(spark, str(tmp_path), ".npy").count() == 1


def test_append_columns_is_idempotent(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    one = r.append_columns(spark, str(tmp_path / "a"), str(tmp_path / "b"), {"x": F.col("id") * 2})
    two = r.append_columns(spark, str(tmp_path / "b"), str(tmp_path / "c"), {"x": F.lit(-1)})
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    r.write_results(spark.createDataFrame([("svm", 1, 1, 0, 0.5)], "classifier string, subject int, session int, fold int, accuracy double"), str(tmp_path / "r"))
    assert r.read_results(spark, str(tmp_path / "r")).first()["accuracy"] == 0.5


def test_counted_windows_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    values = [float(v) for v in range(25)]
    for k in range(0, 25, 7):
        pd.DataFrame({"user": [1] * len(values[k : k + 7]), "value": values[k : k + 7]}).to_parquet(source / f"{k:02}.parquet", index=False)
    stream = spark.readStream.schema("user long, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = hopping.counted_windows(stream, "user", "value", 6, 4)
    running = out.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = {row["window_idx"]: row["mean"] for row in spark.table("counted").collect()}
    assert got == {k: float(np.mean(values[k * 4 : k * 4 + 6])) for k in range(5)}


def test_event_time_windows_over_a_stream_equal_the_batch(spark, tmp_path):
    rows = pd.DataFrame({"user": [1, 1, 1, 2], "ts": pd.to_datetime(["2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5", "2024-01-01 00:00:09", "2024-01-01 00:00:01"], format="ISO8601").astype("datetime64[us]"), "value": [1.0, 3.0, 5.0, 7.0]})
    (tmp_path / "in").mkdir()
    rows.to_parquet(tmp_path / "in" / "a.parquet", index=False)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = hopping.hopping_features(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user", "ts", "value").writeStream.format("memory").queryName("hops").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = hopping.hopping_features(spark.read.parquet(str(tmp_path / "in")), "user", "ts", "value")
    key = lambda r: (r["user"], str(r["window_start"]), r["n"], r["mean"])
    assert sorted(map(key, spark.table("hops").collect())) == sorted(map(key, batch.collect()))


def test_windows_in_order_of_time_from_shuffled_files(spark, tmp_path):
    import datetime as dt
    import random

    rng, first = random.Random(3), dt.datetime(2024, 1, 1)
    rows = {k: [(k, first + dt.timedelta(seconds=i), i, float((i * i) % 23)) for i in range(60)] for k in ("a", "b")}
    every = sorted((x for r in rows.values() for x in r), key=lambda x: x[1])
    for k in range(0, 120, 10):  # shuffled within twenty seconds
        part = every[k : k + 20] if k % 20 == 0 else []
        rng.shuffle(part)
        for half in (part[:9], part[9:]):
            if half:
                spark.createDataFrame(half, "key string, ts timestamp, nth long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [(k, first + dt.timedelta(days=1), 0, 0.0) for k in ("a", "b")]
    spark.createDataFrame(end, "key string, ts timestamp, nth long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, nth long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with hopping.ordered_state(spark):
        out = hopping.ordered_windows(stream, "key", "ts", "nth", "value", 6, 4, late="40 seconds")
        running = out.writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {(r["key"], r["window_idx"]): round(r["mean"], 9) for r in spark.table("ordered").collect()}
    assert got == {(k, w): round(float(np.mean([x[3] for x in r[w * 4 : w * 4 + 6]])), 9) for k, r in rows.items() for w in range((60 - 6) // 4 + 1)}


def test_ranges_of_a_tensor_share_partitions(spark, tmp_path):
    """Five rows a range don't make a partition each: partitions grow with the bytes, not with the number of ranges."""
    from quaywave.sources import ranges

    for key, n in (("1_1", 203), ("2_0", 4)):
        np.save(tmp_path / f"{key}_raw.npy", np.arange(n * 2 * 7, dtype=np.float32).reshape(n, 2, 7))
    rows = ranges.read_npy_rows(spark, str(tmp_path), rows=5, decimate=3)
    assert rows.rdd.getNumPartitions() == 2  # 42 before
    got = rows.orderBy("global_idx", "channel").collect()
    want = [(i, s, t, i - first, c, [float(((i - first) * 2 + c) * 7 + k) for k in (0, 3, 6)]) for s, t, first, n in ((1, 1, 0, 203), (2, 0, 203, 4)) for i in range(first, first + n) for c in range(2)]
    assert [tuple(r) for r in got] == want
    small = ranges.read_npy_rows(spark, str(tmp_path), rows=5, decimate=3, pack=20 * 56)
    assert small.rdd.getNumPartitions() == 12 and sorted(map(tuple, small.collect())) == sorted(want)
