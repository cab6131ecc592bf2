"""Sources, sinks and streams: what is written is read back, and equals what DuckDB makes of the table itself."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from ..ship import ship
from ..sources import ranges, recordings
from ..sources.ranges import pushed_down
from ..sources.scratch import scratch, settle
from ..streaming.hopping import counted_windows
from .registry import E, L, R, query, r6, results, table, trials

_PLACED = E + """, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject, session ORDER BY vec_id) - 1 AS INT) AS place FROM e)"""


def _recordings(spark, d, make):
    """name, content of one file per (subject, session): make(stack of its vectors by vec_id)."""
    ship(spark)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        name, content = make(np.stack(part["embedding"].to_numpy()).astype(float))
        return pd.DataFrame({"name": [f"{part['subject'].iloc[0]}_{part['session'].iloc[0]}{name}"], "content": [content]})

    return trials(spark, d).groupBy("subject", "session").applyInPandas(build, "name string, content binary")


def _cnt(x):
    # A trial is 16 samples of four channels; the second is a reference channel that readers leave out.
    data = np.floor(x * 1000).reshape(-1, 4, 16).transpose(0, 2, 1).reshape(-1, 4)
    return ".cnt", recordings.encode_cnt(data, ["FP1", "M1", "CZ", "PZ"], 128)


@query(f"""WITH {_PLACED} SELECT subject, session, place AS trial_idx, CAST(CASE c WHEN 0 THEN 0 ELSE c - 1 END AS INT) AS channel, CASE c WHEN 0 THEN 'FP1' WHEN 2 THEN 'CZ' ELSE 'PZ' END AS channel_name, CAST(128 AS INT) AS fs,
  list_transform(embedding[c * 16 + 3 : c * 16 + 12], lambda x: floor(CAST(x AS DOUBLE) * 1000)) AS samples FROM o, (VALUES (0), (2), (3)) v(c)""")
def cnt_range_scan(spark, d):
    """Ten of the sixteen samples of every trial, each read as a range of its recording."""
    path = scratch(spark, "cnt")
    ranges.write_files(_recordings(spark, d, _cnt), path)
    most = trials(spark, d).groupBy("subject", "session").count().agg(F.max("count").alias("n")).first()["n"] or 0
    rows = ranges.read_cnt_ranges(spark, path, [(k, k * 16 + 2, k * 16 + 12) for k in range(most)])
    return rows.withColumn("samples", F.transform("samples", lambda x: x.cast("double")))


@query(f"""WITH {_PLACED} SELECT subject, session, CAST(count(*) * 48 AS BIGINT) AS samples, CAST(3 AS BIGINT) AS channels,
  round(sum(list_sum(list_transform(list_concat(embedding[1:16], embedding[33:64]), lambda x: floor(CAST(x AS DOUBLE) * 1000)))), 6) + 0.0 AS total FROM o GROUP BY ALL""")
def cnt_scan(spark, d):
    """Whole recordings by the binary file source, reference channels left out."""
    path = scratch(spark, "cnt")
    ranges.write_files(_recordings(spark, d, _cnt), path)
    rows = recordings.read_cnt(spark, path, rate=128)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.groupBy("subject", "session").agg(F.sum(F.size("samples")).cast("long").alias("samples"), F.countDistinct("channel").alias("channels"), r6(F.sum(total), "total"))


def _npy(x):
    out = io.BytesIO()
    np.save(out, x.astype(np.float32).reshape(-1, 4, 16))
    return "_raw.npy", out.getvalue()


@query(f"""WITH {_PLACED}, q AS (SELECT row_number() OVER (ORDER BY subject, session, place) - 1 AS global_idx, subject, session, CAST(place AS BIGINT) AS row_idx, embedding FROM o)
SELECT global_idx, subject, session, row_idx, CAST(c AS INT) AS channel, list_transform(range(0, 16, 3), lambda i: round(CAST(embedding[c * 16 + i + 1] AS DOUBLE), 6) + 0.0) AS samples FROM q, range(0, 4) r(c)""")
def npy_decimating_scan(spark, d):
    """All tensors as one collection with a global index, every third sample."""
    path = scratch(spark, "npy")
    ranges.write_files(_recordings(spark, d, _npy), path)
    rows = ranges.read_npy_rows(spark, path, rows=5, decimate=3)
    return rows.withColumn("samples", F.transform("samples", lambda x: r6(x.cast("double"))))


@query(f"""WITH {_PLACED} SELECT subject, session, CAST(place AS BIGINT) AS row_idx, CAST(c AS INT) AS channel, list_transform(embedding[c * 16 + 1 : c * 16 + 16], lambda x: round(CAST(x AS DOUBLE), 6) + 0.0) AS samples
FROM o, range(0, 4) r(c) WHERE subject = 3 AND session < 2""")
def npy_shards_pushed(spark, d):
    """Vectors to .npy shards and back; the filter on the keys is the scan's own, which opens no other file."""
    path = scratch(spark, "shards")
    order = F.row_number().over(Window.partitionBy("subject", "session").orderBy("vec_id")) - 1
    ranges.write_npy(trials(spark, d).select("subject", "session", order.alias("row_idx"), F.col("embedding").alias("samples")), path, (4, 16), most=16)
    with pushed_down(spark):
        rows = ranges.read_npy_rows(spark, path).where("subject = 3 AND session < 2").drop("global_idx")
        return settle(rows.withColumn("samples", F.transform("samples", lambda x: r6(x.cast("double")))), "pushed")


@query(f"""WITH {_PLACED} SELECT subject, session, place AS trial_idx, CAST(CASE c WHEN 0 THEN 0 ELSE c - 1 END AS INT) AS channel,
  round(list_sum(list_transform(embedding[c * 16 + 1 : c * 16 + 16], lambda x: floor(CAST(x AS DOUBLE) * 1000))), 6) + 0.0 AS total FROM o, (VALUES (0), (2), (3)) v(c) WHERE subject IN (3, 4) AND place < 5""")
def cnt_range_pushed(spark, d):
    """Five trials of two subjects: the other files aren't opened, the other ranges not read."""
    path = scratch(spark, "cnt")
    ranges.write_files(_recordings(spark, d, _cnt), path)
    most = trials(spark, d).groupBy("subject", "session").count().agg(F.max("count").alias("n")).first()["n"] or 0
    with pushed_down(spark):
        rows = ranges.read_cnt_ranges(spark, path, [(k, k * 16, k * 16 + 16) for k in range(most)]).where("subject IN (3, 4) AND trial_idx < 5")
        total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
        return settle(rows.select("subject", "session", "trial_idx", "channel", r6(total, "total")), "pushed")


@query(f"""WITH {E} SELECT DISTINCT subject, session, subject % 2 = 0 AS has_companion FROM e""")
def file_discovery(spark, d):
    """Keys from file names; which recordings have a companion; other names are skipped."""
    path = scratch(spark, "found")
    names = _recordings(spark, d, _npy).select("name", F.lit(b"x").alias("content"))
    companions = names.where(F.regexp_extract("name", r"^(\d+)_", 1).cast("int") % 2 == 0).select(F.regexp_replace("name", r"_raw\.npy$", ".parquet").alias("name"), "content")
    ranges.write_files(names.unionByName(companions).unionByName(spark.createDataFrame([("notes.txt", b"x")], "name string, content binary")), path)
    with_companion = recordings.discover(spark, path, "_raw.npy", ".parquet").select("subject", "session", F.lit(True).alias("has"))
    every = recordings.keyed_files(spark.read.format("binaryFile").load(path).select("path"), "path").select("subject", "session").distinct()
    return every.join(with_companion, ["subject", "session"], "left").select("subject", "session", F.coalesce("has", F.lit(False)).alias("has_companion"))


@query(f"WITH {R} SELECT model AS classifier, subject, session, fold, accuracy FROM r WHERE accuracy IS NOT NULL")
def results_csv(spark, d):
    """Results to CSV with a header, and back under their schema."""
    path = scratch(spark, "csv")
    recordings.write_results(results(spark, d).where("accuracy IS NOT NULL").select(F.col("model").alias("classifier"), "subject", "session", "fold", "accuracy"), path)
    return recordings.read_results(spark, path)


@query(f"""WITH {L}, s AS (SELECT vec_id, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY 1)
SELECT subject, session, count(*) AS values, round(sum(abs((value - m) / (sd + 1e-6))), 4) + 0.0 AS size FROM l JOIN s USING (vec_id) WHERE subject = 3 GROUP BY ALL""")
def tensor_write(spark, d):
    """Normalised windows partitioned by recording; reading one subject prunes the others' folders."""
    path = scratch(spark, "tensor")
    recordings.write_tensor(windows.zscore(trials(spark, d), "embedding").select("subject", "session", "vec_id", "z"), path)
    rows = spark.read.parquet(path).where("subject = 3").select("subject", "session", F.explode("z").alias("v"))
    return rows.groupBy("subject", "session").agg(F.count("v").alias("values"), (F.round(F.sum(F.abs("v")), 4) + 0.0).alias("size"))


@query(f"WITH {E} SELECT vec_id, y, CAST(y * 2 AS INT) AS twice FROM e")
def column_append(spark, d):
    """A column is appended once; a second append of the same name changes nothing."""
    a, b, c = (scratch(spark, "append") for _ in range(3))
    trials(spark, d).select("vec_id", "y").write.parquet(a)
    recordings.append_columns(spark, a, b, {"twice": (F.col("y") * 2).cast("int")})
    return recordings.append_columns(spark, b, c, {"twice": F.lit(-1)})


@query("""WITH s AS (SELECT user_id, value, row_number() OVER u - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
w AS (SELECT user_id, unnest(range(greatest(0, pos // 8 - 1), pos // 8 + 1)) AS window_idx, pos, n, value FROM s)
SELECT user_id, CAST(window_idx AS BIGINT) AS window_idx, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std
FROM w WHERE pos >= window_idx * 8 AND pos < window_idx * 8 + 16 AND window_idx * 8 + 16 <= n GROUP BY ALL""")
def counted_stream_windows(spark, d):
    """A stream of files, each user's events in order within one: windows of exactly 16 samples, 8 on, with state across micro-batches."""
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    table(spark, d, "events").select("user_id", "ts", "event_id", "value").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").write.parquet(source)
    stream = spark.readStream.schema("user_id long, ts timestamp, event_id long, value double").parquet(source)
    running = counted_windows(stream, "user_id", "value", 16, 8).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out).select("user_id", "window_idx", r6("mean"), r6("std"))


@query(f"""WITH {E} SELECT DISTINCT 'skipped_' || subject || '.' || CASE session WHEN 0 THEN 'txt' ELSE 'md' END AS name FROM e WHERE session < 2""")
def skipped_files(spark, d):
    """The report of what the extension filter leaves out: one file a subject and kind beside the recordings."""
    path = scratch(spark, "mixed")
    keys = trials(spark, d).select("subject", "session").distinct()
    kept = keys.select(F.concat_ws("_", "subject", F.concat("session", F.lit("_raw.npy"))).alias("name"), F.lit(b"x").alias("content"))
    others = keys.where("session < 2").select(F.concat(F.lit("skipped_"), "subject", F.when(F.col("session") == 0, ".txt").otherwise(".md")).alias("name"), F.lit(b"x").alias("content"))
    ranges.write_files(kept.unionByName(others), path)
    return recordings.skipped(spark, path, ".npy")


@query(f"""WITH {L} SELECT vec_id, CAST(subject AS INT) AS subject, CAST(label AS INT) AS label, feature_idx, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM l WHERE label IS NOT NULL""")
def meta_features_split(spark, d):
    """A wide table of features is split by its meta columns alone, and put together as arrays."""
    from . import lifecycle

    names = [f"f{k}" for k in range(64)]
    wide = lifecycle.to_wide(trials(spark, d).select("vec_id", "subject", "label", F.col("embedding").alias("features")), names)
    rows = lifecycle.from_wide(wide, ("vec_id", "subject", "label"))
    return rows.where("label IS NOT NULL").select("vec_id", "subject", "label", F.posexplode("features").alias("feature_idx", "v")).select("vec_id", "subject", "label", "feature_idx", r6("v", "value"))
