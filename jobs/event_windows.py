"""Keeps windowed features of event series up to date.

    python -m jobs.event_windows --events DIR --out DIR --checkpoint DIR [--config FILE]

Takes the event files that the checkpoint has not seen, adds their samples to <out>/samples, and computes anew the
windows of the days they touch into <out>/windows; all other days stay untouched. A series is an event type's
values within a day, in order of time, as a trial is of a recording; windows never cross days.
So late files, files delivered twice and a run that was cut short end in the same windows as one run over everything."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywave.operators.features import window_features
from quaywave.operators.windows import explode_windows, number_samples
from quaywave.sources.parts import replace_parts

log = logging.getLogger(__name__)
CONFIG = Path(__file__).with_suffix(".json")
SAMPLES = "event_id long, ts timestamp_ntz, event_type string, value double, day date, batch long"
FEATURES = ("mean", "std", "skew", "kurt", "median", "spread", "activity", "mobility", "complexity")
WINDOWS = f"event_type string, window_idx int, {', '.join(f'{f} double' for f in FEATURES)}, day date"


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def _series() -> Column:
    """One string for a day and an event type, the null type too."""
    return F.concat_ws("/", F.col("day").cast("string"), F.coalesce(F.concat(F.lit("="), "event_type"), F.lit("")))


def day_windows(samples: DataFrame, size: int, step: int) -> DataFrame:
    """The windows of whole days. samples: event_id, ts, event_type, value, day; repeated deliveries count once.

    A day is numbered hour by hour, each from the counts of those before it, so no task sorts a whole series."""
    once = samples.dropDuplicates(["event_id", "ts", "event_type", "value"]).withColumn("series", _series())
    numbered = number_samples(once, "series", ["ts", "event_id", "value"], F.hour("ts"))
    out = window_features(explode_windows(numbered.select("series", "value", "pos", "n"), size, step), ["series", "window_idx"])
    event_type = F.when(F.substring("series", 12, 1) == "=", F.expr("substring(series, 13)"))
    return out.select(event_type.alias("event_type"), "window_idx", *FEATURES, F.substring("series", 1, 10).cast("date").alias("day"))


def update(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Takes one batch of new events. Repeating a batch replaces what it wrote."""
    spark = batch.sparkSession
    rows = batch.where("ts IS NOT NULL AND value IS NOT NULL").select(
        F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz"), "event_type", F.col("value").cast("double"), F.to_date("ts").alias("day"), F.lit(number).cast("long").alias("batch")
    )
    replace_parts(rows, f"{out}/samples", ["day", "batch"])
    samples = spark.read.schema(SAMPLES).parquet(f"{out}/samples")
    taken = samples.where(F.col("batch") == number).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    log.info("batch %d: read %d events with time and value, %s to %s", number, *taken)
    days = [r["day"] for r in samples.where(F.col("batch") == number).select("day").distinct().collect()]  # a row a calendar day
    windows = day_windows(samples.where(F.col("day").isin(days)), config["size"], config["step"])
    spread = F.pmod(F.xxhash64("event_type", "window_idx"), F.lit(config["files_per_day"]))
    replace_parts(windows.repartition("day", spread), f"{out}/windows", ["day"])
    wrote = read_windows(spark, out).where(F.col("day").isin(days)).count()  # from footers
    log.info("batch %d: wrote %d windows of %d days to %s/windows", number, wrote, len(days), out)


def _pattern(path: str) -> str:
    """A path as a pattern that only it matches: the stream source takes a single file, too, if it comes as a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[]{}\\") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict) -> None:
    """Takes all that is new in `events` (a folder, a file or a pattern) and ends. Events without a time or a value are left out."""
    for name, schema, by in (("samples", SAMPLES, ["day", "batch"]), ("windows", WINDOWS, ["day"])):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{out}/{name}")  # there from the first run on
    new = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(_pattern(events))
    query = new.writeStream.foreachBatch(lambda batch, number: update(batch, number, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: all events taken, %d batches in this run", events, sum(1 for p in query.recentProgress if p["numInputRows"]))


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(WINDOWS).parquet(f"{out}/windows")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("events", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("event_windows").getOrCreate()
    try:
        run(spark, args.events, args.out, args.checkpoint, settings(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
