"""Joins that stand for positional alignment, companions and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that belong together by position become an inner join on the explicit key."""
    return left.join(right, keys)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys on one side only, with the side: what an alignment check must find empty."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def with_companion(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def interval_join(points: DataFrame, intervals: DataFrame, position: str, start: str = "start", end: str = "end", keys: tuple[str, ...] = (), small: int = 100_000) -> DataFrame:
    """Every point with every interval [start, end) of its keys that holds it. Columns of both; keys once.

    An interval goes to the bins it touches among bins of a width no smaller than itself, a power of two: two as a
    rule. A point looks into one bin of every width that occurs, of which there are few (the powers of two between the
    shortest and the longest interval). So long intervals cost no more than short ones, and the join is an
    equality with an exact check after. Up to `small` intervals, counted, are broadcast; more are joined by sorting, in
    which the session's skew handling splits a crowded bin. Empty, reversed and null intervals hold nothing."""
    size = F.col(end) - F.col(start)
    spans = intervals.where(size > 0).withColumn("_level", F.ceil(F.log2(size.cast("double"))).cast("int"))
    width = F.pow(F.lit(2.0), F.col("_level"))
    in_bin = lambda x: F.floor(F.col(x).cast("double") / width)
    spans = spans.withColumn("_bin", F.explode(F.sequence(in_bin(start), in_bin(end))))
    levels = [r["_level"] for r in spans.select("_level").distinct().collect()]
    looks = F.array(*(F.lit(x) for x in levels)).cast("array<int>")
    probes = points.where(F.col(position).isNotNull()).withColumn("_level", F.explode(looks)).withColumn("_bin", in_bin(position))
    few = spans.limit(small + 1).count() <= small
    found = probes.join(F.broadcast(spans) if few else spans.hint("merge"), [*keys, "_level", "_bin"])
    return found.where((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))).drop("_level", "_bin")


def label_samples(samples: DataFrame, trials: DataFrame, position: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples with the trials that hold them. trials: keys, start, end (exclusive), label, of any number."""
    return interval_join(samples, trials, position, keys=keys)


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Set intersection: the leakage check of train and test groups."""
    return left.select(*keys).intersect(right.select(*keys))
