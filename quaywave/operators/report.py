"""Analytics of result tables: one row per (model, subject, session, fold) with an accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(results: DataFrame, by: list[str], value: str = "accuracy", sample: bool = True) -> DataFrame:
    """mean, std (ddof 1, or population), min, max, n."""
    std = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def threshold_summary(results: DataFrame, by: list[str], least: float, value: str = "accuracy") -> DataFrame:
    hit = F.sum(F.when(F.col(value) >= least, 1).otherwise(0))
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), hit.alias("hits"), (hit / F.count(value)).alias("share"))


def pivot_mean(results: DataFrame, row: str, column: str, names: list, value: str = "accuracy") -> DataFrame:
    """Means by row and column; the column's values are given, so no extra job finds them."""
    return results.groupBy(row).pivot(column, names).agg(F.avg(value))


def extremes(results: DataFrame, value: str, ties: list[str], n: int = 10, largest: bool = True) -> DataFrame:
    """Top or bottom n rows, ties broken by the key columns: a bounded heap per task, no full sort."""
    first = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return results.orderBy(first, *ties).limit(n)


def null_counts(results: DataFrame) -> DataFrame:
    """One row per column: name, nulls. One pass."""
    names = results.columns
    once = results.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in names])
    return once.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in names])).alias("x")).select("x.column", "x.nulls")


def histogram(values: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin, low, count over equal widths from min to max, the last bin closed; empty bins stay."""
    edges = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    rows = values.select(F.col(value).alias("x")).join(F.broadcast(edges))  # one row
    rows = rows.withColumn("bin", F.coalesce(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")).where("x IS NOT NULL")
    counts = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def rating(cv: Column, mean: Column) -> Column:
    """Tiers of steadiness and height; null for what is neither high nor steady."""
    return (
        F.when((cv < 0.15) & (mean >= 0.65), "excellent")
        .when((cv < 0.20) & (mean >= 0.60), "good")
        .when(mean >= 0.65, "high, inconsistent")
        .when(cv < 0.20, "consistent, low")
    )


def stability(results: DataFrame, by: list[str], value: str = "accuracy") -> DataFrame:
    """mean, std (population), cv = std / mean and its tier; a zero mean has no cv."""
    out = results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    cv = F.col("std") / F.nullif("mean", F.lit(0.0))
    return out.withColumn("cv", cv).withColumn("tier", rating(F.col("cv"), F.col("mean")))


def two_level(results: DataFrame, inner: list[str], outer: list[str], value: str = "accuracy") -> DataFrame:
    """Means per inner group, then their mean, population std, min and max per outer group."""
    first = results.groupBy(*inner).agg(F.avg(value).alias("m"))
    return first.groupBy(*outer).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.min("m").alias("min"), F.max("m").alias("max"))


def inflation(results: DataFrame, method: str, leaky: str, honest: str, value: str = "accuracy") -> DataFrame:
    """(mean of leaky - mean of honest) / mean of honest * 100, in one pass."""
    mean = lambda name: F.avg(F.when(F.col(method) == name, F.col(value)))
    return results.agg(mean(leaky).alias("leaky"), mean(honest).alias("honest")).withColumn("inflation", (F.col("leaky") - F.col("honest")) / F.nullif("honest", F.lit(0.0)) * 100)
