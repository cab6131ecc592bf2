"""Sliding windows over samples: counting, cutting, capping, decimating, normalising.

A series is rows (key, position, value) or one array per row. Row forms deal each sample to the few windows
that hold it, so later group-bys aggregate partially and no series is ever gathered; array forms stay
within their row and never shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_count(n: Column, size: int, step: int) -> Column:
    """Complete windows in n samples: none if n < size."""
    return F.when(n < size, F.lit(0)).otherwise(F.floor((n - size) / F.lit(step)) + 1).cast("int")


def window_count_open(n: Column, size: int, step: int) -> Column:
    """The variant that stops before the last start that would fit exactly: starts 0, step, .. < n - size."""
    return F.when(n <= size, F.lit(0)).otherwise(F.floor((n - size - 1) / F.lit(step)) + 1).cast("int")


def number_samples(series: DataFrame, key: str, order: list[str], part: Column | None = None) -> DataFrame:
    """Adds pos (0-based within the key) and n (samples of the key).

    part: a column that grows with the order, such as the day of a time. Then a series is numbered part by
    part, each from the counts of those before it, and no task sorts more than one part of a series."""
    rows = series.withColumn("_part", F.lit(0) if part is None else part)
    sizes = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(key, "_part", before.alias("_before"), F.sum("_n").over(of).alias("n"))  # one row per part
    rank = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return rows.join(sizes, [key, "_part"]).withColumn("pos", (F.col("_before") + rank - 1).cast("int")).drop("_part", "_before")


def explode_windows(samples: DataFrame, size: int, step: int, cap: int | None = None, open_end: bool = False) -> DataFrame:
    """samples: pos, n. One row per sample and window that holds it: window_idx, in_pos.

    The cap bounds the generated index, so capped windows are never made."""
    count = (window_count_open if open_end else window_count)(F.col("n"), size, step)
    if cap is not None:
        count = F.least(count, F.lit(cap))
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / F.lit(step)) + 1).cast("int")
    high = F.least(F.floor(F.col("pos") / F.lit(step)).cast("int"), count - 1)
    rows = samples.withColumn("low", low).withColumn("high", high).where("low <= high")
    rows = rows.withColumn("window_idx", F.explode(F.sequence("low", "high"))).drop("low", "high")
    return rows.withColumn("in_pos", (F.col("pos") - F.col("window_idx") * step).cast("int"))


def cut_windows(rows: DataFrame, array: str, size: int, step: int, cap: int | None = None, open_end: bool = False) -> DataFrame:
    """Array form: window_idx and samples (the slice). Arrays shorter than a window give no row."""
    n = F.size(array)
    count = (window_count_open if open_end else window_count)(n, size, step)
    if cap is not None:
        count = F.least(count, F.lit(cap))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    out = rows.withColumn("window_idx", F.explode(starts))
    return out.withColumn("samples", F.slice(array, F.col("window_idx") * step + 1, size))


def decimate(array: str | Column, k: int) -> Column:
    """Every k-th sample, without an anti-alias filter."""
    return F.filter(array, lambda x, i: i % k == 0)


def mean_of(array: str | Column) -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(array)


def variance_of(array: Column, mean: Column, ddof: int = 0) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + (x.cast("double") - mean) * (x.cast("double") - mean)) / (F.size(array) - ddof)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a column that a lambda mentions would be evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def moments_of(array: str | Column) -> Column:
    """struct(m, v): mean and population variance of an array."""
    array = F.col(array) if isinstance(array, str) else array
    return let(mean_of(array), lambda m: F.struct(m.alias("m"), variance_of(array, m).alias("v")))


def with_moments(rows: DataFrame, array: str) -> DataFrame:
    """Adds m and v (mean, population variance) of an array column."""
    return rows.withColumn("_s", moments_of(array)).withColumns({"m": F.col("_s.m"), "v": F.col("_s.v")}).drop("_s")


def zscore(rows: DataFrame, array: str, floor: float = 1e-6, out: str = "z") -> DataFrame:
    """(x - mean) / (population deviation + floor) within each array."""
    scaled = lambda s: F.transform(array, lambda x: (x.cast("double") - s["m"]) / (F.sqrt(s["v"]) + floor))
    return rows.withColumn(out, let(moments_of(array), scaled))


def remove_dc(rows: DataFrame, array: str, out: str = "centred") -> DataFrame:
    return rows.withColumn(out, let(mean_of(array), lambda m: F.transform(array, lambda x: x.cast("double") - m)))


def stratified_sample(rows: DataFrame, label: str, id_col: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each label, those first in a seeded hash order; only slim columns are ranked
    and the window's limit is applied before the exchange."""
    ranked = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col)))
    return ranked.where(F.col("_r") <= most).drop("_h", "_r")
