"""Feature scores over long features (row, feature_idx, value, label) and top-k selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variance_filter(rows: DataFrame, least: float) -> DataFrame:
    """Features whose population variance is strictly above `least`, with it."""
    return rows.groupBy("feature_idx").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > least)


def class_moments(rows: DataFrame) -> DataFrame:
    """feature_idx, f, variance, lo, hi: one pass over the values, partially aggregated per class; the rest is closed
    form over classes. f is the one-way analysis of variance against label."""
    per = rows.groupBy("feature_idx", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    whole = per.groupBy("feature_idx").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    between = F.col("squares") - F.col("total") * F.col("grand") * F.col("grand")
    f = (between / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("within") / F.nullif(F.col("total") - F.col("k"), F.lit(0)), F.lit(0.0))
    return whole.select("feature_idx", f.alias("f"), ((F.col("within") + between) / F.col("total")).alias("variance"), "lo", "hi")


def anova_f(rows: DataFrame) -> DataFrame:
    """One-way F of each feature against label."""
    return class_moments(rows).select("feature_idx", "f")


def feature_scores(rows: DataFrame, bins: int = 10) -> DataFrame:
    """feature_idx, f, mi, variance: a pass for moments and edges, a pass for the binned counts."""
    moments = class_moments(rows)
    return moments.select("feature_idx", "f", "variance").join(binned_mi(rows, bins, moments.select("feature_idx", "lo", "hi")), "feature_idx")


def binned_mi(rows: DataFrame, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """Mutual information (nats) of label and equal-width bins of each feature; a constant feature has one bin."""
    if edges is None:
        edges = rows.groupBy("feature_idx").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    binned = rows.join(F.broadcast(edges), "feature_idx")  # one row per feature
    binned = binned.withColumn("bin", F.coalesce(F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0)))
    cells = binned.groupBy("feature_idx", "bin", "label").agg(F.count(F.lit(1)).alias("c"))
    feature = Window.partitionBy("feature_idx")
    cells = cells.withColumns({"n": F.sum("c").over(feature), "nb": F.sum("c").over(Window.partitionBy("feature_idx", "bin")), "nl": F.sum("c").over(Window.partitionBy("feature_idx", "label"))})
    c = F.col("c").cast("double")
    return cells.groupBy("feature_idx").agg(F.sum(c / F.col("n") * F.ln(c * F.col("n") / (F.col("nb") * F.col("nl")))).alias("mi"))


def _all():
    """All rows: one per feature."""
    return Window.partitionBy()


def scaled_by_max(x: Column) -> Column:
    return F.when(F.max(x).over(_all()) > 0, x / F.nullif(F.max(x).over(_all()), F.lit(0.0))).otherwise(x)


def scaled_by_range(x: Column, eps: float = 1e-8) -> Column:
    low, high = F.min(x).over(_all()), F.max(x).over(_all())
    return (x - low) / (high - low + eps)


def fuse(scores: DataFrame, f: float, mi: float, k: int, variance: float = 0.0, by_range: bool = False, eps: float = 1e-8) -> DataFrame:
    """scores: feature_idx, f, mi, variance (one row per feature). Weighted sum of normalised scores, then a share of
    the variance over its maximum; the k largest, ties to the smaller index; where there are no more than k
    features all stay. Null and NaN scores count as 0."""
    norm = scaled_by_range if by_range else scaled_by_max
    clean = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    base = f * norm(clean("f")) + mi * norm(clean("mi"))
    spread = F.col("variance") / (F.max("variance").over(_all()) + eps)
    fused = scores.withColumn("score", (1 - variance) * base + variance * spread if variance else base)
    return top_k(fused, "score", k)


def borda(scores: DataFrame, k: int) -> DataFrame:
    """Sum of the ranks by f and by mi (0 best, ties to the smaller index); the k lowest."""
    rank = lambda x: F.row_number().over(Window.orderBy(F.desc(x), "feature_idx")) - 1
    ranked = scores.withColumn("borda", rank("f") + rank("mi"))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("borda", "feature_idx"))).where(F.col("place") <= k)


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "feature_idx"))
    return scores.withColumn("place", place).where(F.col("place") <= k)
