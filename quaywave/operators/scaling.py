"""Fit/transform statistics over long features (row, feature_idx, value) and folds.

Fitting is one partial aggregation per feature; transforming joins the few statistics back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .spread import spread_join


def long_form(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """keys, feature_idx, value (double)."""
    return rows.select(*keys, F.posexplode(array).alias("feature_idx", "v")).select(*keys, "feature_idx", F.col("v").cast("double").alias("value"))


def fit_standard(train: DataFrame, by: list[str], eps: float | None = None) -> DataFrame:
    """Mean and population deviation; a constant feature scales by 1, or every deviation grows by eps if given."""
    out = train.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    if eps is not None:
        return out.withColumn("std", F.col("std") + eps)
    return out.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def fit_standard_held_out(rows: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """by, fold, mean, std: the statistics of each fold's training rows, which are all rows outside it.

    One partial aggregation per fold; the folds' counts, means and variances are then put together, so rows are
    read once for all folds. A constant feature scales by 1. rows: value, a fold number, of which there are few."""
    parts = rows.groupBy(*by, fold).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    others = parts.groupBy(*by).agg(F.collect_list(F.struct(F.col(fold).alias("f"), "n", "m", "v")).alias("parts"))  # a struct a fold
    one = others.select(*by, "parts", F.explode(F.transform("parts", lambda p: p["f"])).alias(fold))
    one = one.withColumn("parts", F.filter("parts", lambda p: (p["f"] != F.col(fold)) & (p["n"] > 0)))
    add = lambda what: F.aggregate("parts", F.lit(0.0), lambda a, p: a + what(p))
    one = one.withColumn("n", add(lambda p: p["n"])).withColumn("mean", add(lambda p: p["n"] * p["m"]) / F.nullif("n", F.lit(0.0)))
    spread = add(lambda p: p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    out = one.withColumn("std", F.sqrt(spread / F.nullif("n", F.lit(0.0))))
    return out.select(*by, fold, "mean", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("std"))


def range_ends(rows: DataFrame, by: list[str], value: str, parts: int) -> DataFrame:
    """by, ends: parts - 1 approximate quantiles of each group. Where two reads must see the same ends, settle() them."""
    return rows.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(4 * parts)).alias("ends"))


def part_of(ends: Column, value: Column, parts: int) -> Column:
    """How many ends lie below the value, by binary search: parts is a power of two."""
    steps = F.array(*[F.lit(parts >> k) for k in range(1, parts.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get(ends, i + step - 1) < value, i + step).otherwise(i))


def ranked_values(rows: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """by, value, same, upto, n: each distinct value of a group, its rows, the rows up to it, and all rows.

    Copies of a value fold before the exchange. Distinct values are dealt into ranges at approximate quantiles, so
    that a task sorts one range and not a group; what lies before a range is a running sum over at most `parts`
    rows a group. Ranks are exact wherever the ranges end. Null values take no part."""
    ties = rows.where("value IS NOT NULL").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("same"))
    ends = settle(range_ends(ties, by, "value", parts), "range-ends")  # both uses below see the same ends
    dealt = ties.join(ends, by).withColumn("part", part_of(F.col("ends"), F.col("value"), parts)).drop("ends")
    sizes = dealt.groupBy(*by, "part").agg(F.sum("same").alias("rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(group).alias("n"))
    run = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("run", F.sum("same").over(run)).join(offsets, [*by, "part"]).select(*by, "value", "same", (F.col("run") + F.col("before")).alias("upto"), "n")


def exact_quantiles(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """by, q: the quantiles at `shares` with linear interpolation, from the ranks of the distinct values."""
    place = [F.lit(p) * (F.col("n") - 1) for p in shares]
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("value")))
    ends = [F.struct(at(F.floor(i)).alias("low"), at(F.ceil(i)).alias("high"), F.max(i - F.floor(i)).alias("between")) for i in place]
    found = ranked_values(rows, by).groupBy(*by).agg(*[e.alias(f"q{k}") for k, e in enumerate(ends)])
    line = lambda q: F.col(f"{q}.low") * (1 - F.col(f"{q}.between")) + F.col(f"{q}.high") * F.col(f"{q}.between")
    return found.select(*by, F.array(*[line(f"q{k}") for k in range(len(shares))]).alias("q"))


def fit_robust(train: DataFrame, by: list[str]) -> DataFrame:
    """Median and interquartile range with linear interpolation; a zero range scales by 1."""
    out = exact_quantiles(train, by, [0.25, 0.5, 0.75]).select(*by, F.col("q")[1].alias("mean"), (F.col("q")[2] - F.col("q")[0]).alias("std"))
    return out.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def transform(rows: DataFrame, stats: DataFrame, by: list[str], unseen_unchanged: bool = False) -> DataFrame:
    """(value - mean) / std. Rows without statistics are dropped, or unchanged on demand."""
    joined = rows.join(stats, by, "left" if unseen_unchanged else "inner")
    scaled = (F.col("value") - F.col("mean")) / F.col("std")
    return joined.withColumn("scaled", F.coalesce(scaled, F.col("value")) if unseen_unchanged else scaled).drop("mean", "std")


def scale_per_group(rows: DataFrame, by: list[str]) -> DataFrame:
    """Standard scaling over all rows of each group: statistics first, then a join; no window over the group."""
    return transform(rows, fit_standard(rows, by), by)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, by the rational approximation of Acklam (relative error under 1.2e-9)."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(cs, x: Column) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + k
        return out

    q, mid = F.sqrt(-2 * F.ln(F.least(p, 1 - p))), p - 0.5
    r = mid * mid
    tail = poly(c, q) / (poly(d, q) * q + 1)
    return F.when(F.least(p, 1 - p) < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(poly(a, r) * mid / (poly(b, r) * r + 1))


def quantile_normal(rows: DataFrame, by: list[str], edge: float = 1e-7) -> DataFrame:
    """Rank of each value within its feature (ties share the middle), as a normal quantile clipped at `edge`."""
    ranks = ranked_values(rows, by)
    share = (F.col("upto") - F.col("same") / 2 - 0.5) / F.greatest(F.col("n") - 1, F.lit(1))
    ranks = ranks.withColumn("scaled", normal_quantile(F.least(F.greatest(share, F.lit(edge)), F.lit(1 - edge))))
    others = [c for c in rows.columns if c not in (*by, "value")]
    # A value that many rows share is a hot key; the rows' other columns deal it.
    return spread_join(rows, ranks.select(*by, "value", "scaled"), [*by, "value"], others or [*by])


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The power transform for either sign, with its limits at exponents 0 and 2."""
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def fit_yeo_johnson(rows: DataFrame, low: float = -3.0, high: float = 5.0, rounds: int = 3, steps: int = 8, polish: int = 2) -> DataFrame:
    """feature_idx, lam: the exponent of the largest likelihood of each feature.

    Shrinking grids first: a round is one partial aggregation over all rows, of the variances at 2 * steps + 1
    exponents a feature, and the best one is the middle of the next grid. Then `polish` parabolas through three
    close exponents, whose step shrinks a hundredfold. The rows are written once; one number per feature reaches the driver."""
    schema, spark = "feature_idx int, lam double", rows.sparkSession
    rows = settle(rows.select("feature_idx", "value"), "power-values")
    centre, step = (low + high) / 2, (high - low) / 2 / steps
    best = [(r["feature_idx"], centre) for r in rows.select("feature_idx").distinct().collect()]  # a row per feature
    x = F.col("value")

    def losses(around: int) -> DataFrame:
        """feature_idx, tried: (j, lam, loss) at lam + j * step for j from -around to around."""
        grid = F.transform(F.sequence(F.lit(-around), F.lit(around)), lambda j: F.struct(j.alias("j"), (F.col("lam") + j * F.lit(step)).alias("lam")))
        tried = spark.createDataFrame(best, schema).select("feature_idx", F.inline(grid))
        stats = rows.join(F.broadcast(tried), "feature_idx").groupBy("feature_idx", "j", "lam").agg(F.count(x).alias("n"), F.var_pop(yeo_johnson(x, F.col("lam"))).alias("v"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"))
        return stats.withColumn("loss", 0.5 * F.col("n") * F.ln(F.greatest("v", F.lit(1e-300))) - (F.col("lam") - 1) * F.col("s"))

    for _ in range(rounds):
        best = [(r["feature_idx"], r["lam"]) for r in losses(steps).groupBy("feature_idx").agg(F.min_by("lam", F.struct("loss", "lam")).alias("lam")).collect()]
        step /= steps
    for _ in range(polish):
        at = lambda j, c="loss": F.max(F.when(F.col("j") == j, F.col(c)))
        three = losses(1).groupBy("feature_idx").agg(at(-1).alias("a"), at(0).alias("b"), at(1).alias("c"), at(0, "lam").alias("lam"))
        bend = F.col("a") - 2 * F.col("b") + F.col("c")
        move = F.when(bend > 0, (F.col("a") - F.col("c")) / (2 * bend) * F.lit(step)).otherwise(0.0)
        best = [(r["feature_idx"], r["lam"]) for r in three.select("feature_idx", (F.col("lam") + move).alias("lam")).collect()]
        step /= 100
    return spark.createDataFrame(best, schema)


def normal_quantile_sql(p: str) -> str:
    """normal_quantile as SQL text: the same approximation."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    poly = lambda ks, x: "(" + " + ".join(f"({k!r}::DOUBLE) * pow({x}, {len(ks) - 1 - i})" for i, k in enumerate(ks)) + ")"
    low, q, r = f"least({p}, 1 - {p})", f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"{poly(c, q)} / {poly(d, q)}"
    return f"CASE WHEN {low} < 0.02425 THEN CASE WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END ELSE {poly(a, r)} * ({p} - 0.5) / {poly(b, r)} END"
