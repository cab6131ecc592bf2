"""Mutual information of continuous features and a class by nearest neighbours, without a feature's column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .scaling import part_of, range_ends


def tie_break(*keys: Column | str) -> Column:
    """A number in [-0.5, 0.5) from the keys' text, which any SQL engine can repeat."""
    text = F.concat_ws(":", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32 - 0.5


def digamma(n: Column) -> Column:
    """psi of a whole number from 1 on: six steps up the recurrence, then the asymptotic series."""
    x = n.cast("double") + 6
    f = 1 / (x * x)
    down = sum((1 / (n.cast("double") + j) for j in range(1, 6)), 1 / n.cast("double"))
    return F.ln(x) - 0.5 / x - f * (F.lit(1 / 12) - f * (F.lit(1 / 120) - f / 252)) - down


def ranked(rows: DataFrame, by: list[str], value: str, parts: int) -> DataFrame:
    """Adds rank (0-based, by value within by) and n. Rows are dealt into `parts` ranges of values, counted first: a task sorts one range."""
    ends = settle(range_ends(rows, by, value, parts), "information-ends")  # both uses below see the same ends
    dealt = rows.join(F.broadcast(ends), by).withColumn("_part", part_of(F.col("ends"), F.col(value), parts)).drop("ends")  # a row a feature and class
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_part", before.alias("_before"), F.sum("_n").over(of).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value))
    return dealt.join(sizes, [*by, "_part"]).withColumn("rank", F.col("_before") + inside - 1).drop("_part", "_before")


def kth_within(rows: DataFrame, by: list[str], value: str, k: int, block: int) -> DataFrame:
    """rows: value, rank, n. Adds d: the distance to the k-th nearest of the other rows of `by` (the farthest, if there are fewer).

    Rows meet in blocks of ranks; the first and last k of a block are repeated in the block before and after. As
    ranks have no gaps, every row has its k neighbours on either side in its own block, wherever blocks end."""
    at, within = F.floor(F.col("rank") / block), F.col("rank") % block
    near = F.array(at, F.when(within < k, at - 1), F.when(within >= block - k, at + 1))
    held = rows.withColumn("_own", at).withColumn("_block", F.explode(F.filter(near, lambda b: b.isNotNull())))
    order = Window.partitionBy(*by, "_block").orderBy("rank")
    far, x = F.lit(float("inf")), F.col(value)
    left = F.array(F.lit(0.0), *(F.coalesce(x - F.lag(value, i).over(order), far) for i in range(1, k + 1)))
    right = F.array(F.lit(0.0), *(F.coalesce(F.lead(value, i).over(order) - x, far) for i in range(1, k + 1)))
    held = held.withColumn("_left", left).withColumn("_right", right).where("_block = _own")
    most = F.least(F.lit(k), F.col("n") - 1).cast("int")
    nearest = F.array_min(F.transform(F.sequence(F.lit(0), most), lambda i: F.greatest(F.get("_left", i), F.get("_right", most - i))))
    return held.withColumn("d", nearest).drop("_own", "_block", "_left", "_right")


def knn_information(rows: DataFrame, label: str, feature: str = "feature_idx", value: str = "value", noise: Column | None = None, k: int = 3, parts: int = 64, block: int = 50_000) -> DataFrame:
    """feature, mi: the estimate psi(n) + mean(psi(k) - psi(n of the class) - psi(m)) of each feature, at least 0.

    m counts the values of all classes nearer to a value than its k-th neighbour of its own class, itself included.
    Values are divided by their deviation, and `noise` (a column; see tie_break) times 1e-10 parts equal ones.
    Classes of one row take part in the counts alone. Null values and labels are left out.
    No group is larger than a range of values or a block of ranks; only counts of ranges are put in order."""
    rows = rows.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(F.col(feature).alias("f"), F.col(label).alias("c"), F.col(value).cast("double").alias("v"), (F.lit(0.0) if noise is None else noise).alias("e"))
    spread = rows.groupBy("f").agg(F.greatest(F.stddev_pop("v"), F.lit(1e-12)).alias("s"))  # a row a feature
    spread = settle(spread, "information-spread")
    points = rows.join(F.broadcast(spread), "f").select("f", "c", (F.col("v") / F.col("s") + 1e-10 * F.col("e")).alias("x"))
    near = kth_within(ranked(points, ["f", "c"], "x", parts), ["f", "c"], "x", k, max(block, k))

    # The k-th neighbour itself stays outside, rounding or not.
    d = F.when(F.col("n") > 1, F.col("d") * (1 - 1e-9))
    kind = lambda v, name: F.struct(v.alias("v"), F.lit(name).alias("kind"))
    marks = F.array(kind(F.col("x"), 1), kind(F.col("x") - d, 0), kind(F.col("x") + d, 2))
    asked = near.select("f", "c", "n", "rank", F.explode(marks).alias("m")).select("f", "c", "n", "rank", "m.v", "m.kind").where("v IS NOT NULL")
    asked = settle(asked, "information-marks")
    ends = settle(range_ends(asked.where("kind = 1"), ["f"], "v", parts), "information-ends")
    dealt = asked.join(F.broadcast(ends), "f").withColumn("part", part_of(F.col("ends"), F.col("v"), parts)).drop("ends")
    point = F.when(F.col("kind") == 1, 1).otherwise(0)
    sizes = dealt.groupBy("f", "part").agg(F.sum(point).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("f", "part", before.alias("before"))
    upto = F.sum(point).over(Window.partitionBy("f", "part").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = dealt.withColumn("upto", upto).where("kind <> 1").join(sizes, ["f", "part"])
    m = F.sum(F.when(F.col("kind") == 2, 1).otherwise(-1) * (F.col("upto") + F.col("before")))
    each = counted.groupBy("f", "c", "n", "rank").agg(F.greatest(m, F.lit(1)).alias("m"))
    classes = each.groupBy("f", "c", "n").agg(F.sum(digamma(F.col("m"))).alias("below"))
    own = digamma(F.least(F.lit(k), F.col("n") - 1)) - digamma(F.col("n"))
    sums = classes.groupBy("f").agg(F.sum("n").alias("used"), (F.sum(F.col("n") * own) - F.sum("below")).alias("rest"))
    found = sums.select("f", F.greatest(F.lit(0.0), digamma(F.col("used")) + F.col("rest") / F.col("used")).alias("mi"))
    return spread.select("f").join(found, "f", "left").select(F.col("f").alias(feature), F.coalesce("mi", F.lit(0.0)).alias("mi"))
