"""Leakage-free folds: whole groups go to one fold. Assignments are over one row per group, never per sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship


def group_key(*parts: str) -> Column:
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])


def group_sizes(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    return rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))


def group_kfold(sizes: DataFrame, by: list[str], group: str, k: int) -> DataFrame:
    """Groups by size descending (ties: larger key first), dealt round: right for groups of equal size.

    Fewer than k groups give as many folds as groups, but at least 2; a single group has none (null)."""
    part = Window.partitionBy(*by) if by else Window.partitionBy()
    order = part.orderBy(F.desc("n"), F.desc(group))
    count = F.count(F.lit(1)).over(part)
    folds = F.when(count < k, F.least(count, F.lit(2))).otherwise(F.lit(k))
    return sizes.withColumn("fold", F.when(count >= 2, F.pmod(F.row_number().over(order) - 1, folds)).cast("int"))


def group_kfold_greedy(sizes: DataFrame, by: list[str], group: str, k: int) -> DataFrame:
    """Each group, largest first, to the lightest fold (ties: the lowest): the loads are the state of one fold
    over the sorted array of a partition's groups."""
    listed = sizes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g")))).alias("groups"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("load"), F.array().cast("array<int>").alias("to"))

    def step(acc, x):
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        load = F.transform(acc["load"], lambda v, i: F.when(i == at, v - x["m"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["to"], F.array(at)).alias("to"))

    dealt = listed.withColumn("to", F.aggregate("groups", start, step, lambda a: a["to"]))
    out = dealt.select(*by, F.explode(F.arrays_zip("groups", "to")).alias("x"))
    return out.select(*by, F.col("x.groups.g").alias(group), (-F.col("x.groups.m")).alias("n"), F.col("x.to").alias("fold"))


def dominant_class(rows: DataFrame, by: list[str], group: str, label: str) -> DataFrame:
    """The commonest label of each group; ties to the lowest."""
    counts = rows.groupBy(*by, group, label).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*by, group).agg(F.min_by(label, F.struct((-F.col("c")).alias("c"), F.col(label).alias("l"))).alias("dominant"))


def stratified_group_kfold(rows: DataFrame, by: list[str], group: str, label: str, k: int) -> DataFrame:
    """Groups of each dominant class dealt round the folds in order of their key."""
    part = Window.partitionBy(*by, "dominant").orderBy(group)
    return dominant_class(rows, by, group, label).withColumn("fold", F.pmod(F.row_number().over(part) - 1, F.lit(k)).cast("int"))


def stratified_group_greedy(rows: DataFrame, by: list[str], group: str, label: str, k: int) -> DataFrame:
    """Each group to the fold that keeps the label shares of folds closest (to nine places; ties to the fold of fewest rows, then the
    lowest), those of the most uneven labels first; sequential, one partition's groups per task."""
    counts = rows.groupBy(*by, group, label).agg(F.count(F.lit(1)).alias("c"))
    ship(rows.sparkSession)
    kinds = dict(counts.dtypes)

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        table = part.pivot_table(index=group, columns=label, values="c", fill_value=0, aggfunc="sum")
        total = table.sum()
        order = table.assign(_s=-table.std(axis=1, ddof=0).round(9), _g=table.index).sort_values(["_s", "_g"]).index
        folds = pd.DataFrame(0.0, index=range(k), columns=table.columns)
        out = {}
        for g in order:
            def spread(f: int) -> tuple[float, float]:
                trial = folds.copy()
                trial.loc[f] += table.loc[g]
                return round(float((trial / total).std(axis=0, ddof=0).mean()), 9), float(trial.loc[f].sum())

            best = min(range(k), key=lambda f: (*spread(f), f))
            folds.loc[best] += table.loc[g]
            out[g] = best
        first = part.drop_duplicates(group)[[*by, group]].copy()
        first["fold"] = first[group].map(out).astype("int32")
        return first

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, group]) + ", fold int"
    return counts.groupBy(*by).applyInPandas(deal, schema)


def leave_one_out(groups: DataFrame, group: str) -> DataFrame:
    """Fold number of each distinct group."""
    return groups.select(group).distinct().withColumn("fold", (F.row_number().over(Window.orderBy(group)) - 1).cast("int"))


def shuffled_kfold(rows: DataFrame, label: str, id_col: str, k: int, seed: int) -> DataFrame:
    """Row-wise stratified folds in a seeded hash order: the leaky baseline, as samples of a group scatter.

    Rows of a label are dealt round the folds within 256 parts by the hash, each begun where the part before it
    ended (counted first): the order of the whole label, and no task sorts more than a part of it."""
    hashed = rows.withColumn("_h", seeded(seed, id_col))
    part = F.substring("_h", 1, 2)
    sizes = hashed.groupBy(label, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")  # at most 256 rows a label
    order = Window.partitionBy(label, "_part").orderBy("_h", id_col)
    out = hashed.withColumn("_part", part).join(offsets, [label, "_part"])
    return out.withColumn("fold", F.pmod(F.col("_before") + F.row_number().over(order) - 1, F.lit(k)).cast("int")).drop("_h", "_part", "_before")


def seeded(seed: int, id_col: str) -> Column:
    """A hash of an id that any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def leaks(assigned: DataFrame, group: str) -> DataFrame:
    """Groups whose rows lie in more than one fold."""
    return assigned.groupBy(group).agg(F.countDistinct("fold").alias("folds")).where("folds > 1")


def valid_folds(assigned: DataFrame, by: list[str], label: str, k: int) -> DataFrame:
    """by, fold, train_classes, test_classes, valid: a fold counts if both sides have two classes.

    From the counts per (fold, label): a label is in training if it has rows outside the fold."""
    cells = assigned.groupBy(*by, "fold", label).agg(F.count(F.lit(1)).alias("c"))
    totals = cells.groupBy(*by, label).agg(F.sum("c").alias("t"))
    folds = cells.select(*by, "fold").distinct()
    grid = folds.join(totals, by) if by else folds.join(F.broadcast(totals))
    grid = grid.join(cells, [*by, "fold", label], "left")
    out = grid.groupBy(*by, "fold").agg(
        F.sum(F.when(F.col("t") > F.coalesce("c", F.lit(0)), 1).otherwise(0)).alias("train_classes"),
        F.sum(F.when(F.coalesce("c", F.lit(0)) > 0, 1).otherwise(0)).alias("test_classes"),
    )
    return out.withColumn("valid", (F.col("train_classes") >= 2) & (F.col("test_classes") >= 2))
