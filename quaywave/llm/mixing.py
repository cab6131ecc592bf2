"""Mixing sources to target weights by fitting subset sums to word budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize, rank_within, text_of, word_count

WEIGHTS = (3, 1, 2)


def knapsack(lengths: list[int], available: list[int], budget: int) -> list[int]:
    """Bounded knapsack: how many of each length add up to the largest sum within budget.

    Reachable sums are the bits of one integer; a count splits into powers of two, and each part's
    set of sums is kept for the way back. It ends early once the whole budget is reachable."""
    mask, sums, trail = (1 << (budget + 1)) - 1, 1, []
    for k, (length, left) in enumerate(zip(lengths, available)):
        if not 0 < length <= budget:
            continue
        left, step = min(left, budget // length), 1
        while left > 0 and not sums >> budget & 1:
            take = min(step, left)
            trail.append((k, take, sums))
            sums |= sums << (length * take) & mask
            left, step = left - take, step * 2
        if sums >> budget & 1:
            break
    chosen, at = [0] * len(lengths), sums.bit_length() - 1
    for k, take, before in reversed(trail):
        if not before >> at & 1:
            chosen[k] += take
            at -= lengths[k] * take
    return chosen


def fit_budget(lengths: list[int], counts: list[int], budget: int, window: int = 1 << 14) -> list[int]:
    """How many documents of each length to take, none more than there are, to come nearest below budget.

    Every length first gives its share in proportion; the longest that still fit bring the rest under
    `window` words, and the bounded knapsack closes what is left. Where more than `window` words are left
    for the knapsack, every document not yet taken is longer than what is left: there is nothing to close it with."""
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total if n else 0 for n, c in zip(lengths, counts)]
    left = budget - sum(a * b for a, b in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if lengths[i] and left > window:
            more = min(counts[i] - taken[i], (left - window // 2) // lengths[i])
            if more > 0:
                taken[i] += more
                left -= more * lengths[i]
    for i in order:  # only where long documents alone are left
        if lengths[i] and left > window:
            more = min(counts[i] - taken[i], left // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    if 0 < left <= window:
        more = knapsack([lengths[i] for i in order], [counts[i] - taken[i] for i in order], left)
        for i, n in zip(order, more):
            taken[i] += n
    return taken


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sizes: source, source_size. Adds `target`: the budget by weight, none above `most` times its source.

    Pouring the excess back by weight ends where target = min(cap, level * weight); sources in order of
    cap / weight are full as long as the level of those after them stands higher. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "source", "source_size", "weight", "cap",
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("budget"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    full = (F.col("budget") - F.col("cap_before")) * F.col("weight") > F.col("cap") * (F.col("weights") - F.col("weight_before"))
    rows = rows.withColumn("full", full)
    poured = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    spent = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(whole)
    level = F.when(F.col("weights") > spent, (F.col("budget") - poured) / F.nullif(F.col("weights") - spent, F.lit(0.0)))
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _mix(rows: DataFrame, keyed: DataFrame, share: float, most: float, weights: tuple[int, ...], seed: int, ties: list[Column] | None = None) -> DataFrame:
    """rows with source_size, target, copies. rows and keyed: id, source, size, key and, in rows alone, what else is carried."""
    id_, key, size, source = (F.col(f"__quaywave_{c}") for c in ("id", "key", "size", "source"))
    lengths = keyed.groupBy(key, source, size).agg(F.count(F.lit(1)).alias("n"))
    lengths = lengths.select(key.alias("key"), source.alias("source"), size.alias("size"), "n")
    sizes = lengths.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes.drop("key"), share, most, weights)
    targets = targets.withColumn("key", _key(F.col("source"))).drop("source")

    def plan(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = min(int(target // whole), int(most)) if whole else 0
        extra = fit_budget(rows["size"].tolist(), rows["n"].tolist(), int(target) - passes * whole) if whole and passes < most else [0] * len(rows)
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "source_size": whole, "target": target, "passes": passes, "extra": extra})

    planned = lengths.drop("source").join(targets.hint("merge"), "key").groupBy("key").applyInPandas(plan, "key string, size long, source_size long, target double, passes long, extra long")
    planned = materialize(planned.select([F.col(c).alias(f"__quaywave_{c}") for c in planned.columns]), "mix-plan")
    # The plan of a length goes to every part of its group, so that no group meets it in one task.
    ranked = rank_within(rows, ["__quaywave_key", "__quaywave_size"], [F.lit(seed), id_], name="__quaywave_rank", counted=keyed, ties=ties, beside=planned)
    copies = F.col("__quaywave_passes") + F.when(F.col("__quaywave_rank") < F.col("__quaywave_extra"), 1).otherwise(0)
    return ranked.withColumn("__quaywave_copies", copies.cast("int"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *others: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    own = {"id": F.col(id_col).cast("long"), "source": source, "key": _key(source), "size": word_count(text_of(text_col))}
    return docs.select(*others, *(c.alias(f"__quaywave_{k}") for k, c in own.items()))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 20240) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken (= copies * size).

    Sizes are words; null texts have none, a null source is a source of its own and sorts last. Whole
    passes give every document of a source equally; the rest of the budget is fitted over counts of
    exact lengths, and seeded ranks within (source, length) say which documents fill the counts.
    The plan for a source sees one row per distinct length. Repeated rows count as documents of
    their own, ties in the seeded order fall to the id. Empty tables give empty results."""
    ship(docs.sparkSession)
    keyed = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    own = lambda c: F.col(f"__quaywave_{c}")
    return _mix(keyed, keyed, share, most, weights, seed).select(
        own("id").alias(id_col), own("source").alias("source"), own("size").alias("size"), own("source_size").alias("source_size"),
        own("target").alias("target"), own("copies").cast("long").alias("copies"), (own("copies") * own("size")).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 20240) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources takes it, all columns.

    Whole rows are ranked, not ids: a row that occurs twice is two documents, each taken at most `most`
    times; so are rows without an id. Rows that differ in nothing are interchangeable, others with
    one id are told apart by a hash of their columns, so reruns agree. An empty table gives an empty one."""
    ship(docs.sparkSession)
    keyed = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    rows = _sized(docs, id_col, text_col, source_col, *docs.columns)
    plain = [F.col(f.name) for f in docs.schema if "map" not in f.dataType.simpleString()]
    out = _mix(rows, keyed, share, most, weights, seed, [F.xxhash64(*plain)]).where("__quaywave_copies > 0")
    return out.withColumn("__quaywave_copy", F.explode(F.sequence(F.lit(1), F.col("__quaywave_copies")))).select(*docs.columns)
