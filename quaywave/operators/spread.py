"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], salt: list[str], how: str = "inner", parts: int = 1024) -> DataFrame:
    """many.join(one, keys, how), "inner" or "left", where a key of `many` may be hot and `one` holds each key once at most.

    Keys with over 1 / parts of the rows are fewer than `parts`: they alone are broadcast. The rows of such a
    key are dealt into shares by the hash of the columns `salt`, and its row of `one` is repeated for each
    share, so that no task gets much over 1 / parts of the rows on account of a key. Counting reads the
    keys of `many` once more. Null keys match nothing; under "left" they are kept, and dealt by the salt."""
    sizes = settle(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "key-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    limit = max(1, total // parts)
    hot = F.broadcast(sizes.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_shares")))
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    hashed = F.xxhash64(F.lit(17), *salt)
    left = many.join(hot, keys, "left").withColumn("_share", F.when(empty, F.pmod(hashed, F.lit(parts))).otherwise(F.pmod(hashed, F.coalesce("_shares", F.lit(1)))).cast("int")).drop("_shares")
    right = one.join(hot, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return left.join(right, [*keys, "_share"], how).drop("_share")
