"""Connected components in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (any ordered type; loops and nulls are ignored). Returns node, component (its smallest node).

    Each round hooks every tree to the smallest grandparent among its neighbours and halves the paths,
    so rounds grow with the logarithm of the longest path. State is written to the shared folder each
    round, the state before it is deleted; only one number per round reaches the driver. A hub, or the root
    of a giant tree, is a hot key of both joins: spread_join deals its rows. Aggregations are partial."""
    clean = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    both = clean.select("u", "v").unionByName(clean.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "cc-edges")
    degrees = materialize(both.groupBy("v").agg(F.count(F.lit(1)).alias("_n")), "cc-degrees")
    parents = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("parent"))
    seen, old = None, []
    while True:
        parents = materialize(parents, "cc-parents")
        grand = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        state = materialize(spread_join(parents, grand, ["parent"], ["node"]).select("node", "parent", "grand"), "cc-state")
        for table in old:
            discard(table)
        old = [parents, state]
        now = state.agg(F.sum(F.xxhash64("node", "grand").cast("decimal(38,0)")).alias("s"), F.sum(F.when(F.col("parent") != F.col("grand"), 1).otherwise(0)).alias("deep")).first()
        if seen is not None and now["s"] == seen and not now["deep"] or now["s"] is None:
            discard(parents), discard(both), discard(degrees)
            return state.select("node", F.col("grand").alias("component"))
        seen = now["s"]
        near = spread_join(both, state.select(F.col("node").alias("v"), F.col("grand").alias("g")), ["v"], ["u"], sizes=degrees).groupBy("u").agg(F.min("g").alias("near"))
        hooked = state.join(near.hint("merge"), F.col("node") == F.col("u"))
        offers = hooked.select(F.col("parent").alias("node"), F.least("near", "grand").alias("offer")).unionByName(
            hooked.select("node", F.least("near", "grand").alias("offer"))
        )
        parents = offers.groupBy("node").agg(F.min("offer").alias("parent"))
