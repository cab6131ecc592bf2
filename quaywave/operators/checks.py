"""Hard assertions as a table: every check in one pass over its input, so a writer can refuse before it writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows


def require(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, ok: each an aggregate condition over the table."""
    once = table.agg(*[F.coalesce(c, F.lit(True)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    pairs = [F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("ok")) for i, name in enumerate(checks)]
    return once.select(F.explode(F.array(*pairs)).alias("x")).select("x.check", "x.ok")


def fail_on(checks: DataFrame) -> None:
    """Raises with the names of the checks that failed."""
    bad = [r["check"] for r in checks.where("NOT ok").collect()]  # a row per check
    if bad:
        raise ValueError("failed: " + ", ".join(bad))


def run_checks(trials: DataFrame) -> DataFrame:
    cut = windows.cut_windows(trials, "embedding", 16, 8)
    made = cut.groupBy("vec_id").agg(F.count(F.lit(1)).alias("made"))
    both = trials.select("vec_id", F.size("embedding").alias("n")).join(made, "vec_id", "left")
    expected = windows.window_count(F.col("n"), 16, 8)
    first = require(both, {"windows match": F.bool_and(F.coalesce("made", F.lit(0)) == expected), "keys unique": F.count("vec_id") == F.count_distinct("vec_id"), "vector length": F.bool_and(F.col("n") == 64)})
    marks = trials.groupBy("subject", "session").agg(F.min("vec_id").alias("start"), (F.max("vec_id") + 1).alias("end"))
    return first.unionByName(require(marks, {"start before end": F.bool_and(F.col("start") < F.col("end"))}))
