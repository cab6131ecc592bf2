"""Where queries register, with the stand-ins for recordings and results that the driver's tables give.

Trial keys are made from vec_id: subject = vec_id % 10, session = vec_id div 10 % 3, trial = vec_id div 30 % 6.
The three-state label y is -1, 0, 1 for labels under 4, under 6, and above. Results are event rows: model =
event_type, subject = user_id % 15, session = event_id % 3, fold = event_id % 5, accuracy = value / 500."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, half up, without a negative zero."""
    out = F.round(x, 6) + 0.0
    return out.alias(name or x) if name or isinstance(x, str) else out


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("label") < 4, -1).when(F.col("label") < 6, 0).otherwise(1)
    key = lambda q: F.expr(q).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", key("vec_id % 10").alias("subject"), key("vec_id div 10 % 3").alias("session"), key("vec_id div 30 % 6").alias("trial"), y.cast("int").alias("y"))


E = """e AS (SELECT vec_id, embedding, label, CAST(vec_id % 10 AS INT) AS subject, CAST(vec_id // 10 % 3 AS INT) AS session,
       CAST(vec_id // 30 % 6 AS INT) AS trial, CAST(CASE WHEN label < 4 THEN -1 WHEN label < 6 THEN 0 ELSE 1 END AS INT) AS y FROM embeddings)"""
L = E + """, l AS (SELECT e.* EXCLUDE (embedding), CAST(i - 1 AS INT) AS feature_idx, CAST(embedding[i] AS DOUBLE) AS value
       FROM e, range(1, 65) r(i))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda q: F.expr(q).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), key("user_id % 15").alias("subject"), key("event_id % 3").alias("session"), key("event_id % 5").alias("fold"), (F.col("value") / 500).alias("accuracy"), "event_id")


R = """r AS (SELECT event_type AS model, CAST(user_id % 15 AS INT) AS subject, CAST(event_id % 3 AS INT) AS session,
       CAST(event_id % 5 AS INT) AS fold, value / 500 AS accuracy, event_id FROM events)"""
