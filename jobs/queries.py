"""The jobs as registered queries: each is run twice into one new folder, and its whole output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywave.plans.registry import Query, r6
from quaywave.sources.scratch import fresh

from . import event_windows, fold_features


def job1_fold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = fresh(spark, "job1"), fold_features.settings()
    for _ in range(2):
        fold_features.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, config)
    rows = fold_features.read_windows(spark, out)
    named = lambda column, to: [r6(F.col(column)[k], f"{to}{name}") for k, name in enumerate(config["features"])]
    return rows.select("doc_id", "source", "quality", "window_idx", "fold", *named("features", ""), *named("scaled", "z_"))


def job2_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fresh(spark, "job2")
    for _ in range(2):
        event_windows.run(spark, f"{sf_dir}/events.parquet", f"{top}/out", f"{top}/checkpoint", event_windows.settings())
    rows = event_windows.read_windows(spark, f"{top}/out")
    # Values of two decimals make variances that end in an exact half: those are rounded up, whatever their last bit.
    rounded = lambda c: r6(F.col(c) + 1e-9, c) if c == "activity" else r6(c)
    return rows.select(F.col("day").cast("string").alias("day"), "event_type", "window_idx", *(rounded(c) for c in event_windows.FEATURES))


QUERIES: dict[str, Query] = {"job1_fold_features": job1_fold_features, "job2_event_windows": job2_event_windows}

_NAMES = ("mean", "std", "mobility", "complexity", "entropy", "energy")
ORACLES: dict[str, str] = {
    "job1_fold_features": rf"""
        WITH one AS (SELECT doc_id, CAST(max(quality) AS INT) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
        texts AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'none' ELSE '=' || source END AS source, quality,
                         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w)) AS x FROM documents JOIN one USING (doc_id)),
        cut AS (SELECT * EXCLUDE (x), CAST(k AS INT) AS window_idx, list_transform(x[k * 32 + 1 : k * 32 + 64], lambda v: CAST(v AS DOUBLE)) AS x
                FROM (SELECT *, unnest(range(CASE WHEN len(x) < 64 THEN 0 ELSE (len(x) - 64) // 32 + 1 END)) AS k FROM texts)),
        d1 AS (SELECT *, list_transform(list_zip(x[2:], x[:-2]), lambda p: p[1] - p[2]) AS d FROM cut),
        d2 AS (SELECT *, list_transform(list_zip(d[2:], d[:-2]), lambda p: p[1] - p[2]) AS dd FROM d1),
        s AS (SELECT doc_id, source, quality, window_idx, list_avg(x) AS mean, list_var_pop(x) AS v, list_var_pop(d) AS v1, list_var_pop(dd) AS v2 FROM d2),
        f AS (SELECT doc_id, source, quality, window_idx, mean, sqrt(v) AS std, sqrt(v1 / (v + 1e-8)) AS mobility,
                     sqrt(v2 / (v1 + 1e-8)) / (sqrt(v1 / (v + 1e-8)) + 1e-8) AS complexity,
                     0.5 * ln(2 * pi() * exp(1.0) * (v + 1e-10)) AS entropy, ln(greatest(v + mean * mean, 1e-10)) AS energy FROM s),
        classes AS (SELECT source, quality AS dominant FROM (SELECT source, quality, count(*) AS c FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, quality) = 1),
        dealt AS (SELECT source, CAST((row_number() OVER (PARTITION BY dominant ORDER BY source) - 1) % 3 AS INT) AS fold FROM classes),
        g AS (SELECT * FROM f JOIN dealt USING (source)),
        z AS (SELECT h.fold, {", ".join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) = 0 THEN 1 ELSE stddev_pop({n}) END AS s_{n}" for n in _NAMES)}
              FROM (SELECT DISTINCT fold FROM g) h JOIN g ON g.fold <> h.fold GROUP BY h.fold)
        SELECT doc_id, source, quality, window_idx, fold, {", ".join(f"round({n}, 6) + 0.0 AS {n}, round(({n} - m_{n}) / s_{n}, 6) + 0.0 AS z_{n}" for n in _NAMES)}
        FROM g LEFT JOIN z USING (fold)""",
    "job2_event_windows": """
        WITH e AS (SELECT DISTINCT event_id, ts, event_type, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
        s AS (SELECT day, event_type, value, row_number() OVER u - 1 AS pos, count(*) OVER (PARTITION BY day, event_type) AS n,
                     value - lag(value) OVER u AS d1, value - 2 * lag(value) OVER u + lag(value, 2) OVER u AS d2
              FROM e WINDOW u AS (PARTITION BY day, event_type ORDER BY ts, event_id, value)),
        w AS (SELECT *, pos - window_idx * 8 AS in_pos FROM (SELECT s.*, CAST(unnest(range(greatest(0, pos // 8 - 1), pos // 8 + 1)) AS INT) AS window_idx FROM s)
              WHERE window_idx * 8 + 16 <= n AND pos < window_idx * 8 + 16),
        f AS (SELECT day, event_type, window_idx, avg(value) AS m, stddev_pop(value) AS s, median(value) AS med, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS spread,
                     var_pop(value) AS act, var_pop(d1) FILTER (in_pos >= 1) AS v1, var_pop(d2) FILTER (in_pos >= 2) AS v2,
                     avg(value * value) AS m2, avg(value * value * value) AS m3, kurtosis_pop(value) AS kurt FROM w GROUP BY ALL)
        SELECT day, event_type, window_idx, round(m, 6) AS mean, round(s, 6) AS std,
               CASE WHEN s > 0 THEN round((m3 - 3 * m * m2 + 2 * m * m * m) / (s * s * s), 6) + 0.0 END AS skew, round(kurt, 6) + 0.0 AS kurt,
               round(med, 6) AS median, round(spread, 6) AS spread, round(act + 1e-9, 6) AS activity, round(sqrt(v1 / (act + 1e-8)), 6) AS mobility,
               round(sqrt(v2 / (v1 + 1e-8)) / (sqrt(v1 / (act + 1e-8)) + 1e-8), 6) AS complexity
        FROM f""",
}
