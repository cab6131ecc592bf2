"""Scaling, selection, folds, joins and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features, folds, joins, report, scaling, selection, windows
from .registry import E, L, R, query, r6, results, table, trials


def _long(spark, d, keys=("vec_id",)):
    return scaling.long_form(trials(spark, d), list(keys), "embedding")


# --- scaling -----------------------------------------------------------------------------------------------


@query(f"WITH {L} SELECT feature_idx, round(var_pop(value), 6) AS variance FROM l GROUP BY 1 HAVING var_pop(value) > 0.0155")
def variance_filter(spark, d):
    return selection.variance_filter(_long(spark, d), 0.0155).select("feature_idx", r6("variance"))


@query(f"""
WITH {L}, s AS (SELECT feature_idx, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM l WHERE vec_id % 5 <> 0 GROUP BY 1)
SELECT vec_id, feature_idx, round((value - m) / sd, 6) + 0.0 AS scaled FROM l JOIN s USING (feature_idx) WHERE vec_id % 5 = 0""")
def standard_scale_fold(spark, d):
    rows = _long(spark, d)
    stats = scaling.fit_standard(rows.where("vec_id % 5 <> 0"), ["feature_idx"])
    return scaling.transform(rows.where("vec_id % 5 = 0"), stats, ["feature_idx"]).select("vec_id", "feature_idx", r6("scaled"))


@query(f"""
WITH {L} SELECT vec_id, feature_idx, round((value - avg(value) OVER g) / CASE WHEN stddev_pop(value) OVER g = 0 THEN 1 ELSE stddev_pop(value) OVER g END, 6) + 0.0 AS scaled
FROM l WINDOW g AS (PARTITION BY subject, session, feature_idx)""")
def standard_scale_session(spark, d):
    return scaling.scale_per_group(_long(spark, d, ("vec_id", "subject", "session")), ["subject", "session", "feature_idx"]).select("vec_id", "feature_idx", r6("scaled"))


@query(f"""
WITH {L}, s AS (SELECT subject, feature_idx, avg(value) AS m, stddev_pop(value) + 1e-8 AS sd FROM l WHERE subject < 8 GROUP BY ALL)
SELECT vec_id, feature_idx, round(coalesce((value - m) / sd, value), 6) + 0.0 AS scaled FROM l LEFT JOIN s USING (subject, feature_idx)""")
def subject_normalise(spark, d):
    rows = _long(spark, d, ("vec_id", "subject"))
    stats = scaling.fit_standard(rows.where("subject < 8"), ["subject", "feature_idx"], eps=1e-8)
    return scaling.transform(rows, stats, ["subject", "feature_idx"], unseen_unchanged=True).select("vec_id", "feature_idx", r6("scaled"))


@query(f"""
WITH {L}, s AS (SELECT feature_idx, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q FROM l WHERE vec_id % 5 <> 0 GROUP BY 1)
SELECT vec_id, feature_idx, round((value - m) / CASE WHEN q = 0 THEN 1 ELSE q END, 6) + 0.0 AS scaled FROM l JOIN s USING (feature_idx) WHERE vec_id % 5 = 0""")
def robust_scale_exact(spark, d):
    rows = _long(spark, d)
    stats = scaling.fit_robust(rows.where("vec_id % 5 <> 0"), ["feature_idx"])
    return scaling.transform(rows.where("vec_id % 5 = 0"), stats, ["feature_idx"]).select("vec_id", "feature_idx", r6("scaled"))


@query(f"""WITH {L}, t AS (SELECT feature_idx, value, count(*) AS same FROM l GROUP BY ALL),
u AS (SELECT *, sum(same) OVER (PARTITION BY feature_idx ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(same) OVER (PARTITION BY feature_idx) AS n FROM t),
p AS (SELECT feature_idx, value, least(greatest((upto - same / 2 - 0.5) / greatest(n - 1, 1), 1e-7), 1 - 1e-7) AS p FROM u)
SELECT vec_id, feature_idx, round({scaling.normal_quantile_sql("p")}, 6) + 0.0 AS scaled FROM l JOIN p USING (feature_idx, value)""")
def quantile_normal(spark, d):
    return scaling.quantile_normal(_long(spark, d), ["feature_idx"]).select("vec_id", "feature_idx", r6("scaled"))


# --- selection ---------------------------------------------------------------------------------------------

_SCORES = f"""{L}, per AS (SELECT feature_idx, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL),
w AS (SELECT feature_idx, sum(n) AS t, count(*) AS k, sum(n * m) / sum(n) AS g, sum(n * v) AS within, sum(n * m * m) AS sq FROM per GROUP BY 1),
an AS (SELECT feature_idx, ((sq - t * g * g) / (k - 1)) / (within / (t - k)) AS f FROM w),
ed AS (SELECT feature_idx, min(value) AS lo, max(value) AS hi, var_pop(value) AS variance FROM l GROUP BY 1),
ce AS (SELECT feature_idx, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS bin, y, count(*) AS c FROM l JOIN ed USING (feature_idx) GROUP BY ALL),
mm AS (SELECT *, sum(c) OVER (PARTITION BY feature_idx) AS n, sum(c) OVER (PARTITION BY feature_idx, bin) AS nb, sum(c) OVER (PARTITION BY feature_idx, y) AS nl FROM ce),
mi AS (SELECT feature_idx, sum(c / n * ln(c * n / (nb * nl))) AS mi FROM mm GROUP BY 1),
sc AS (SELECT feature_idx, f, mi, variance FROM an JOIN mi USING (feature_idx) JOIN ed USING (feature_idx))"""


def _scores(spark, d):
    return selection.feature_scores(_long(spark, d, ("vec_id", "y")).withColumnRenamed("y", "label"))


@query(f"WITH {_SCORES} SELECT feature_idx, round(f, 6) AS f FROM an")
def anova_f(spark, d):
    return selection.anova_f(_long(spark, d, ("vec_id", "y")).withColumnRenamed("y", "label")).select("feature_idx", r6("f"))


@query(f"WITH {_SCORES} SELECT feature_idx, round(mi, 6) + 0.0 AS mi FROM mi")
def binned_mi(spark, d):
    return selection.binned_mi(_long(spark, d, ("vec_id", "y")).withColumnRenamed("y", "label")).select("feature_idx", r6("mi"))


def _fused(score: str, k: int) -> str:
    return f"""WITH {_SCORES}, z AS (SELECT *, {score} AS score FROM sc), q AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature_idx) AS place FROM z)
SELECT feature_idx, CAST(place AS INT) AS place, round(score, 6) AS score FROM q WHERE place <= {k}"""


@query(_fused("0.8 * (0.7 * f / max(f) OVER () + 0.3 * mi / max(mi) OVER ()) + 0.2 * variance / (max(variance) OVER () + 1e-8)", 30))
def score_fusion_topk(spark, d):
    return selection.fuse(_scores(spark, d), 0.7, 0.3, 30, variance=0.2).select("feature_idx", "place", r6("score"))


@query(_fused("0.8 * (0.6 * f / max(f) OVER () + 0.4 * mi / max(mi) OVER ()) + 0.2 * variance / (max(variance) OVER () + 1e-8)", 40))
def score_fusion_max(spark, d):
    return selection.fuse(_scores(spark, d), 0.6, 0.4, 40, variance=0.2).select("feature_idx", "place", r6("score"))


@query(_fused("0.6 * (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER () + 1e-8) + 0.4 * (mi - min(mi) OVER ()) / (max(mi) OVER () - min(mi) OVER () + 1e-8)", 30))
def score_fusion_range(spark, d):
    return selection.fuse(_scores(spark, d), 0.6, 0.4, 30, by_range=True).select("feature_idx", "place", r6("score"))


@query(f"""WITH {_SCORES}, z AS (SELECT feature_idx, row_number() OVER (ORDER BY f DESC, feature_idx) + row_number() OVER (ORDER BY mi DESC, feature_idx) - 2 AS borda FROM sc),
q AS (SELECT *, row_number() OVER (ORDER BY borda, feature_idx) AS place FROM z) SELECT feature_idx, CAST(borda AS INT) AS borda, CAST(place AS INT) AS place FROM q WHERE place <= 20""")
def borda_topk(spark, d):
    return selection.borda(_scores(spark, d), 20).select("feature_idx", "borda", "place")


@query(f"""WITH {_SCORES}, q AS (SELECT feature_idx, f, row_number() OVER (ORDER BY f DESC, feature_idx) AS place FROM an)
SELECT feature_idx, CAST(place AS INT) AS place, round(f, 6) AS f FROM q WHERE place <= 10""")
def select_k_best(spark, d):
    rows = _long(spark, d, ("vec_id", "y")).withColumnRenamed("y", "label")
    return selection.top_k(selection.anova_f(rows), "f", 10).select("feature_idx", "place", r6("f"))


@query(f"""WITH {E} SELECT vec_id, y FROM e QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5('42:' || vec_id), vec_id) <= 40""")
def stratified_subsample(spark, d):
    from ..operators.windows import stratified_sample

    return stratified_sample(trials(spark, d), "y", "vec_id", 40, 42).select("vec_id", "y")


# --- folds -------------------------------------------------------------------------------------------------

_SIZES = f"{E}, z AS (SELECT session, trial, count(*) AS n FROM e GROUP BY ALL)"


def _sizes(spark, d):
    return folds.group_sizes(trials(spark, d), ["session"], "trial")


@query(f"""WITH {_SIZES}, q AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, trial DESC) - 1 AS r, count(*) OVER (PARTITION BY session) AS c FROM z)
SELECT session, trial, n, CAST(CASE WHEN c >= 2 THEN r % CASE WHEN c < 5 THEN least(c, 2) ELSE 5 END END AS INT) AS fold FROM q""")
def group_kfold_equal(spark, d):
    return folds.group_kfold(_sizes(spark, d), ["session"], "trial", 5).select("session", "trial", "n", "fold")


@query(f"""WITH RECURSIVE {_SIZES}, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, trial) AS r FROM z),
g(session, r, loads, trial, n, fold) AS (
  SELECT session, r, [CAST(n AS BIGINT), 0, 0], trial, n, 0 FROM o WHERE r = 1
  UNION ALL SELECT o.session, o.r, list_transform(g.loads, lambda v, i: v + CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN o.n ELSE 0 END), o.trial, o.n, list_position(g.loads, list_min(g.loads)) - 1
  FROM g JOIN o ON o.session = g.session AND o.r = g.r + 1)
SELECT session, trial, n, CAST(fold AS INT) AS fold FROM g""")
def group_kfold_greedy(spark, d):
    return folds.group_kfold_greedy(_sizes(spark, d), ["session"], "trial", 3).select("session", "trial", "n", "fold")


_DOMINANT = f"""{E}, c AS (SELECT session, trial, y, count(*) AS c FROM e GROUP BY ALL), dm AS (SELECT session, trial, y AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY session, trial ORDER BY c DESC, y) = 1)"""


@query(f"WITH {_DOMINANT} SELECT session, trial, dominant, CAST((row_number() OVER (PARTITION BY session, dominant ORDER BY trial) - 1) % 3 AS INT) AS fold FROM dm")
def stratified_group_kfold(spark, d):
    return folds.stratified_group_kfold(trials(spark, d), ["session"], "trial", "y", 3).select("session", "trial", "dominant", "fold")


def _trial_sql(f: int) -> str:
    """What a fold would be worth for a group: (spread of the label shares over folds, its rows, its number)."""
    at = lambda g, c: f"(g.load[{3 * g + c + 1}] + {f'o.n[{c + 1}]' if g == f else '0'})"
    spread = lambda c: f"list_stddev_pop([{', '.join(f'{at(g, c)} / o.total[{c + 1}]' for g in range(3))}])"
    return f"{{'s': round((coalesce({spread(0)}, 0) + coalesce({spread(1)}, 0) + coalesce({spread(2)}, 0)) / o.kinds, 9), 'n': {' + '.join(at(f, c) for c in range(3))}, 'f': {f}}}"


@query(f"""WITH RECURSIVE {E},
z AS (SELECT session, trial, [CAST(count(*) FILTER (y = -1) AS DOUBLE), count(*) FILTER (y = 0), count(*) FILTER (y = 1)] AS n FROM e GROUP BY ALL),
w AS (SELECT session, [nullif(sum(n[1]), 0), nullif(sum(n[2]), 0), nullif(sum(n[3]), 0)] AS total FROM z GROUP BY 1),
o AS (SELECT z.session, trial, n, total, len(list_filter(total, lambda x: x IS NOT NULL)) AS kinds,
        row_number() OVER (PARTITION BY z.session ORDER BY round(-list_stddev_pop(list_filter(n, lambda v, i: total[i] IS NOT NULL)), 9), trial) AS r FROM z JOIN w USING (session)),
g(session, r, load, trial, fold) AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT), [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0], CAST(NULL AS INT), CAST(NULL AS INT) FROM o
  UNION ALL
  SELECT session, r, list_transform(load, lambda v, i: v + CASE WHEN (i - 1) // 3 = best.f THEN n[(i - 1) % 3 + 1] ELSE 0 END), trial, CAST(best.f AS INT)
  FROM (SELECT o.session, o.r, g.load, o.trial, o.n, list_min([{_trial_sql(0)}, {_trial_sql(1)}, {_trial_sql(2)}]) AS best FROM g JOIN o ON o.session = g.session AND o.r = g.r + 1))
SELECT session, trial, fold FROM g WHERE r > 0""")
def stratified_group_greedy(spark, d):
    return folds.stratified_group_greedy(trials(spark, d), ["session"], "trial", "y", 3).select("session", "trial", "fold")


@query(f"WITH {E} SELECT subject, CAST(dense_rank() OVER (ORDER BY subject) - 1 AS INT) AS fold FROM (SELECT DISTINCT subject FROM e)")
def leave_one_group_out(spark, d):
    return folds.leave_one_out(trials(spark, d), "subject")


@query(f"WITH {E} SELECT vec_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS INT) AS fold FROM e")
def shuffled_kfold(spark, d):
    return folds.shuffled_kfold(trials(spark, d), "y", "vec_id", 5, 42).select("vec_id", "y", "fold")


@query(f"WITH {E} SELECT concat_ws('_', subject, session, trial) AS grp, count(DISTINCT vec_id // 90 % 5) AS folds FROM e GROUP BY 1 HAVING count(DISTINCT vec_id // 90 % 5) > 1")
def leakage_check(spark, d):
    """A row-wise assignment by vec_id div 90 % 5 leaks wherever a trial has rows in several folds."""
    assigned = trials(spark, d).withColumn("grp", folds.group_key("subject", "session", "trial")).withColumn("fold", F.expr("vec_id div 90 % 5"))
    return folds.leaks(assigned, "grp")


@query(f"""WITH {E}, a AS (SELECT session, trial AS fold, y, count(*) AS c FROM e GROUP BY ALL), t AS (SELECT session, y, sum(c) AS t FROM a GROUP BY ALL),
g AS (SELECT f.session, f.fold, t.y, t, coalesce(c, 0) AS c FROM (SELECT DISTINCT session, fold FROM a) f JOIN t USING (session) LEFT JOIN a ON a.session = f.session AND a.fold = f.fold AND a.y = t.y)
SELECT session, fold, CAST(sum(CASE WHEN t > c THEN 1 ELSE 0 END) AS BIGINT) AS train_classes, CAST(sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS BIGINT) AS test_classes,
  sum(CASE WHEN t > c THEN 1 ELSE 0 END) >= 2 AND sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) >= 2 AS valid FROM g GROUP BY ALL""")
def valid_folds(spark, d):
    return folds.valid_folds(trials(spark, d).withColumn("fold", F.col("trial")), ["session"], "y", 6)


@query(f"WITH {E} SELECT y, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM e GROUP BY 1")
def class_weights(spark, d):
    counts = trials(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.withColumn("weight", r6(F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))))


@query("SELECT CAST(doc_id % 5 AS INT) AS fold, count(*) AS n, round(avg(CAST(quality = toxic AS INT)), 6) AS accuracy FROM labels GROUP BY 1")
def accuracy_by_fold(spark, d):
    rows = table(spark, d, "labels").withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("quality") == F.col("toxic")).cast("double")), "accuracy"))


@query(f"""WITH {L}, p AS (SELECT vec_id, feature_idx % 4 AS model, feature_idx // 4 AS cls, exp(value) AS e FROM l),
n AS (SELECT vec_id, model, cls, e / sum(e) OVER (PARTITION BY vec_id, model) AS p FROM p), v AS (SELECT vec_id, cls, avg(p) AS p FROM n GROUP BY ALL)
SELECT vec_id, CAST(cls AS INT) AS cls, round(p, 6) AS p FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 12) DESC, cls) = 1""")
def soft_vote(spark, d):
    """Four models' class probabilities (a softmax of sixteen numbers each), averaged; the likeliest class."""
    from ..operators.estimators import soft_vote as vote

    rows = _long(spark, d).select("vec_id", (F.col("feature_idx") % 4).alias("model"), F.expr("feature_idx div 4").cast("int").alias("cls"), F.exp("value").alias("e"))
    rows = rows.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("vec_id", "model")))
    return vote(rows, ["vec_id"], "cls", "p").select("vec_id", "cls", r6("p"))


# --- joins -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, count(*) AS lines, round(sum(l_quantity), 6) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def positional_join(spark, d):
    """Aligned by key; the lines are summed before the join, so that less is exchanged."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), r6(F.sum("l_quantity"), "quantity"))
    return joins.align(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def companion_semi(spark, d):
    return joins.with_companion(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT p_partkey AS k, 'left' AS side FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL
SELECT DISTINCT s_suppkey, 'right' FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0) AND s_suppkey % 3 = 0""")
def unmatched_anti(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    both = joins.unmatched(parts, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])
    thirds = joins.unmatched(parts.where("k % 3 > 0"), table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k")), ["k"])
    return both.where("side = 'left'").unionByName(thirds.where("side = 'right'"))


@query("""WITH t(trial, lo, hi, label) AS (VALUES (0, 0, 10, 1), (1, 15, 30, -1), (2, 30, 45, 0)), s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, trial, label, count(*) AS n, round(sum(value), 4) AS total FROM s JOIN t ON pos >= lo AND pos < hi GROUP BY ALL""")
def label_samples(spark, d):
    marks = spark.createDataFrame([(0, 0, 10, 1), (1, 15, 30, -1), (2, 30, 45, 0)], "trial int, start int, end int, label int")
    series = windows.number_samples(table(spark, d, "events").select("user_id", "value", "ts", "event_id"), "user_id", ["ts", "event_id"], F.date_trunc("day", "ts"))
    rows = joins.label_samples(series, marks, "pos")
    return rows.groupBy("user_id", "trial", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH i AS (SELECT o_orderkey, o_custkey * 173 % 2592000 AS lo, o_custkey * 173 % 2592000 + (1 + CAST(floor(o_totalprice) AS BIGINT) % 300) * CASE WHEN o_orderkey % 97 = 0 THEN 100 ELSE 1 END AS hi FROM orders),
p AS (SELECT value, epoch_us(ts) // 1000000 - 1704067200 AS sec FROM events)
SELECT o_orderkey, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM i JOIN p ON sec >= lo AND sec < hi GROUP BY 1""")
def interval_join_events(spark, d):
    """Intervals of seconds to hours, one an order, with the events that fall into each."""
    start = F.expr("o_custkey * 173 % 2592000")
    length = (1 + F.floor("o_totalprice").cast("long") % 300) * F.when(F.col("o_orderkey") % 97 == 0, 100).otherwise(1)
    spans = table(spark, d, "orders").select("o_orderkey", start.alias("start"), (start + length).alias("end"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01', CAST(ts AS TIMESTAMP_NTZ))")
    rows = joins.interval_join(table(spark, d, "events").select("value", seconds.alias("at")), spans, "at", small=1000)
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


@query("SELECT DISTINCT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey < 3")
def group_intersection(spark, d):
    return joins.shared_keys(table(spark, d, "nation").select(F.col("n_regionkey").alias("k")), table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("k")), ["k"])


# --- reports -----------------------------------------------------------------------------------------------


@query(f"WITH {R} SELECT model, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, min(accuracy) AS min, max(accuracy) AS max, count(accuracy) AS n FROM r GROUP BY 1")
def report_by_key(spark, d):
    return report.summary(results(spark, d), ["model"]).select("model", r6("mean"), r6("std"), "min", "max", "n")


KINDS = ("click", "view", "purchase", "signup", "refund", "error", "login", "logout", "scroll", "search")


@query(f"WITH {R} SELECT subject, " + ", ".join(f"round(avg(accuracy) FILTER (model = '{k}'), 6) AS {k}" for k in KINDS) + " FROM r GROUP BY 1")
def report_pivot(spark, d):
    out = report.pivot_mean(results(spark, d), "subject", "model", list(KINDS))
    return out.select("subject", *[r6(k) for k in KINDS])


@query(f"WITH {R} SELECT model, subject, session, fold, event_id, accuracy FROM r ORDER BY accuracy DESC, event_id LIMIT 10")
def report_topk(spark, d):
    return report.extremes(results(spark, d), "accuracy", ["event_id"]).select("model", "subject", "session", "fold", "event_id", "accuracy")


@query(f"WITH {R} SELECT model, subject, session, fold, event_id, accuracy FROM r ORDER BY accuracy, event_id LIMIT 10")
def report_bottomk(spark, d):
    return report.extremes(results(spark, d), "accuracy", ["event_id"], largest=False).select("model", "subject", "session", "fold", "event_id", "accuracy")


@query(f"WITH {R}, g AS (SELECT model, subject, session, stddev_samp(accuracy) AS std FROM r GROUP BY ALL) SELECT model, subject, session, round(std, 6) AS std FROM g ORDER BY g.std DESC NULLS LAST, model, subject, session LIMIT 10")
def report_fold_std(spark, d):
    out = report.summary(results(spark, d), ["model", "subject", "session"])
    return report.extremes(out, "std", ["model", "subject", "session"]).select("model", "subject", "session", r6("std"))


@query(f"WITH {R} SELECT model, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, max(accuracy) AS max, CAST(sum(CASE WHEN accuracy >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN accuracy >= 0.8 THEN 1 ELSE 0 END), 6) AS share FROM r GROUP BY 1")
def report_threshold(spark, d):
    return report.threshold_summary(results(spark, d), ["model"], 0.8).select("model", r6("mean"), r6("std"), "max", "hits", r6("share"))


@query(f"WITH {R} SELECT model, subject, session, fold, event_id, accuracy FROM r WHERE accuracy < 0.2")
def report_low_filter(spark, d):
    return results(spark, d).where("accuracy < 0.2").select("model", "subject", "session", "fold", "event_id", "accuracy")


@query("SELECT 'event_id' AS \"column\", CAST(count(*) FILTER (event_id IS NULL) AS BIGINT) AS nulls FROM events UNION ALL SELECT 'value', CAST(count(*) FILTER (value IS NULL) AS BIGINT) FROM events UNION ALL SELECT 'props', CAST(count(*) FILTER (props IS NULL) AS BIGINT) FROM events")
def report_nulls(spark, d):
    return report.null_counts(table(spark, d, "events").select("event_id", "value", "props"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT CAST(k AS INT) AS bin, round(lo + k * (hi - lo) / 10, 6) AS low, coalesce(n, 0) AS n FROM range(0, 10) r(k) CROSS JOIN e LEFT JOIN c ON c.bin = k""")
def report_histogram(spark, d):
    return report.histogram(table(spark, d, "events"), "value").select("bin", r6("low"), "n")


@query(f"""WITH {R}, g AS (SELECT model, subject, fold, avg(accuracy) AS m, stddev_pop(accuracy) AS s FROM r GROUP BY ALL)
SELECT model, subject, fold, round(m, 6) AS mean, round(s, 6) AS std, round(s / m, 6) AS cv,
  CASE WHEN s / m < 0.15 AND m >= 0.65 THEN 'excellent' WHEN s / m < 0.20 AND m >= 0.60 THEN 'good' WHEN m >= 0.65 THEN 'high, inconsistent' WHEN s / m < 0.20 THEN 'consistent, low' END AS tier FROM g""")
def report_cv_tiers(spark, d):
    return report.stability(results(spark, d), ["model", "subject", "fold"]).select("model", "subject", "fold", r6("mean"), r6("std"), r6("cv"), "tier")


@query("""WITH m AS (SELECT avg(accuracy) FILTER (model = 'click') AS leaky, avg(accuracy) FILTER (model = 'view') AS honest FROM (SELECT event_type AS model, value / 500 AS accuracy FROM events))
SELECT round(leaky, 6) AS leaky, round(honest, 6) AS honest, round((leaky - honest) / honest * 100, 6) AS inflation FROM m""")
def report_inflation(spark, d):
    return report.inflation(results(spark, d), "model", "click", "view").select(r6("leaky"), r6("honest"), r6("inflation"))


@query(f"WITH {R}, g AS (SELECT model, subject, avg(accuracy) AS m FROM r GROUP BY ALL) SELECT model, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max FROM g GROUP BY 1")
def report_two_level(spark, d):
    return report.two_level(results(spark, d), ["model", "subject"], ["model"]).select("model", r6("mean"), r6("std"), r6("min"), r6("max"))


@query(f"WITH {R} SELECT model, subject, session, round(avg(accuracy), 6) AS mean, max(accuracy) AS max FROM r GROUP BY ALL")
def report_session(spark, d):
    return report.summary(results(spark, d), ["model", "subject", "session"]).select("model", "subject", "session", r6("mean"), "max")


@query(f"WITH {R} SELECT 'event' AS origin, model AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY 2")
def report_union(spark, d):
    a = results(spark, d).groupBy(F.col("model").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("event").alias("origin"), "name", "n")
    b = table(spark, d, "embeddings").groupBy(F.col("label").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("origin"), "name", "n")
    return a.unionByName(b)


@query(f"WITH {E} SELECT y, count(*) AS n, count(DISTINCT concat_ws('_', subject, session, trial)) AS trials FROM e GROUP BY 1")
def report_value_counts(spark, d):
    return trials(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(folds.group_key("subject", "session", "trial")).alias("trials"))


@query("SELECT DISTINCT event_type AS model FROM events")
def report_distinct(spark, d):
    return results(spark, d).select("model").distinct()


@query(f"""WITH {E}, c(y, cls) AS (SELECT * FROM (VALUES (-1), (0), (1)) a(y), (VALUES (-1), (0), (1)) b(cls))
SELECT vec_id, cls, CAST(e.y = cls AS INT) AS target FROM e JOIN c ON c.y = e.y""")
def one_vs_rest(spark, d):
    classes = F.array(*map(F.lit, (-1, 0, 1)))
    return trials(spark, d).select("vec_id", "y", F.explode(classes).alias("cls")).select("vec_id", "cls", (F.col("y") == F.col("cls")).cast("int").alias("target"))


@query(f"WITH {E} SELECT vec_id, y, CAST(y = 1 AS INT) AS target FROM e WHERE y <> 0")
def neutral_filter_remap(spark, d):
    return trials(spark, d).where("y <> 0").select("vec_id", "y", (F.col("y") == 1).cast("int").alias("target"))


@query("""SELECT 'windows match' AS "check", bool_and(len(list_filter(range(0, len(embedding)), lambda s: s % 8 = 0 AND s + 16 <= len(embedding))) = CASE WHEN len(embedding) < 16 THEN 0 ELSE (len(embedding) - 16) // 8 + 1 END) AS ok FROM embeddings
UNION ALL SELECT 'keys unique', count(vec_id) = count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'vector length', bool_and(len(embedding) = 64) FROM embeddings
UNION ALL SELECT 'start before end', bool_and(a < b) FROM (SELECT min(vec_id) AS a, max(vec_id) + 1 AS b FROM embeddings GROUP BY vec_id % 10, vec_id // 10 % 3)""")
def validation_checks(spark, d):
    from ..operators.checks import run_checks

    return run_checks(trials(spark, d))
