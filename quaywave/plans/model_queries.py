"""Arrow-kernel transforms, fitted transforms, models, and the event-time windows of the streaming part."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, transforms
from ..functions.stages import FoldFeatures
from ..operators import blocks, estimators, information, scaling, search, spectral, sums, windows
from ..ship import ship
from ..sources.scratch import settle
from ..streaming.hopping import hopping_features
from .registry import L, query, r6, table, trials
from .signal_queries import WELCH

FS = 128.0


def _values(rows, key, array, name):
    return rows.select(key, F.posexplode(array).alias("idx", name)).select(key, "idx", r6(name))


@query()
def filter_zero_phase(spark, d):
    """Band-pass on the whole trial, then the notch."""
    rows = trials(spark, d).withColumn("x", transforms.remove_hum(transforms.bandpass("embedding", FS), FS))
    return _values(rows, "vec_id", "x", "filtered")


@query()
def stockwell_de(spark, d):
    rows = trials(spark, d).withColumn("de", transforms.stockwell_entropy("embedding", FS, spectral.BANDS_DE))
    return _values(rows, "vec_id", "de", "de")


@query()
def stockwell_amplitude_de(spark, d):
    rows = trials(spark, d).withColumn("de", transforms.stockwell_amplitude_entropy("embedding", FS, spectral.BANDS_DE))
    return _values(rows, "vec_id", "de", "de")


@query()
def band_filtered_de(spark, d):
    rows = trials(spark, d).withColumn("de", transforms.filtered_entropy("embedding", FS, spectral.safe_bands(spectral.BANDS_DE, FS)))
    return _values(rows, "vec_id", "de", "de")


@query()
def filter_per_window(spark, d):
    """The older order and form: windows first, each filtered on its own by one direct form; other numbers than whole trials by sections."""
    cut = windows.cut_windows(trials(spark, d), "embedding", 32, 16)
    rows = cut.withColumn("x", transforms.remove_hum_direct(transforms.bandpass_direct("samples", FS), FS))
    return rows.select("vec_id", "window_idx", F.posexplode("x").alias("idx", "filtered")).select("vec_id", "window_idx", "idx", r6("filtered"))


@query(f"""WITH {WELCH}, b(band, low, high) AS (VALUES ('theta', 4, 7), ('alpha', 8, 12), ('beta', 13, 25))
SELECT vec_id, band, round(ln(avg(density) + 1e-8), 6) + 0.0 AS log_power FROM dn JOIN b ON bin * 4 BETWEEN low AND high GROUP BY ALL""")
def welch_band_power(spark, d):
    """Log power of three bands over the Welch density."""
    rows = spectral.welch(trials(spark, d), "embedding", FS, 32, 64)
    bands = [("theta", 4.0, 7.0), ("alpha", 8.0, 12.0), ("beta", 13.0, 25.0)]
    return spectral.band_power(rows, "vec_id", "psd", FS / 32, bands).select("vec_id", "band", r6("log_power"))


@query()
def band_log_powers(spark, d):
    """Every other channel of eight: log variance in three bands."""
    channels = trials(spark, d).select("vec_id", F.posexplode(F.array(*[F.slice("embedding", 1 + 8 * c, 8) for c in range(0, 8, 2)])).alias("c", "x"))
    bands = [("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]
    out = channels.withColumn("p", transforms.band_log_power("x", FS, bands)).select("vec_id", (2 * F.col("c")).alias("channel"), F.posexplode("p").alias("band", "v"))
    return out.select("vec_id", "channel", "band", r6("v", "log_power"))


@query()
def wavelet_logvar(spark, d):
    return _values(trials(spark, d).withColumn("w", transforms.wavelet_log_variance("embedding")), "vec_id", "w", "logvar")


@query(f"WITH {WELCH} SELECT vec_id, bin AS idx, round(density, 6) + 0.0 AS density FROM dn")
def welch_density_arrow(spark, d):
    return _values(trials(spark, d).withColumn("p", transforms.welch_density("embedding", FS, 32)), "vec_id", "p", "density")


@query()
def pca_variance(spark, d):
    """Components that explain 95 %: fitted from one row of sums, applied in Arrow batches."""
    rows = trials(spark, d)
    mean, components, _ = transforms.fit_pca(transforms.second_moments(rows, [], "embedding").first(), 0.95)
    return _values(rows.withColumn("p", transforms.project("embedding", mean, components)), "vec_id", "p", "score")


@query()
def ica_unmix(spark, d):
    """Independent components of the first twenty principal ones, fitted on all rows."""
    rows = trials(spark, d)
    moments = transforms.second_moments(rows, [], "embedding").first()
    mean, components, _ = transforms.fit_pca(moments, 1.0)
    components = components[:, :20]
    cov = np.array(moments["products"]).reshape(len(mean), -1) / moments["n"] - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(components.T @ cov @ components), 0))
    white = components / np.where(scale == 0, 1, scale)
    unmix = transforms.fit_ica(rows, "embedding", mean, white)
    return _values(rows.withColumn("s", transforms.project("embedding", mean, white @ unmix.T)), "vec_id", "s", "source")


def _time_points():
    """A vector as 8 channels of 8 samples: the channels' values at each time, an array of arrays."""
    at = lambda t: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.get("embedding", c * 8 + t))
    return F.array(*map(at, range(8)))


@query()
def csp_logpower(spark, d):
    """Common spatial patterns over 8 channels of 8 samples: class covariances are distributed sums of outer products."""
    rows = trials(spark, d).where("y <> 0")
    series = rows.select("vec_id", "y", F.posexplode(_time_points()).alias("t", "x"))
    sums = {r["y"]: r for r in transforms.second_moments(series, ["y"], "x").collect()}  # one row per class
    cov = {y: np.array(r["products"]).reshape(8, 8) / r["n"] for y, r in sums.items()}
    filters = kernels.csp_filters(cov[-1], cov[1], 4)
    projected = series.withColumn("p", transforms.project("x", np.zeros(8), filters))
    long = projected.select("vec_id", F.posexplode("p").alias("component", "v"))
    return long.groupBy("vec_id", "component").agg(r6(F.ln(F.avg(F.col("v") * F.col("v")) + 1e-10), "log_power"))


@query(f"""WITH {L}, x AS (SELECT vec_id, y, feature_idx // 8 AS c, feature_idx % 8 AS t, value FROM l WHERE y <> 0)
SELECT a.y, CAST(a.c AS INT) AS c1, CAST(b.c AS INT) AS c2, round(avg(a.value * b.value), 6) + 0.0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.t = b.t GROUP BY ALL""")
def csp_covariances(spark, d):
    """The class covariances that the patterns are solved from: distributed sums of outer products."""
    rows = trials(spark, d).where("y <> 0")
    series = rows.select("y", F.explode(_time_points()).alias("x"))
    sums_ = transforms.second_moments(series, ["y"], "x").select("y", "n", F.posexplode("products").alias("at", "p"))
    return sums_.select("y", F.expr("at div 8").cast("int").alias("c1"), (F.col("at") % 8).cast("int").alias("c2"), r6(F.col("p") / F.col("n"), "cov"))


@query(f"""WITH {L} SELECT feature_idx, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS variance FROM l GROUP BY 1""")
def pca_moments(spark, d):
    """Means and variances of the row of sums that the components are solved from; the components' variances add up to theirs."""
    held = transforms.second_moments(trials(spark, d), [], "embedding")
    mean = lambda i: F.get("total", i) / F.col("n")
    square = F.get("products", F.col("feature_idx") * 65) / F.col("n")
    each = held.select("n", "total", "products", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("feature_idx"))
    return each.select("feature_idx", "n", r6(mean(F.col("feature_idx")), "mean"), r6(square - mean(F.col("feature_idx")) * mean(F.col("feature_idx")), "variance"))


@query()
def csp_multiband(spark, d):
    """Patterns of each of three bands: the channels' series band-passed first, covariances per band and class from one pass."""
    rows = trials(spark, d).where("y <> 0")
    channels = rows.select("vec_id", "y", F.posexplode(F.array(*[F.slice("embedding", 1 + 8 * c, 8) for c in range(8)])).alias("c", "x"))
    bands = [("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]
    passed = channels.select("vec_id", "y", "c", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), transforms.bandpass("x", FS, lo, hi).alias("x")) for b, lo, hi in bands])).alias("p"))
    whole = passed.select("vec_id", "y", "c", "p.band", "p.x").groupBy("vec_id", "y", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda v: v["x"]).alias("m"))  # eight channels
    series = whole.select("vec_id", "y", "band", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform("m", lambda ch: F.get(ch, t)))).alias("t", "x"))
    sums = {(r["band"], r["y"]): r for r in transforms.second_moments(series, ["band", "y"], "x").collect()}  # one row per band and class
    cov = {k: np.array(r["products"]).reshape(8, 8) / r["n"] for k, r in sums.items()}
    out = None
    for band, _, _ in bands:
        filters = kernels.csp_filters(cov[band, -1], cov[band, 1], 4)
        projected = series.where(F.col("band") == band).withColumn("p", transforms.project("x", np.zeros(8), filters))
        out = projected if out is None else out.unionByName(projected)
    long = out.select("vec_id", "band", F.posexplode("p").alias("component", "v"))
    return long.groupBy("vec_id", "band", "component").agg(r6(F.ln(F.avg(F.col("v") * F.col("v")) + 1e-10), "log_power"))


@query()
def csp_one_vs_rest(spark, d):
    """Patterns of each of the three classes against the rest: the rest's covariance is a difference of sums."""
    rows = trials(spark, d)
    series = rows.select("vec_id", "y", F.posexplode(_time_points()).alias("t", "x"))
    sums = transforms.second_moments(series, ["y"], "x").collect()  # one row per class
    total, n = sum(np.array(r["products"]) for r in sums), sum(r["n"] for r in sums)
    parts = []
    for r in sorted(sums, key=lambda r: r["y"]):
        own = np.array(r["products"])
        parts.append(kernels.csp_filters((own / r["n"]).reshape(8, 8), ((total - own) / (n - r["n"])).reshape(8, 8), 2))
    projected = series.withColumn("p", transforms.project("x", np.zeros(8), np.concatenate(parts, axis=1)))
    long = projected.select("vec_id", F.posexplode("p").alias("component", "v"))
    return long.groupBy("vec_id", "component").agg(r6(F.ln(F.avg(F.col("v") * F.col("v")) + 1e-10), "log_power"))


@query()
def yeo_johnson(spark, d):
    """A power transform per feature, fitted by aggregations, then standardised."""
    rows = scaling.long_form(trials(spark, d), ["vec_id"], "embedding")
    lam = F.broadcast(scaling.fit_yeo_johnson(rows))  # a row per feature
    moved = rows.join(lam, "feature_idx").withColumn("value", scaling.yeo_johnson(F.col("value"), F.col("lam"))).drop("lam")
    return scaling.transform(moved, F.broadcast(scaling.fit_standard(moved, ["feature_idx"])), ["feature_idx"]).select("vec_id", "feature_idx", r6("scaled"))


@query(f"""WITH {L}, g(lam) AS (VALUES (-1.0::DOUBLE), (0.0), (0.5), (1.0), (2.0), (3.5)),
t AS (SELECT feature_idx, lam, CASE WHEN value >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + value) ELSE (pow(value + 1, lam) - 1) / lam END
        ELSE CASE WHEN lam = 2 THEN -ln(1 - value) ELSE -(pow(1 - value, 2 - lam) - 1) / (2 - lam) END END AS z FROM l, g)
SELECT feature_idx, lam, round(avg(z), 6) + 0.0 AS mean, round(var_pop(z), 6) + 0.0 AS variance FROM t GROUP BY ALL""")
def yeo_johnson_at(spark, d):
    """The power transform at six exponents, its two limits among them."""
    rows = scaling.long_form(trials(spark, d), ["vec_id"], "embedding").withColumn("lam", F.explode(F.array(*map(F.lit, (-1.0, 0.0, 0.5, 1.0, 2.0, 3.5)))))
    z = scaling.yeo_johnson(F.col("value"), F.col("lam"))
    return rows.groupBy("feature_idx", "lam").agg(r6(F.avg(z), "mean"), r6(F.var_pop(z), "variance"))


@query()
def stage_features(spark, d):
    """The fitted features as a stage: fitted on two folds, applied to the third."""
    rows = trials(spark, d).where("y <> 0").withColumn("label", (F.col("y") == 1).cast("double"))
    model = FoldFeatures(inputCol="embedding", top=20).fit(rows.where("trial % 3 <> 0"))
    out = model.transform(rows.where("trial % 3 = 0")).select("vec_id", vector_to_array("chosen").alias("v"))
    return _values(out, "vec_id", "v", "value")


@query()
def filter_long_series(spark, d):
    """Band-pass and notch over series of any length, in blocks of 256 samples: an event type's values in order of time."""
    series = table(spark, d, "events").where("event_type IS NOT NULL AND value IS NOT NULL").select("event_type", "ts", "event_id", "value")
    numbered = windows.number_samples(series, "event_type", ["ts", "event_id"], F.date_trunc("day", "ts"))
    cut = blocks.cut_blocks(numbered, "event_type", "value", 256)
    calm = blocks.zero_phase_blocks(blocks.zero_phase_blocks(cut, "event_type", kernels.butterworth_bandpass(4, 1, 50, FS)), "event_type", kernels.notch(50, 30, FS))
    return calm.select("event_type", "block", F.posexplode("x").alias("idx", "value")).select("event_type", "block", "idx", r6("value"))


def _psi(n: str) -> str:
    """information.digamma as SQL text."""
    x = f"(CAST({n} AS DOUBLE) + 6)"
    f, down = f"(1 / ({x} * {x}))", " + ".join(f"1 / (CAST({n} AS DOUBLE) + {j})" for j in range(6))
    return f"(ln({x}) - 0.5 / {x} - {f} * (1.0::DOUBLE / 12 - {f} * (1.0::DOUBLE / 120 - {f} / 252)) - ({down}))"


@query(f"""WITH {L}, sd AS (SELECT feature_idx, greatest(stddev_pop(value), 1e-12) AS s FROM l GROUP BY 1),
p AS (SELECT vec_id, feature_idx, y, value / s + 1e-10 * (CAST('0x' || substr(md5(feature_idx || ':' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5) AS x FROM l JOIN sd USING (feature_idx)),
w AS (SELECT *, count(*) OVER (PARTITION BY feature_idx, y) AS n,
        [0, {", ".join(f"coalesce(x - lag(x, {i}) OVER o, 'inf'::DOUBLE)" for i in (1, 2, 3))}] AS lo, [0, {", ".join(f"coalesce(lead(x, {i}) OVER o - x, 'inf'::DOUBLE)" for i in (1, 2, 3))}] AS hi
      FROM p WINDOW o AS (PARTITION BY feature_idx, y ORDER BY x)),
k AS (SELECT *, least(3, n - 1) AS k FROM w WHERE n > 1),
r AS (SELECT *, list_min(list_transform(range(0, k + 1), lambda i: greatest(lo[i + 1], hi[k - i + 1]))) * (1 - 1e-9) AS d FROM k),
m AS (SELECT r.feature_idx, r.y, r.n, r.k, r.vec_id, count(*) AS m FROM r JOIN p ON p.feature_idx = r.feature_idx AND p.x >= r.x - r.d AND p.x <= r.x + r.d GROUP BY ALL)
SELECT feature_idx, round(greatest(0, {_psi("count(*)")} + (sum({_psi("k")} - {_psi("n")}) - sum({_psi("m")})) / count(*)), 6) + 0.0 AS mi FROM m GROUP BY 1""")
def knn_mutual_information(spark, d):
    """The k nearest of the own class by blocks of ranks with a halo; what lies within by running counts over ranges of values."""
    rows = trials(spark, d).select("vec_id", "y", F.posexplode("embedding").alias("feature_idx", "value"))
    return information.knn_information(rows, "y", noise=information.tie_break("feature_idx", "vec_id")).select("feature_idx", r6("mi"))


def _folded(spark, d):
    return trials(spark, d).where("y <> 0").withColumn("fold", F.expr("trial % 3").cast("int"))


def _fold_accuracy(name):
    def run(spark, d):
        if name in sums.FITS:  # from sums: one pass for all folds
            out = sums.predict_from_sums(_folded(spark, d), ["subject", "session"], "embedding", "y", "fold", "vec_id", (name,))
        else:
            out = estimators.predict_folds(_folded(spark, d), ["subject", "session"], "embedding", "y", "fold", "vec_id", [name])
        return estimators.accuracy(out, ["subject", "session", "fold", "model"], "y").select("subject", "session", "fold", "model", "n", r6("accuracy"))

    run.__name__ = f"{name}_fold_accuracy"
    return query()(run)


for _name in estimators.MODELS:
    _fold_accuracy(_name)


@query()
def nested_grid(spark, d):
    grid = [(c, g) for c in (1.0, 5.0, 10.0, 20.0) for g in (None, 0.001, 0.01, 0.1)]  # None: 1 / (features x variance)
    out = estimators.nested_grid(_folded(spark, d).withColumn("fold", F.col("trial")), ["subject", "session"], "embedding", "y", "fold", grid)
    return out.select("subject", "session", "fold", "c", "gamma", r6("accuracy"))


def random_search(rows, by, array, label, fold, times=16, seed=0):
    """c and gamma drawn log-uniformly: the search whose trials are independent, so they run as one grid."""
    rng = np.random.default_rng(seed)
    grid = list(zip((10 ** rng.uniform(-2, 3, times)).tolist(), (10 ** rng.uniform(-4, 1, times)).tolist()))
    return estimators.nested_grid(rows, by, array, label, fold, grid)


@query()
def search_log_uniform(spark, d):
    out = random_search(_folded(spark, d).withColumn("fold", F.col("trial")), ["subject", "session"], "embedding", "y", "fold", times=50)
    return out.select("subject", "session", "fold", r6("c"), r6("gamma"), r6("accuracy"))


@query()
def search_tpe(spark, d):
    """Fifty trials of C and gamma for every session, led by two Parzen densities; the ten first anywhere, then ten a round for all sessions."""
    rows, by, bounds = _folded(spark, d), ["subject", "session"], [(1e-2, 1e3), (1e-4, 1e1)]

    def errors(points):
        c, gamma = search.to_range("x", bounds)
        return estimators.inner_errors(rows, points.withColumns({"c": c, "gamma": gamma}), by, "embedding", "y", "fold")

    done = search.search(rows.select(*by).distinct(), by, 2, errors, trials=50, start=10, batch=10)
    best = done.groupBy(*by).agg(F.min_by(F.struct("x", "loss"), F.struct(F.coalesce("loss", F.lit(2.0)), "nth")).alias("b"), F.count(F.lit(1)).alias("trials"))
    c, gamma = search.to_range(F.col("b.x"), bounds)
    return best.select(*by, "trials", r6(c, "c"), r6(gamma, "gamma"), r6(1 - F.col("b.loss"), "accuracy"))


def _pooled(spark, d):
    """Pooled over sessions: vectors, a 0/1 target, balanced weights.

    Dealt by the rows' ids and written once: estimators read their rows very often, by as many tasks as these lie in, and a small file is one."""
    rows = _folded(spark, d).withColumn("target", (F.col("y") == 1).cast("double"))
    counts = rows.groupBy("target").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"))
    weights = counts.join(F.broadcast(total)).select("target", (F.col("t") / (F.col("k") * F.col("c"))).alias("weight"))
    x = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    pooled = rows.join(F.broadcast(weights), "target").select("vec_id", "fold", "target", "weight", "embedding")
    return _spread(pooled).withColumn("features", x).select("vec_id", "fold", "target", "weight", "features")


def _spread(rows):
    """rows in as many files as the session has cores, each in order of vec_id: how a table's file is cut decides nothing."""
    return settle(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "vec_id").sortWithinPartitions("vec_id"), "pooled")


_COMMON = {"featuresCol": "features", "labelCol": "target"}
_ESTIMATORS = {
    "forest": lambda: RandomForestClassifier(numTrees=150, maxDepth=12, minInstancesPerNode=2, featureSubsetStrategy="sqrt", weightCol="weight", seed=7, cacheNodeIds=True, **_COMMON),
    # Extremely randomised trees have no Spark form: a forest without bootstrap on fewer features stands in.
    "extra_trees_substitute": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, featureSubsetStrategy="log2", bootstrap=False, weightCol="weight", seed=8, cacheNodeIds=True, **_COMMON),
    "gbt": lambda: GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, weightCol="weight", seed=7, **_COMMON),
    "mlp": lambda: MultilayerPerceptronClassifier(layers=[64, 64, 32, 2], maxIter=300, seed=7, **_COMMON),
    "logistic_pooled": lambda: LogisticRegression(regParam=0.01, weightCol="weight", **_COMMON),
}


_FOLDS = (0, 1, 2)
#: Fits that run side by side: much of a fit is short jobs and the driver's work between them, in which cores stand idle.
_AT_ONCE = 3


def _left_out_scores(rows, names, sets):
    """left, vec_id, fold, target, model, p1: for each set of folds the models fitted on the other rows, which score the set's own.

    A set is fitted once, whatever its scores are for, and its scores are written as soon as its models stand, so that no model is kept."""
    spark = rows.sparkSession

    def one(left):
        train, test = rows.where(~F.col("fold").isin(*left)), rows.where(F.col("fold").isin(*left))
        out = None
        for name in names:
            scored = _ESTIMATORS[name]().fit(train).transform(test)
            part = scored.select(F.array(*map(F.lit, left)).alias("left"), "vec_id", "fold", "target", F.lit(name).alias("model"), vector_to_array("probability")[1].alias("p1"))
            out = part if out is None else out.unionByName(part)
        return settle(out, "scores")

    with ThreadPool(min(_AT_ONCE, len(sets))) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(one), sets, chunksize=1))


def _ml_probabilities(rows, names, folds=_FOLDS):
    """Every row of the folds, scored by models fitted on the other rows."""
    return _left_out_scores(rows, names, [(f,) for f in folds]).drop("left")


def _ml_accuracy(name):
    def run(spark, d):
        out = _ml_probabilities(_pooled(spark, d), [name])
        hit = ((F.col("p1") > 0.5).cast("double") == F.col("target")).cast("double")
        return out.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(hit), "accuracy"))

    run.__name__ = f"{name}_fold_accuracy"
    return query()(run)


for _name in _ESTIMATORS:
    _ml_accuracy(_name)


@query()
def voting_ensemble(spark, d):
    """Soft voting of a forest, boosted trees and a logistic model."""
    p = _ml_probabilities(_pooled(spark, d), ["forest", "gbt", "logistic_pooled"])
    both = p.select("vec_id", "fold", F.explode(F.array(F.struct(F.lit(0).alias("cls"), (1 - F.col("p1")).alias("p")), F.struct(F.lit(1).alias("cls"), F.col("p1").alias("p")))).alias("x")).select("vec_id", "fold", "x.*")
    return estimators.soft_vote(both, ["vec_id", "fold"], "cls", "p").select("vec_id", "fold", "cls", r6("p"))


@query()
def stacking_ensemble(spark, d):
    """Out-of-fold probabilities of two models, joined on the row key, feed a logistic model; so for each fold.

    A model that leaves two folds out serves both as the tested one: what it says of either goes to the meta-model of the other."""
    rows, names = _pooled(spark, d), ["forest", "logistic_pooled"]
    pairs = list(combinations(_FOLDS, 2))
    scores = _left_out_scores(rows, names, [*pairs, *((f,) for f in _FOLDS)])
    outer = F.when(F.size("left") == 1, F.col("fold")).otherwise(F.element_at(F.array_except("left", F.array("fold")), 1))
    wide = scores.withColumn("outer", outer).groupBy("outer", "vec_id", "fold", "target").pivot("model", names).agg(F.first("p1"))
    wide = settle(wide, "stacked").withColumn("features", array_to_vector(F.array(*names)))
    out = None
    for fold in _FOLDS:
        meta, test = (wide.where((F.col("outer") == fold) & known) for known in (F.col("fold") != fold, F.col("fold") == fold))
        final = LogisticRegression(featuresCol="features", labelCol="target", regParam=0.01).fit(meta)
        part = final.transform(test)
        out = part if out is None else out.unionByName(part)
    return out.select("vec_id", "fold", F.col("prediction").cast("int").alias("cls"), r6(vector_to_array("probability")[1], "p"))


@query()
def pooled_grid_search(spark, d):
    """Cross-validated grid over group folds given as a column."""
    rows = _pooled(spark, d).withColumn("fold", F.col("fold").cast("int"))
    model = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight")
    grid = ParamGridBuilder().addGrid(model.regParam, [0.001, 0.1]).addGrid(model.elasticNetParam, [0.0, 0.5]).build()
    score = MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy")
    found = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=score, numFolds=3, foldCol="fold", parallelism=2).fit(rows)
    points = [(float(p[model.regParam]), float(p[model.elasticNetParam]), float(a)) for p, a in zip(grid, found.avgMetrics)]
    return spark.createDataFrame(points, "reg double, elastic double, accuracy double").select("reg", "elastic", r6("accuracy"))


@query()
def recordings_to_accuracy(spark, d):
    """The whole way: trials to window features, to a cross-validated ensemble per session, to a summary."""
    from . import lifecycle

    rows = trials(spark, d).select("subject", "session", "trial", "vec_id", "y", "embedding")
    recording = rows.select("subject", "session", F.col("vec_id").cast("int").alias("trial_idx"), "y", F.posexplode(F.array(*[F.slice("embedding", 1 + 16 * c, 16) for c in range(4)])).alias("channel", "samples"))
    table_ = lifecycle.window_table(recording, fs=FS, size=8, step=4, cap=20, pairs=[(0, 1), (2, 3)], channels=4)
    out = lifecycle.cross_validate(table_.withColumn("group", F.pmod("trial_idx", F.lit(11))), k=3, top=150)
    return lifecycle.report_table(out).select("classifier", "session", r6("mean"), "folds")


@query("""
WITH w AS (SELECT user_id, value, to_timestamp(floor(epoch(ts) / 1800) * 1800 - k * 1800) AS s FROM events, range(0, 2) r(k))
SELECT user_id, CAST(s AT TIME ZONE 'UTC' AS TIMESTAMP) AS window_start, CAST(s AT TIME ZONE 'UTC' AS TIMESTAMP) + INTERVAL 1 HOUR AS window_end, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, min(value) AS min, max(value) AS max
FROM w GROUP BY ALL""")
def hopping_windows(spark, d):
    out = hopping_features(table(spark, d, "events"), "user_id", "ts", "value", "1 hour", "30 minutes")
    return out.select("user_id", "window_start", "window_end", "n", r6("mean"), r6("std"), "min", "max")
