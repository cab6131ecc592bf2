import numpy as np
from pyspark.sql import functions as F

from quaywave.functions.transforms import fit_pca, second_moments
from quaywave.operators import estimators, folds, scaling, selection


def groups(spark):
    sizes = [30, 25, 20, 15, 10, 5]
    rows = [(1, g, (g + i) % 2, g * 100 + i) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "s int, g int, y int, id int")


def test_greedy_folds_balance_unequal_groups(spark):
    sizes = folds.group_sizes(groups(spark), ["s"], "g")
    out = folds.group_kfold_greedy(sizes, ["s"], "g", 3).collect()
    loads = {}
    for r in out:
        loads[r["fold"]] = loads.get(r["fold"], 0) + r["n"]
    assert sorted(loads.values()) == [35, 35, 35] and len({r["g"] for r in out}) == 6


def test_no_group_spans_folds_and_every_row_is_tested_once(spark):
    rows = groups(spark)
    for assigned in (folds.group_kfold(folds.group_sizes(rows, ["s"], "g"), ["s"], "g", 5), folds.stratified_group_kfold(rows, ["s"], "g", "y", 3), folds.stratified_group_greedy(rows, ["s"], "g", "y", 3)):
        full = rows.join(assigned.select("g", "fold"), "g")
        assert full.count() == rows.count() and folds.leaks(full, "g").count() == 0
    leaky = folds.shuffled_kfold(rows, "y", "id", 5, 1)
    assert folds.leaks(leaky, "g").count() > 0


def test_few_groups(spark):
    sizes = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 5), (2, 1, 5)], "s int, g int, n int")
    out = {(r["s"], r["g"]): r["fold"] for r in folds.group_kfold(sizes, ["s"], "g", 5).collect()}
    assert out[(2, 1)] is None and {out[(1, g)] for g in (1, 2, 3)} == {0, 1}


def test_valid_folds_see_both_sides(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0), (2, 1)], "fold int, y int")
    out = {r["fold"]: r["valid"] for r in folds.valid_folds(rows, [], "y", 3).collect()}
    assert out == {0: True, 1: False, 2: False}


def test_robust_and_standard_scaling(spark):
    values = [1.0, 2.0, 3.0, 4.0, 10.0, 20.0, 7.0]
    rows = spark.createDataFrame([(0, v) for v in values] + [(1, 5.0)] * 3, "feature_idx int, value double")
    robust = {r["feature_idx"]: (r["mean"], r["std"]) for r in scaling.fit_robust(rows, ["feature_idx"]).collect()}
    q = np.percentile(values, [25, 50, 75])
    assert robust[0] == (q[1], q[2] - q[0]) and robust[1] == (5.0, 1.0)
    assert {r["std"] for r in scaling.fit_standard(rows.where("feature_idx = 1"), ["feature_idx"]).collect()} == {1.0}


def test_normal_quantile(spark):
    ps = [1e-7, 0.01, 0.31, 0.5, 0.8, 0.999]
    told = [r["q"] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(scaling.normal_quantile(F.col("p")).alias("q")).collect()]
    from statistics import NormalDist

    assert np.allclose(told, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)


def test_f_score_ignores_scale(spark):
    rng = np.random.default_rng(3)
    rows = [(f, int(y), float(v * (1 if f == 0 else 1000))) for y in (0, 1, 2) for v in rng.normal(y, 1, 30) for f in (0, 1)]
    f = {r["feature_idx"]: r["f"] for r in selection.anova_f(spark.createDataFrame(rows, "feature_idx int, label int, value double")).collect()}
    assert np.isclose(f[0], f[1])


def test_pca_from_sums_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    mean, components, share = fit_pca(second_moments(rows, [], "x").first(), 0.95)
    value = np.sort(np.linalg.eigvalsh(np.cov(x.T, ddof=0)))[::-1]
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(share, (value / value.sum())[: len(share)])
    assert np.allclose(components.T @ components, np.eye(components.shape[1]))


def test_fold_models_skip_single_class_training(spark):
    rows = spark.createDataFrame([(0, f, i, f, [float(i), 1.0]) for f in (0, 1) for i in range(4)], "s int, fold int, id int, y int, x array<double>")
    assert estimators.predict_folds(rows, ["s"], "x", "y", "fold", "id", ["lda"]).count() == 0


def test_power_transform_by_aggregations(spark):
    import numpy as np

    from quaywave.functions import kernels, transforms
    from quaywave.operators import scaling

    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=300), rng.exponential(size=300) - 0.3, -rng.exponential(size=300)], axis=1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    lam = {r["feature_idx"]: r["lam"] for r in scaling.fit_yeo_johnson(scaling.long_form(rows, ["id"], "x")).collect()}
    assert all(abs(lam[f] - kernels.yeo_johnson_fit(x[:, f])) < 1e-4 for f in range(3))
    r = transforms.second_moments(rows.repartition(7), [], "x").first()
    assert r["n"] == 300 and np.allclose(r["total"], x.sum(axis=0)) and np.allclose(np.array(r["products"]).reshape(3, 3), x.T @ x)
