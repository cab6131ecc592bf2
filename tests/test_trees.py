import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywave.functions import trees
from quaywave.operators import scaling


def _rings(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    return x, np.where(x[:, 0] * x[:, 1] > 0, 1, -1)


@pytest.mark.parametrize("fit", [trees.extra_trees, trees.boosted])
def test_interaction_is_learnt(fit):
    x, y = _rings()
    classes, p = fit(x[:180], y[:180], x[180:])
    assert list(classes) == [-1, 1] and np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert (classes[np.argmax(p, axis=1)] == y[180:]).mean() > 0.75
    assert np.array_equal(p, fit(x[:180], y[:180], x[180:])[1])


@pytest.mark.parametrize("fit", [trees.extra_trees, trees.boosted])
def test_three_classes_and_constant_columns(fit):
    x = np.repeat(np.arange(3.0), 20)[:, None] * np.array([1.0, 0.0])
    classes, p = fit(x, np.repeat(["a", "b", "c"], 20), np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]))
    assert list(classes[np.argmax(p, axis=1)]) == ["a", "b", "c"]
    whole = {"rows_share": 1.0} if fit is trees.boosted else {}  # a share of the rows needn't be balanced
    assert np.allclose(fit(np.ones((6, 2)), np.array([0, 1] * 3), np.ones((1, 2)), **whole)[1], 0.5)


def test_best_cut_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, g, h = rng.integers(0, 6, (25, 4)).astype(float), rng.normal(size=25), rng.uniform(0.1, 0.3, 25)
        worth = lambda m: max(abs(g[m].sum()) - 0.1, 0) ** 2 / (h[m].sum() + 1.0)
        every = [worth(x[:, f] <= c) + worth(x[:, f] > c) - worth(slice(None)) for f in range(4) for c in np.unique(x[:, f])[:-1] if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 1.0]
        found = trees.best_cut(x, g, h, 0.1, 1.0, 1.0)
        most = max(every, default=-1.0)
        assert (found is None and most <= 1e-12) or found[0] == pytest.approx(most)
        if found:
            low = x[:, found[1]] <= found[2]
            assert worth(low) + worth(~low) - worth(slice(None)) == pytest.approx(most)


def test_first_newton_step():
    x, y = np.arange(8.0)[:, None], np.repeat([0, 1], 4)
    _, p = trees.boosted(x, y, x, rounds=1, depth=1, rate=1.0, rows_share=1.0, columns_share=1.0, l1=0.0, l2=0.0)
    assert np.allclose(p[:, 1], np.where(y == 1, 1, 0) * (1 / (1 + np.exp(-2)) - 1 / (1 + np.exp(2))) + 1 / (1 + np.exp(2)))


def test_quantiles_over_ranges(spark):
    """Hot values, ties, nulls, one row and several ranges a group against numpy."""
    rng = np.random.default_rng(5)
    groups = {0: rng.normal(size=3000), 1: np.concatenate([np.zeros(2000), rng.normal(size=500)]), 2: np.array([4.0]), 3: rng.integers(0, 5, 400).astype(float)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None)], "feature_idx int, value double")
    got = {r["feature_idx"]: r["q"] for r in scaling.exact_quantiles(rows, ["feature_idx"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, [0.0, 0.25, 0.5, 0.9, 1.0]), atol=1e-12)
    ranked = scaling.ranked_values(rows, ["feature_idx"]).where("feature_idx = 1").orderBy("value").collect()
    values, same = np.unique(groups[1], return_counts=True)
    assert [r["upto"] for r in ranked] == np.cumsum(same).tolist() and {r["n"] for r in ranked} == {2500}
    assert scaling.exact_quantiles(rows.where(F.lit(False)), ["feature_idx"], [0.5]).count() == 0
