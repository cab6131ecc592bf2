import numpy as np
import pytest

from quaywave.functions import kernels as k
from quaywave.operators import estimators


def planted(rows, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 5))
    return x, (x[:, 0] * x[:, 1] + 0.5 * rng.normal(size=rows) > 0).astype(int)


@pytest.mark.parametrize("degree", [0, 3])
@pytest.mark.parametrize("room", [{"small": 0}, {"small": 0, "most": 4 * 300 * 9}])
def test_kernel_rows_in_bounded_memory_give_the_same_machine(degree, room):
    x, y = planted(300)
    rows = k.KernelRows(x, 0.1, degree, **room)
    whole, bounded = k.svm_fit(x, y, 2.0, 0.1, degree), k.svm_fit(x, y, 2.0, 0.1, degree, kernel=rows)
    assert len(rows.held) <= 9 and np.abs(k.svm_margin(whole, x) - k.svm_margin(bounded, x)).max() < 5e-3
    assert np.allclose(k.svm_margin(whole, x), k.svm_margin(whole, x, most=1000))


def test_kernel_memory_does_not_grow_with_the_square():
    import tracemalloc

    x, y = planted(6000)
    tracemalloc.start()
    k.svm_margin(k.svm_fit(x, y, 0.01, 5.0, kernel=k.KernelRows(x, 5.0, most=1 << 23)), x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 < 8 * 6000**2 * 2  # a whole matrix and its parts took over two of these


def test_scoring_memory_does_not_grow_with_the_support_vectors():
    """Up to 2^23 pairs at once took 130 MB in each worker as soon as a session was large."""
    import tracemalloc

    x, peaks = np.random.default_rng(0).normal(size=(3000, 20)), []
    for held in (1500, 3000):
        model = (np.array([0, 1]), x[:held], np.ones(held), 0.0, 0.05, 0)
        tracemalloc.start()
        margins = k.svm_margin(model, x)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert np.allclose(margins, k.kernel_matrix(x, x[:held], 0.05) @ model[2])
    assert max(peaks) < 1 << 25 and peaks[1] < 1.2 * peaks[0]


def table(spark, groups=2, rows=60):
    out = []
    for g in range(groups):
        x, y = planted(rows, g)
        out += [(g, i % 4, int(y[i]), x[i].tolist()) for i in range(rows)]
    return spark.createDataFrame(out, "g int, fold int, y int, x array<double>")


def test_every_outer_fold_is_a_task_of_its_own_and_scores_are_those_of_the_plain_loop(spark, monkeypatch):
    grid, rows = [(1.0, None), (5.0, 0.1), (1.0, 0.5)], table(spark)
    keys, dealt = [], estimators._dealt
    monkeypatch.setattr(estimators, "_dealt", lambda r, by: keys.append(r.select(*by).distinct().count()) or dealt(r, by))
    told = {(r["g"], r["fold"]): (r["c"], round(r["gamma"], 9), r["accuracy"]) for r in estimators.nested_grid(rows, ["g"], "x", "y", "fold", grid).collect()}
    assert keys == [8] and len(told) == 8  # before, a group's folds were one task

    def score(x, y, train, test, c, gamma):
        z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
        return (k.svm_decide(k.svm_fit(z[train], y[train], c, gamma), z[test]) == y[test]).mean()

    for g, part in rows.toPandas().groupby("g"):
        x, y, fold = np.stack(part["x"]), part["y"].to_numpy(), part["fold"].to_numpy()
        for f in range(4):
            rest = [h for h in range(4) if h != f]
            own = np.array([rest.index(h) % 3 if h != f else -1 for h in fold])
            means = [np.mean([score(x, y, (own >= 0) & (own != i), own == i, *p) for i in range(3)]) for p in grid]
            c, gamma = grid[int(np.argmax(means))]
            assert told[g, f][0] == c and told[g, f][2] == score(x, y, fold != f, fold == f, c, gamma)


def test_points_of_a_group_are_dealt_to_tasks(spark, monkeypatch):
    rows = table(spark)
    points = spark.createDataFrame([(g, n, 10.0 ** (n - 2), 0.1) for g in range(3) for n in range(5)], "g int, nth int, c double, gamma double")
    keys, dealt = [], estimators._dealt
    monkeypatch.setattr(estimators, "_dealt", lambda r, by: keys.append(r.select(*by).distinct().count()) or dealt(r, by))
    told = estimators.inner_errors(rows, points, ["g"], "x", "y", "fold").toPandas()
    assert keys == [10, 15] and len(told) == 15  # before, a group's points were one task
    assert told[told["g"] == 2]["loss"].isna().all()  # a group without rows
    x, y = planted(60, 1)
    fold, right = np.arange(60) % 4, []
    for f in range(4):
        train = fold != f
        z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
        right.append((k.svm_decide(k.svm_fit(z[train], y[train], 10.0, 0.1), z[~train]) == y[~train]).mean())
    assert told[(told["g"] == 1) & (told["nth"] == 3)]["loss"].iloc[0] == pytest.approx(1 - np.mean(right), abs=1e-12)
