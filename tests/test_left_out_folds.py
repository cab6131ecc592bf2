import numpy as np
import pytest

from quaywave.functions import kernels as k
from quaywave.operators import estimators
from test_kernel_machines import planted, table


def test_a_set_of_folds_is_left_out_once_for_all_that_it_serves():
    """Six trials and three inner groups were 18 fits a point, five of them of the same training rows as others."""
    sets = estimators._left_out(list(range(6)), 3)
    assert len(sets) == len({frozenset(s) for s, _ in sets}) == 13
    served = {(f, i): (s, held) for s, serves in sets for f, i, held in serves}
    for f in range(6):
        rest = [g for g in range(6) if g != f]
        for i in range(3):
            assert served.pop((f, i)) == ({f, *rest[i::3]}, rest[i::3])
    assert not served and estimators._left_out([7], 3) == [] and [v for _, s in estimators._left_out([7, 8], 3) for v in s] == [(7, 0, [8]), (8, 0, [7])]


def test_there_are_more_tasks_than_cores(spark):
    """With a task a core the longest of twelve took 35 s of the query's 52."""
    assert estimators._dealt(table(spark), ["g", "fold"]).rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_shared_fits_tell_what_the_plain_loop_tells(spark):
    """Six folds; rows without a fold train the outer machines alone; a group of one fold has nothing to choose from."""
    x, y = planted(180)
    fold = [None if n % 30 == 7 else n % 6 for n in range(180)]
    rows = [("a", fold[n], int(y[n]), x[n].tolist()) for n in range(180)] + [("b", 3, int(y[n]), x[n].tolist()) for n in range(9)]
    grid = [(1.0, None), (5.0, 0.1), (1.0, 0.5), (20.0, 0.1)]
    out = estimators.nested_grid(spark.createDataFrame(rows, "g string, fold int, y int, x array<double>"), ["g"], "x", "y", "fold", grid).collect()
    told = {(r["g"], r["fold"]): (r["c"], r["gamma"], r["accuracy"]) for r in out}
    assert len(out) == len(told) == 7 and told["b", 3] == (1.0, 0.0, 0.0)

    def score(train, test, c, gamma):
        z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
        return (k.svm_decide(k.svm_fit(z[train], y[train], c, gamma), z[test]) == y[test]).mean()

    for f in range(6):
        rest = [h for h in range(6) if h != f]
        own = np.array([rest.index(h) % 3 if h in rest else -1 for h in fold])
        means = [np.mean([score((own >= 0) & (own != i), own == i, *p) for i in range(3)]) for p in grid]
        c, gamma = grid[int(np.argmax(means))]
        test = np.array([h == f for h in fold])
        assert told["a", f][0] == c and (gamma is None or told["a", f][1] == gamma) and told["a", f][2] == score(~test, test, c, gamma)


@pytest.mark.parametrize("room", [{}, {"small": 0}])
@pytest.mark.parametrize("c, gamma", [(0.05, 0.1), (2.0, 0.1), (300.0, 0.5), (5.0, 300.0)])
def test_steps_of_a_fit_are_those_of_the_plain_form(room, c, gamma):
    """Scores are held twice, once for each side of a step; the plain form adds up who may move at every step."""
    x, y = planted(200)
    kernel = k.KernelRows(x, gamma, **room)
    classes, support, coef, offset, _, _ = k.svm_fit(x, y, c, gamma, kernel=kernel)
    t = np.where(y == 1, 1.0, -1.0)
    limit = c * len(t) / (2 * np.where(t > 0, (t > 0).sum(), (t < 0).sum()))
    alpha, score = np.zeros(len(t)), t.copy()
    for _ in range(100 * len(t)):
        up, down = np.where(t > 0, alpha < limit, alpha > 0), np.where(t > 0, alpha > 0, alpha < limit)
        i, j = int(np.where(up, score, -np.inf).argmax()), int(np.where(down, score, np.inf).argmin())
        if not score[i] - score[j] >= 1e-3:
            break
        a, b = kernel.row(i), kernel.row(j)
        width = max(float(kernel.diagonal[i]) + float(kernel.diagonal[j]) - 2 * float(a[j]), 1e-12)
        move = min((score[i] - score[j]) / width, limit[i] - alpha[i] if t[i] > 0 else alpha[i], alpha[j] if t[j] > 0 else limit[j] - alpha[j])
        alpha[i] += move * t[i]
        alpha[j] -= move * t[j]
        score -= (a - b).astype(float) * move
    held, free = alpha > 1e-9, (alpha > 1e-9) & (alpha < limit - 1e-9)
    assert np.array_equal(support, x[held]) and np.array_equal(coef, (alpha * t)[held])
    assert offset == (score[free].mean() if free.any() else (score[up].max() + score[down].min()) / 2)


def test_exponentials_that_vanish_are_told_without_working_them_out():
    x = np.random.default_rng(0).normal(size=(60, 8))
    z = np.concatenate([x[:20], x[20:40] * 40, [[np.nan] * 8]])
    for gamma in (0.01, 5.0, 80.0):
        far = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :] - 2 * x @ z.T
        assert np.array_equal(k.kernel_matrix(x, z, gamma), np.exp(-gamma * np.maximum(0, far)), equal_nan=True)
