import numpy as np
import pytest

from quaywave.operators import estimators, sums


def table(spark, seed=0, classes=(-1, 0, 1)):
    rng, rows = np.random.default_rng(seed), []
    for k in range(360):
        y = classes[int(rng.integers(len(classes)))]
        x = rng.normal(size=6) + y * np.array([1.0, 0.5, 0, 0, -0.5, 0]) + 50
        x[5] = 7.0  # constant
        rows.append((k, k % 2, k % 5, y, x.tolist()))
    rows += [(1000 + k, 9, k % 2, 1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(4)]  # a group of one class
    rows.append((2000, 0, 1, 1, None))
    return spark.createDataFrame(rows, "id long, g int, fold int, y int, x array<double>")


@pytest.mark.parametrize("classes", [(-1, 0, 1), (0, 1)])
def test_predictions_equal_those_of_whole_groups(spark, classes):
    rows = table(spark, classes=classes)
    args = (["g"], "x", "y", "fold", "id")
    key = lambda r: (r["g"], r["fold"], r["id"], r["y"], r["model"], r["predicted"])
    got = sorted(map(key, sums.predict_from_sums(rows, *args).where("predicted IS NOT NULL").collect()))
    told = sorted(map(key, estimators.predict_folds(rows.where("x IS NOT NULL"), *args, ["lda", "ridge"]).collect()))
    assert got == told and {r[0] for r in got} == {0, 1}
    assert np.mean([r[3] == r[5] for r in got]) > 0.5


def test_no_rows(spark):
    rows = table(spark).limit(0)
    assert sums.predict_from_sums(rows, ["g"], "x", "y", "fold", "id").count() == 0
