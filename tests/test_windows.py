import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaywave.operators import features, spectral, windows


def rows_of(spark, arrays):
    return spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(arrays)], "id long, x array<double>")


def test_counts_equal_generated_windows(spark):
    arrays = [[0.0] * n for n in range(0, 30)]
    for open_end in (False, True):
        count = (windows.window_count_open if open_end else windows.window_count)(F.size("x"), 5, 3)
        rows = rows_of(spark, arrays)
        told = {r["id"]: r["c"] for r in rows.select("id", count.alias("c")).collect()}
        made = {r["id"]: r["count"] for r in windows.cut_windows(rows, "x", 5, 3, open_end=open_end).groupBy("id").count().collect()}
        brute = {n: len(range(0, n - 5 + (not open_end), 3)) for n in range(30)}
        assert told == brute and made == {n: c for n, c in brute.items() if c}


def test_row_form_equals_array_form(spark):
    values = [float(v) for v in range(23)]
    series = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "key int, t int, value double")
    parts = windows.number_samples(series, "key", ["t"], F.floor(F.col("t") / 5)).orderBy("t").collect()
    assert [(r["pos"], r["n"]) for r in parts] == [(k, 23) for k in range(23)]
    cut = windows.explode_windows(windows.number_samples(series, "key", ["t"]), 6, 4, cap=3)
    found = {}
    for r in cut.orderBy("window_idx", "in_pos").collect():
        found.setdefault(r["window_idx"], []).append(r["value"])
    assert found == {k: values[k * 4 : k * 4 + 6] for k in range(3)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), min_size=2, max_size=12), min_size=1, max_size=5))
def test_zscore_and_moments(spark, arrays):
    out = windows.zscore(windows.with_moments(rows_of(spark, arrays), "x"), "x").orderBy("id").collect()
    for r, a in zip(out, arrays):
        a = np.array(a)
        assert math.isclose(r["m"], a.mean(), abs_tol=1e-9) and math.isclose(r["v"], a.var(), abs_tol=1e-7)
        assert np.allclose(r["z"], (a - a.mean()) / (a.std() + 1e-6), atol=1e-6)


def test_sine_impulse_and_constant_spectra(spark):
    t = np.arange(64)
    arrays = [np.sin(2 * np.pi * 5 * t / 64), np.eye(64)[0], np.full(64, 2.0)]
    power = [np.array(r["power"]) for r in spectral.with_power(rows_of(spark, arrays), "x", 64).orderBy("id").collect()]
    assert np.allclose(power[0][5], 1024) and np.allclose(np.delete(power[0], 5), 0, atol=1e-9)
    assert np.allclose(power[1], 1) and np.allclose(power[2][1:], 0, atol=1e-9)


def test_entropies_of_a_known_variance(spark):
    r = spark.range(1).select(features.gaussian_entropy_added(F.lit(6.25)).alias("a"), features.gaussian_entropy_floored(F.lit(0.0)).alias("b"), features.gaussian_entropy_added(F.lit(0.0)).alias("c")).first()
    assert math.isclose(r["a"], 0.5 * math.log(2 * math.pi * math.e * 6.25), rel_tol=1e-9)
    assert math.isclose(r["b"], r["c"])


def test_constant_windows_are_defined(spark):
    values = spark.createDataFrame([(1, 3.0)] * 8, "k int, v double")
    assert features.histogram_entropy(values, ["k"], "v").first()["entropy"] is not None
    flat = rows_of(spark, [[1.0] * 16])
    assert {r["corr"] for r in features.channel_correlation(flat, "id", "x", 4, 4).collect()} == {0.0}


def test_asymmetry_changes_sign_with_its_sides(spark):
    rows = rows_of(spark, [np.arange(60)])
    pairs = [(0, 5), (1, 7)]
    a = features.asymmetry(rows, "x", pairs, 12, 5).select("band", "pair", (F.col("r") - F.col("l")).alias("d"))
    b = features.asymmetry(rows, "x", [(r, l) for l, r in pairs], 12, 5).select("band", "pair", (F.col("r") - F.col("l")).alias("d"))
    assert {(r["band"], r["pair"], r["d"]) for r in a.collect()} == {(r["band"], r["pair"], -r["d"]) for r in b.collect()}
