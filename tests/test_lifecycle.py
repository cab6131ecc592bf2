import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywave.functions import kernels
from quaywave.operators import spectral
from quaywave.plans import lifecycle


def recording(spark, trials=12, n=400, fs=200.0):
    rng, rows, t = np.random.default_rng(0), [], np.arange(n) / fs
    for k in range(trials):
        y = (-1, 1, 0)[k % 3]
        for c in range(4):
            tone = np.sin(2 * np.pi * (10 if y < 0 else 20) * t) * (3 if y else 0)
            rows.append((1, 1, k, y, c, (tone + rng.normal(0, 1, n)).tolist()))
    return spark.createDataFrame(rows, "subject int, session int, trial_idx int, y int, channel int, samples array<double>")


def test_recordings_to_report(spark):
    table = lifecycle.window_table(recording(spark), 200.0, 200, 100, 3, [(0, 1), (2, 3)], 4)
    rows = table.collect()
    assert len(rows) == 8 * 3 and {len(r["features"]) for r in rows} == {len(lifecycle.feature_names(200.0, 4, 2))}
    assert all(np.isfinite(r["features"]).all() for r in rows) and {r["y"] for r in rows} == {-1, 1}
    results = lifecycle.cross_validate(table.withColumn("group", F.col("trial_idx")), k=3, top=10)
    out = results.collect()
    assert {r["classifier"] for r in out} == {"lda", "extra_trees", "boosted", "rbf_svm", "ensemble"}
    assert np.mean([r["accuracy"] for r in out if r["classifier"] == "ensemble"]) > 0.8
    assert lifecycle.report_table(results).count() == 5


def test_features_are_band_major(spark):
    whole = recording(spark, trials=3)
    got = {(r["trial_idx"], r["window_idx"]): r["features"] for r in lifecycle.window_table(whole, 200.0, 200, 100, 3, [(0, 1), (2, 3)], 4).collect()}
    usable = spectral.clamped_bands(lifecycle.BANDS, 200.0)
    clean = {}
    for r in whole.where("y <> 0").collect():
        x = kernels.zero_phase(kernels.butterworth_bandpass(4, 1.0, 45.0, 200.0), np.array(r["samples"]))
        clean[r["trial_idx"], r["channel"]] = kernels.zero_phase(kernels.notch(50.0, 30.0, 200.0), x)
    for (trial, w), features in got.items():
        told = [kernels.stockwell_entropy(clean[trial, c][w * 100 : w * 100 + 200], 200.0, usable, 1.0, 50.0) for c in range(4)]
        assert np.allclose(features[: 4 * len(usable)], [told[c][b] for b in range(len(usable)) for c in range(4)], atol=1e-8)
        assert np.allclose(features[4 * len(usable) :], [told[r][b] - told[left][b] for b in range(len(usable)) for left, r in ((0, 1), (2, 3))], atol=1e-8)


def test_pipeline_fits_on_training_rows_alone():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 6)), np.repeat([0, 1], 30)
    x[:, 5] = 1.0
    fitted = lifecycle.FoldPipeline(top=4).fit(x, y)
    assert fitted.transform(x[:5]).shape == (5, 4) and 5 not in fitted.keep


def test_wide_and_array_forms(spark):
    names = lifecycle.feature_names(200.0, 2, 1)
    rows = spark.createDataFrame([(1, 2, 3, [float(i) for i in range(len(names))])], "label int, subject int, session int, features array<double>")
    wide = lifecycle.to_wide(rows, names)
    assert lifecycle.feature_columns(wide) == names and lifecycle.from_wide(wide).first() == rows.first()


def test_steps_stop_at_the_first_failure():
    done = []
    with pytest.raises(RuntimeError, match="step b"):
        lifecycle.run_steps([("a", lambda: done.append("a")), ("b", lambda: 1 / 0), ("c", lambda: done.append("c"))])
    assert done == ["a"]
