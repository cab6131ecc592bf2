"""The whole way: recordings to window features, features to cross-validated accuracies, accuracies to a report."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, transforms
from ..ship import ship
from ..operators import estimators, features, folds, spectral, windows

BANDS = spectral.BANDS_DE


def window_table(recording: DataFrame, fs: float, size: int, step: int, cap: int | None, pairs: list[tuple[int, int]], channels: int, low: float = 1.0, high: float = 45.0) -> DataFrame:
    """subject, session, trial_idx, window_idx, y, features (band-major entropies, then differences per band and pair).

    recording: subject, session, trial_idx, y, channel, samples. Neutral trials (y = 0) go first, before any
    work. Each channel's whole trial is filtered, then cut (the cap bounds the windows that are made); the
    entropies of a window's channels meet in one exchange of a few numbers each."""
    usable = spectral.clamped_bands(BANDS, fs)
    trial = recording.where("y <> 0").withColumn("samples", transforms.remove_hum(transforms.bandpass("samples", fs, low, min(high, 0.45 * fs)), fs, min(50.0, 0.4 * fs)))
    cut = windows.cut_windows(trial.withColumnRenamed("samples", "whole"), "whole", size, step, cap).drop("whole")
    entropy = cut.withColumn("de", transforms.stockwell_entropy("samples", fs, usable, low, min(50.0, 0.49 * fs)))
    keys = ["subject", "session", "trial_idx", "window_idx", "y"]
    gathered = entropy.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("channel", "de"))).alias("c"))  # one row per channel
    complete = gathered.where(F.size("c") == channels)
    band = lambda b: F.transform("c", lambda x: F.get(x["de"], F.lit(b)))
    de = F.flatten(F.array(*map(band, range(len(usable)))))
    rows = complete.select(*keys, de.alias("de"))
    value = lambda b, c: F.get("de", F.lit(b * channels + c))
    asym = F.array(*[features.difference_right_left(value(b, left), value(b, right)) for b in range(len(usable)) for left, right in pairs])
    return rows.select(*keys, F.concat("de", asym).alias("features"))


def feature_names(fs: float, channels: int, pairs: int) -> list[str]:
    usable = [b[0] for b in spectral.clamped_bands(BANDS, fs)]
    return [f"{b}_ch{c}" for b in usable for c in range(channels)] + [f"rasm_{b}_pair{p}" for b in usable for p in range(pairs)]


#: Columns of a wide feature table that aren't features; all others are, in their order.
META = ("label", "subject", "session", "trial_id")


def feature_columns(wide: DataFrame, meta: tuple[str, ...] = META) -> list[str]:
    return [c for c in wide.columns if c not in meta]


def from_wide(wide: DataFrame, meta: tuple[str, ...] = META) -> DataFrame:
    """The meta columns and features as one array; names are known at plan time, no job runs."""
    names = feature_columns(wide, meta)
    return wide.select(*[c for c in wide.columns if c in meta], F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("features"))


def to_wide(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "features"], *[F.get("features", F.lit(i)).cast("float").alias(n) for i, n in enumerate(names)])


def run_steps(steps: list[tuple[str, Callable[[], object]]]) -> None:
    """One after the other; the first failure stops the rest and names its step."""
    for name, step in steps:
        try:
            step()
        except Exception as error:
            raise RuntimeError(f"step {name} failed") from error


def tensor_rows(windowed: DataFrame) -> DataFrame:
    """The z-scored windows that go to the tensor store beside the features."""
    return windows.zscore(windowed, "samples", out="z")


class FoldPipeline:
    """Fit on training rows only: near-constant features go, robust scaling, components, score-based choice."""

    def __init__(self, least_variance: float = 1e-6, top: int = 150, components: float = 0.95) -> None:
        self.least_variance, self.top, self.components = least_variance, top, components

    def fit(self, x: np.ndarray, y: np.ndarray) -> FoldPipeline:
        self.keep = np.flatnonzero(x.var(axis=0) > self.least_variance)
        if not len(self.keep):
            self.keep = np.arange(x.shape[1])
        low, self.centre, high = np.percentile(x[:, self.keep], [25, 50, 75], axis=0)
        self.scale = np.where(high > low, high - low, 1.0)
        z = (x[:, self.keep] - self.centre) / self.scale
        self.mean = z.mean(axis=0)
        value, vector = np.linalg.eigh(np.cov(z.T, ddof=0).reshape(z.shape[1], -1))
        part = np.cumsum(value[::-1].clip(0)) / max(value.clip(0).sum(), 1e-300)
        self.axes = kernels.fix_signs(vector[:, ::-1][:, : int(np.searchsorted(part, self.components) + 1)])
        full = np.concatenate([z, (z - self.mean) @ self.axes], axis=1)
        self.chosen = np.arange(full.shape[1])
        if full.shape[1] > self.top:
            groups = [full[y == c] for c in np.unique(y)]
            grand = full.mean(axis=0)
            between = sum(len(g) * (g.mean(axis=0) - grand) ** 2 for g in groups) / max(len(groups) - 1, 1)
            within = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / max(len(full) - len(groups), 1)
            f = between / np.where(within > 0, within, np.inf)
            spread = full.var(axis=0)
            mi = np.array([kernels.knn_mutual_information(full[:, j], y) for j in range(full.shape[1])])
            unit = lambda v: v / v.max() if v.max() > 0 else v
            score = 0.8 * (0.7 * unit(f) + 0.3 * unit(mi)) + 0.2 * unit(spread)
            self.chosen = np.sort(np.lexsort((np.arange(len(score)), -score))[: self.top])
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, self.keep] - self.centre) / self.scale
        return np.concatenate([z, (z - self.mean) @ self.axes], axis=1)[:, self.chosen]


def cross_validate(table: DataFrame, k: int = 5, top: int = 150, models: tuple[str, ...] = ("rbf_svm", "extra_trees", "lda", "boosted")) -> DataFrame:
    """classifier, subject, session, fold, accuracy: every session is one grouped task; folds never split a group.

    table: subject, session, group, y, features. Folds are dealt over groups in Spark, the models' mean
    probability decides as `ensemble`. A forest and a perceptron have pooled forms only (plans/model_queries). Folds with one class on either side are left out."""
    ship(table.sparkSession)
    by = ["subject", "session"]
    dealt = folds.group_kfold_greedy(folds.group_sizes(table, by, "group"), by, "group", k).select(*by, "group", "fold")
    rows = table.join(dealt, [*by, "group"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y, out = np.stack(part["features"].to_numpy()).astype(float), part["y"].to_numpy(), []
        for f in np.unique(part["fold"]):
            test = (part["fold"] == f).to_numpy()
            if len(np.unique(y[~test])) < 2 or len(np.unique(y[test])) < 2:
                continue
            fitted = FoldPipeline(top=top).fit(x[~test], y[~test])
            a, b, shares = fitted.transform(x[~test]), fitted.transform(x[test]), []
            for name in models:
                classes, p = estimators.probabilities(name, a, y[~test], b)
                shares.append(p)
                out.append((name, f, (classes[p.argmax(axis=1)] == y[test]).mean()))
            out.append(("ensemble", f, (classes[np.mean(shares, axis=0).argmax(axis=1)] == y[test]).mean()))
        frame = pd.DataFrame(out, columns=["classifier", "fold", "accuracy"])
        return frame.assign(subject=part["subject"].iloc[0], session=part["session"].iloc[0])[["classifier", "subject", "session", "fold", "accuracy"]]

    return rows.groupBy(*by).applyInPandas(run, "classifier string, subject int, session int, fold int, accuracy double")


def report_table(results: DataFrame) -> DataFrame:
    return results.groupBy("classifier", "session").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.max("accuracy").alias("max"), F.count(F.lit(1)).alias("folds"))
