"""Linear models of every fold from sums: rows are read once for all folds, and no group's rows ever meet."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import second_moments
from ..ship import ship
from .spread import spread_join
from .windows import let


def _lda(n: np.ndarray, means: np.ndarray, within: np.ndarray, shrinkage: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of linear discriminants with a shrunk pooled covariance. within: sums of squares about the class means."""
    cov = within.sum(axis=0) / n.sum()
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))
    w = np.linalg.solve(cov + 1e-12 * np.eye(len(cov)), means.T)
    return w, np.log(n / n.sum()) - 0.5 * np.einsum("cd,dc->c", means, w)


def _ridge(n: np.ndarray, means: np.ndarray, within: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Least squares on +-1 targets, classes of equal weight: the weighted squares are those within and between the classes."""
    k, total = len(n), n.sum()
    centre, target = means.mean(axis=0), 2 * np.eye(k) - 1
    apart = means - centre
    squares = (within * (total / (k * n))[:, None, None]).sum(axis=0) + total / k * apart.T @ apart
    w = np.linalg.solve(squares + alpha * np.eye(len(centre)), total / k * apart.T @ (target - target.mean(axis=0)))
    return w, target.mean(axis=0) - centre @ w


FITS = {"lda": _lda, "ridge": _ridge}


def fit_from_sums(rows: DataFrame, by: list[str], array: str, label: str, fold: str, models: tuple[str, ...] = ("lda", "ridge")) -> DataFrame:
    """by, fold, model, classes, weights (one array a class), offsets: each model fitted on the rows outside the fold.

    Sums, products and counts are taken per (by, fold, class) in one pass; a fold's training sums are those of the
    other folds. Scaling is that of the training rows, worked into the weights, so that rows need none. A
    group's task sees folds x classes matrices. Folds without two classes in training are left out; null arrays are."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    parts = second_moments(rows.where(F.col(label).isNotNull() & F.col(fold).isNotNull()), [*by, fold, label], array)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        d = len(part["total"].iloc[0])
        held = {(f, c): (float(n), np.array(t), np.array(p).reshape(d, d)) for f, c, n, t, p in zip(part[fold], part[label], part["n"], part["total"], part["products"])}
        out = []
        for f in sorted({k[0] for k in held}):
            train: dict = {}
            for (g, c), sums in sorted(held.items()):
                if g != f:
                    train[c] = [a + b for a, b in zip(train[c], sums)] if c in train else list(sums)
            if len(train) < 2:
                continue
            classes, n = sorted(train), np.array([train[c][0] for c in sorted(train)])
            means = np.stack([train[c][1] / train[c][0] for c in classes])
            within = np.stack([train[c][2] - train[c][0] * np.outer(m, m) for c, m in zip(classes, means)])
            mean = n @ means / n.sum()
            var = (sum(np.diag(w) for w in within) + n @ (means - mean) ** 2) / n.sum()
            std = np.where(var > 1e-24 * np.maximum(1.0, mean**2), np.sqrt(np.maximum(var, 0)), 1.0)
            for name in models:
                w, b = FITS[name](n, (means - mean) / std, within / np.outer(std, std))
                w = w / std[:, None]
                out.append((*part[by].iloc[0], f, name, classes, w.T.tolist(), (b - mean @ w).tolist()))
        return pd.DataFrame(out, columns=[*by, fold, "model", "classes", "weights", "offsets"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, fold]) + f", model string, classes array<{kinds[label]}>, weights array<array<double>>, offsets array<double>"
    return parts.groupBy(*by).applyInPandas(fit, schema)


def predict_from_sums(rows: DataFrame, by: list[str], array: str, label: str, fold: str, id_col: str, models: tuple[str, ...] = ("lda", "ridge")) -> DataFrame:
    """by, fold, id, label, model, predicted: every row by the models that were fitted without its fold.

    Scores are expressions within the row; ties go to the lowest class. A large group's rows are dealt to many tasks."""
    fitted = fit_from_sums(rows, by, array, label, fold, models)
    one = fitted.groupBy(*by, fold).agg(F.collect_list(F.struct("model", "classes", "weights", "offsets")).alias("fits"))
    met = spread_join(rows.select(*by, fold, id_col, label, array), one, [*by, fold], [id_col])
    met = met.select(*by, fold, id_col, label, array, F.explode("fits").alias("fit"))
    dot = lambda w: F.aggregate(F.zip_with(array, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scores = F.zip_with(F.transform("fit.weights", dot), F.col("fit.offsets"), lambda s, b: s + b)
    best = let(scores, lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1)
    return met.withColumn("predicted", F.get("fit.classes", best)).select(*by, fold, id_col, label, F.col("fit.model").alias("model"), "predicted")
