"""Small models, many at once: every (group, fold) is one grouped task; nothing launches a job per fold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, trees
from ..ship import ship


def soft_vote(probabilities: DataFrame, by: list[str], label: str, p: str) -> DataFrame:
    """Mean probability of each class over models, and the likeliest class; ties (to 12 places) to the lowest."""
    mean = probabilities.groupBy(*by, label).agg(F.avg(p).alias("p"))
    best = F.max(F.struct(F.round("p", 12).alias("r"), (-F.col(label)).alias("minus"), F.col("p").alias("p")))
    return mean.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.minus")).alias(label), F.col("b.p").alias("p"))


def _linear(fit) -> Callable:
    def run(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        classes, w, b = fit(x, y)
        return classes[np.argmax(z @ w + b, axis=1)]

    return run


def _svm(degree: int = 0) -> Callable:
    """Kernel machines; one against the rest where there are more than two classes."""

    def run(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        classes = np.unique(y)
        if len(classes) == 2:
            return kernels.svm_decide(kernels.svm_fit(x, y, degree=degree), z)
        margins = [kernels.svm_margin(kernels.svm_fit(x, (y == c).astype(int), degree=degree), z) for c in classes]
        return classes[np.argmax(np.stack(margins), axis=0)]

    return run


def _bagged(x: np.ndarray, y: np.ndarray, z: np.ndarray, times: int = 5) -> np.ndarray:
    rng, classes, votes = np.random.default_rng(0), np.unique(y), []
    for _ in range(times):
        pick = rng.integers(0, len(x), len(x))
        votes.append(_svm()(x[pick], y[pick], z) if len(np.unique(y[pick])) > 1 else np.full(len(z), y[pick][0]))
    return classes[np.argmax(np.stack([(np.stack(votes) == c).sum(axis=0) for c in classes]), axis=0)]


def _likeliest(fit) -> Callable:
    def run(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        classes, p = fit(x, y, z)
        return classes[np.argmax(p, axis=1)]

    return run


#: Ensembles that give probabilities themselves.
ENSEMBLES: dict[str, Callable] = {"extra_trees": trees.extra_trees, "boosted": trees.boosted}

MODELS: dict[str, Callable] = {"lda": _linear(kernels.lda_fit), "lda_auto": _linear(kernels.lda_auto_fit), "ridge": _linear(kernels.ridge_fit), "logistic": _linear(kernels.logistic_fit), "rbf_svm": _svm(), "poly_svm": _svm(3), "bagged_svm": _bagged} | {name: _likeliest(fit) for name, fit in ENSEMBLES.items()}


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(name: str, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and for the rows of z the probability of each. Discriminants and logistic scores give posteriors;
    margins of ridge and kernel machines pass a logistic link of unit scale, bagged machines give shares of votes."""
    if name in ENSEMBLES:
        return ENSEMBLES[name](x, y, z)
    fits = {"lda": kernels.lda_fit, "lda_auto": kernels.lda_auto_fit, "ridge": kernels.ridge_fit, "logistic": kernels.logistic_fit}
    if name in fits:
        classes, w, b = fits[name](x, y)
        return classes, _softmax(z @ w + b)
    classes = np.unique(y)
    if name == "bagged_svm":
        rng, votes = np.random.default_rng(0), []
        for _ in range(5):
            pick = rng.integers(0, len(x), len(x))
            votes.append(_svm()(x[pick], y[pick], z) if len(np.unique(y[pick])) > 1 else np.full(len(z), y[pick][0]))
        return classes, np.stack([(np.stack(votes) == c).mean(axis=0) for c in classes], axis=1)
    degree, c = (3, 1.0) if name == "poly_svm" else (0, 5.0)
    if len(classes) == 2:
        margin = kernels.svm_margin(kernels.svm_fit(x, y, c, degree=degree), z)
        return classes, _softmax(np.stack([-margin / 2, margin / 2], axis=1))
    return classes, _softmax(np.stack([kernels.svm_margin(kernels.svm_fit(x, (y == k).astype(int), c, degree=degree), z) for k in classes], axis=1))


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt by group over a fixed number of tasks: a model costs far more than its bytes say, by which small tasks would be merged.

    There are eight tasks a core, each of a few groups or none, or the cores that got few groups would wait for those that got many."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *by)


def predict_folds(rows: DataFrame, by: list[str], array: str, label: str, fold: str, id_col: str, models: list[str]) -> DataFrame:
    """by, fold, id, label, model, predicted: each model fitted on the other folds of its group.

    Scaling is fitted on the training rows alone. A fold without two classes in training is left out. A group's rows
    meet in one task, as a model of it must; groups are (subject, session) sized."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(part[array].to_numpy()).astype(float), part[label].to_numpy()
        out = []
        for f in np.unique(part[fold]):
            test = (part[fold] == f).to_numpy()
            if len(np.unique(y[~test])) < 2:
                continue
            mean, std = x[~test].mean(axis=0), x[~test].std(axis=0)
            scaled = (x - mean) / np.where(std == 0, 1, std)
            for name in models:
                frame = part.loc[test, [*by, fold, id_col, label]].copy()
                frame["model"], frame["predicted"] = name, MODELS[name](scaled[~test], y[~test], scaled[test])
                out.append(frame)
        columns = [*by, fold, id_col, label, "model", "predicted"]
        return pd.concat(out)[columns] if out else part.iloc[:0].assign(model="", predicted=part[label].iloc[:0])[columns]

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, fold, id_col, label]) + f", model string, predicted {kinds[label]}"
    return _dealt(rows.select(*by, fold, id_col, label, array), by).groupBy(*by).applyInPandas(run, schema)


def accuracy(predictions: DataFrame, by: list[str], label: str) -> DataFrame:
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"))


class _Split:
    """One training and test part, scaled by the training rows: machines of the same width share their kernel while they follow each other."""

    def __init__(self, x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray) -> None:
        self.able = len(np.unique(y[train])) == 2 and bool(test.any())
        mean, std = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x - mean) / np.where(std == 0, 1, std)
        self.x, self.y, self.z, self.told, self.width, self.kernel = z[train], y[train], z[test], y[test], None, None

    def hits(self, c: float, gamma: float | None) -> np.ndarray:
        gamma = gamma or kernels.scale_gamma(self.x)
        if gamma != self.width:
            self.kernel = None  # not two at a time
            self.width, self.kernel = gamma, kernels.KernelRows(self.x, gamma)
        return kernels.svm_decide(kernels.svm_fit(self.x, self.y, c, gamma, kernel=self.kernel), self.z) == self.told

    def score(self, c: float, gamma: float | None) -> float:
        return float(self.hits(c, gamma).mean())


def _left_out(folds: list, inner: int) -> list[tuple[set, list[tuple]]]:
    """The sets of folds that inner training leaves out, each with what it serves: (outer fold, number and folds of the inner group).

    The outer and the tested folds may change places, so that some sets serve several outer folds."""
    sets: dict[frozenset, list[tuple]] = {}
    for f in folds:
        rest = [g for g in folds if g != f]
        for i in range(min(inner, len(rest))):
            sets.setdefault(frozenset([f, *rest[i::inner]]), []).append((f, i, rest[i::inner]))
    return list(sets.items())


def nested_grid(rows: DataFrame, by: list[str], array: str, label: str, fold: str, grid: list[tuple[float, float | None]], inner: int = 3) -> DataFrame:
    """by, fold, c, gamma, accuracy: RBF machines, (c, gamma) chosen by inner group folds of the training part.

    A gamma of None is 1 / (features x variance) of the rows at hand, which the result names for the chosen one. Inner groups are the outer folds that remain, dealt round; ties go to the first of the grid.
    A machine is fitted once for every set of folds that is left out, whichever outer folds it serves. A group's rows are repeated once for
    each of its folds: its sets are dealt to these parts, in a second step each part is tested on its own fold."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    keys, found = [*by, "_outer"], ["_point", "_inner", "accuracy"]
    turns = sorted(range(len(grid)), key=lambda k: (grid[k][1] is not None, grid[k][1] or 0.0, k))  # equal widths follow each other

    def arrays(part: pd.DataFrame) -> tuple:
        return np.stack(part[array].to_numpy()).astype(float), part[label].to_numpy(), part[fold].to_numpy(), part["_outer"].iloc[0]

    def try_grid(part: pd.DataFrame) -> pd.DataFrame:
        x, y, folds, f = arrays(part)
        known, group, out = part[fold].notna().to_numpy(), part[by].iloc[0], []
        levels = list(np.unique(folds[known]))
        for left, serves in _left_out(levels, inner)[levels.index(f) :: len(levels)]:
            tested = np.isin(folds, list(left))
            split = _Split(x, y, known & ~tested, tested)
            own = [(g, i, np.isin(folds[tested], held)) for g, i, held in serves]
            for k in turns if split.able else ():
                hits = split.hits(*grid[k])
                out += [(*group, g, k, i, float(hits[at].mean())) for g, i, at in own]
        return pd.DataFrame(out, columns=[*keys, *found])

    def choose(part: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
        x, y, folds, f = arrays(part)
        told = np.zeros((len(grid), inner))
        told[tried["_point"].to_numpy(int), tried["_inner"].to_numpy(int)] = tried["accuracy"]
        best = max(range(len(grid)), key=lambda k: (np.mean(told[k].tolist()), -k))
        c, gamma = grid[best]
        whole = _Split(x, y, folds != f, folds == f)
        used = gamma or (kernels.scale_gamma(whole.x) if len(whole.x) else 0.0)
        return pd.DataFrame([(*part[by].iloc[0], f, c, used, whole.score(c, gamma) if whole.able else 0.0)], columns=[*by, fold, "c", "gamma", "accuracy"])

    own_keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    narrow = rows.select(*by, fold, label, array)
    outer = narrow.select(*by, F.col(fold).alias("_outer")).where("_outer IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_set("_outer")).alias("_outer"))
    each = _dealt(narrow.join(outer, by).withColumn("_outer", F.explode("_outer")), keys).groupBy(*keys)
    tried = each.applyInPandas(try_grid, f"{own_keys}, _outer {kinds[fold]}, _point int, _inner int, accuracy double")
    return each.cogroup(tried.groupBy(*keys)).applyInPandas(choose, f"{own_keys}, {fold} {kinds[fold]}, c double, gamma double, accuracy double")


def inner_errors(rows: DataFrame, points: DataFrame, by: list[str], array: str, label: str, fold: str, c: str = "c", gamma: str = "gamma", shares: int = 5) -> DataFrame:
    """points with loss: the error of an RBF machine of each point's (c, gamma) over the folds of its group. points: by, a column each, any others.

    A group's points are dealt to `shares` tasks, each of which sees the group's rows, as its machines must; groups are (subject, session) sized."""
    ship(rows.sparkSession)

    def run(part: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
        right = [[] for _ in range(len(tried))]
        if len(part) and len(tried):
            x, y, folds = np.stack(part[array].to_numpy()).astype(float), part[label].to_numpy(), part[fold].to_numpy()
            for f in np.unique(folds):
                split = _Split(x, y, folds != f, folds == f)
                for k, point in enumerate(zip(tried[c], tried[gamma])) if split.able else ():
                    right[k].append(split.score(*point))
        return tried.drop(columns="_share").assign(loss=[1 - float(np.mean(r)) if r else None for r in right])

    kept = ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", loss double"
    keys, nth = [*by, "_share"], F.row_number().over(Window.partitionBy(*by).orderBy(c, gamma)) - 1
    every = rows.select(*by, fold, label, array).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = points.select("*", (nth % shares).alias("_share"))
    return _dealt(every, keys).groupBy(*keys).cogroup(_dealt(dealt, keys).groupBy(*keys)).applyInPandas(run, kept)
