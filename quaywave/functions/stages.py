"""The features' way into a model as stages of pyspark.ml: fitted on training rows only, with parameters, saved and loaded."""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scaling, selection
from ..operators.windows import let
from .transforms import fit_pca, second_moments


def _constant(numbers: list) -> Column:
    """Numbers, or lists of them, as one constant of the plan, where an array of literals would be a node for each."""
    return F.from_json(F.lit(json.dumps(numbers)), "array<array<double>>" if numbers and isinstance(numbers[0], list) else "array<double>")


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class FoldFeatures(Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Near-constant features go, the rest are scaled by median and quartiles, joined by their principal components, and the
    `top` best by a weighted sum of F, information and spread are kept.

    inputCol: an array of numbers; outputCol: a vector. Every step is fitted by aggregations over all training rows:
    exact quantiles by ranges, sums of products, class moments and binned counts. A row a feature reaches the driver."""

    leastVariance = _param("leastVariance", "features of no more variance go", TypeConverters.toFloat)
    components = _param("components", "share of variance that the components explain; 0: none are added", TypeConverters.toFloat)
    top = _param("top", "how many features and components are kept", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "chosen", labelCol: str = "label", leastVariance: float = 1e-6, components: float = 0.95, top: int = 150) -> None:
        super().__init__()
        self._setDefault(inputCol="features", outputCol="chosen", labelCol="label", leastVariance=1e-6, components=0.95, top=150)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FoldFeaturesModel:
        source, label = self.getInputCol(), self.getLabelCol()
        rows = dataset.select(F.monotonically_increasing_id().alias("row"), F.col(label).alias("label"), F.transform(source, lambda x: x.cast("double")).alias("x")).where(F.col("x").isNotNull())
        long = scaling.long_form(rows, ["row", "label"], "x")
        spread = {r["feature_idx"]: r["variance"] for r in long.groupBy("feature_idx").agg(F.var_pop("value").alias("variance")).collect()}
        keep = sorted(k for k, v in spread.items() if v > self.getOrDefault(self.leastVariance)) or sorted(spread)
        fitted = {r["feature_idx"]: r for r in scaling.fit_robust(long, ["feature_idx"]).collect()}
        centre, scale = [fitted[k]["mean"] for k in keep], [fitted[k]["std"] for k in keep]
        model = FoldFeaturesModel()._take(self, keep=keep, centre=centre, scale=scale, mean=[0.0] * len(keep), axes=[], chosen=[])
        share = self.getOrDefault(self.components)
        if share > 0:
            scaled = rows.select(model.scaled(F.col("x")).alias("z"))
            mean, axes, _ = fit_pca(second_moments(scaled, [], "z").first(), share)
            model._set(mean=mean.tolist(), axes=axes.ravel(order="F").tolist())
        wide = rows.select("row", "label", model.joined(F.col("x")).alias("z"))
        scores = selection.feature_scores(scaling.long_form(wide, ["row", "label"], "z"))
        best = selection.fuse(scores, 0.7, 0.3, self.getOrDefault(self.top), variance=0.2).select("feature_idx").collect()  # at most `top` rows
        return model._set(chosen=sorted(r["feature_idx"] for r in best))


class FoldFeaturesModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """What FoldFeatures has fitted; its numbers are parameters, so they are saved and loaded with it. Transforms within the row."""

    keep = _param("keep", "features that vary", TypeConverters.toListInt)
    centre = _param("centre", "their medians", TypeConverters.toListFloat)
    scale = _param("scale", "their ranges between quartiles, 1 for none", TypeConverters.toListFloat)
    mean = _param("mean", "means of the scaled features", TypeConverters.toListFloat)
    axes = _param("axes", "components, one after another", TypeConverters.toListFloat)
    chosen = _param("chosen", "places among scaled features and components that are kept", TypeConverters.toListInt)

    def _take(self, estimator: FoldFeatures, **fitted) -> FoldFeaturesModel:
        self._resetUid(estimator.uid)
        return self._set(inputCol=estimator.getInputCol(), outputCol=estimator.getOutputCol(), **fitted)

    def scaled(self, x: Column) -> Column:
        keep, centre, scale = (_constant(self.getOrDefault(p)) for p in (self.keep, self.centre, self.scale))
        place = F.sequence(F.lit(0), F.lit(len(self.getOrDefault(self.keep)) - 1))
        return F.transform(place, lambda i: (F.get(x, F.get(keep, i).cast("int")) - F.get(centre, i)) / F.get(scale, i))

    def joined(self, x: Column) -> Column:
        """Scaled features, then their components."""
        mean, axes = np.array(self.getOrDefault(self.mean)), np.array(self.getOrDefault(self.axes))
        if not len(axes):
            return self.scaled(x)
        table, middle = _constant(axes.reshape(-1, len(mean)).tolist()), _constant(mean.tolist())
        dot = lambda z, a: F.aggregate(F.zip_with(z, a, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        of = lambda z: F.concat(z, let(F.zip_with(z, middle, lambda u, m: u - m), lambda c: F.transform(table, lambda a: dot(c, a))))
        return let(self.scaled(x), of)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        doubles = F.transform(self.getInputCol(), lambda x: x.cast("double"))
        wide = self.joined(doubles)
        places = _constant(self.getOrDefault(self.chosen)).cast("array<int>")
        kept = let(wide, lambda z: F.transform(places, lambda k: F.get(z, k)))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(kept))
