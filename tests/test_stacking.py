from collections import Counter

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quaywave.plans import model_queries
from quaywave.plans.catalogue import QUERIES


def test_stacking_fits_each_set_of_rows_once_and_tells_what_the_plain_loop_tells(spark, sf, monkeypatch):
    """Nine fits of each base model before, three of them of rows that were fitted already; and one after the other."""
    fits, small = Counter(), {
        "forest": lambda: RandomForestClassifier(numTrees=6, maxDepth=4, weightCol="weight", seed=7, **model_queries._COMMON),
        "logistic_pooled": lambda: LogisticRegression(regParam=0.01, weightCol="weight", **model_queries._COMMON),
    }
    rows = model_queries._pooled(spark, sf).cache()
    monkeypatch.setattr(model_queries, "_pooled", lambda *_: rows)
    monkeypatch.setattr(model_queries, "_ESTIMATORS", {n: lambda n=n: fits.update([n]) or small[n]() for n in small})
    told = {r["vec_id"]: (r["fold"], r["cls"], r["p"]) for r in QUERIES["stacking_ensemble"](spark, sf).collect()}
    assert fits == {"forest": 6, "logistic_pooled": 6} and len(told) == rows.count()

    def scored(train, test):
        parts = [small[n]().fit(train).transform(test).select("vec_id", "target", vector_to_array("probability")[1].alias(n)) for n in small]
        return parts[0].join(parts[1], ["vec_id", "target"])

    for fold in range(3):
        a, b = (rows.where(F.col("fold") == f) for f in range(3) if f != fold)
        put = lambda p: p.withColumn("features", array_to_vector(F.array(*small)))
        final = LogisticRegression(featuresCol="features", labelCol="target", regParam=0.01).fit(put(scored(a, b).unionByName(scored(b, a))))
        out = final.transform(put(scored(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold))))
        for r in out.select("vec_id", "prediction", vector_to_array("probability")[1].alias("p")).collect():
            assert told[r["vec_id"]][:2] == (fold, int(r["prediction"])) and abs(told[r["vec_id"]][2] - r["p"]) < 2e-6


def test_fits_run_side_by_side_and_forests_keep_their_rows_places(spark):
    assert model_queries._AT_ONCE > 1
    for name in ("forest", "extra_trees_substitute"):
        assert model_queries._ESTIMATORS[name]().getCacheNodeIds()
