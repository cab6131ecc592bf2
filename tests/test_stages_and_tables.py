import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from quaywave.functions.stages import FoldFeatures, FoldFeaturesModel
from quaywave.functions.tables import register_tables
from quaywave.operators import windows


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) * np.arange(1, 9)
    x[:, 3] = 5.0
    x[:, 7] = x[:, 1] + 0.01 * x[:, 7]
    y = (x[:, 1] + 0.3 * rng.normal(size=300) > 0).astype(float)
    return spark.createDataFrame([(i, float(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id int, label double, features array<double>"), x, y


def test_stage_equals_numpy(spark, rows, tmp_path):
    table, x, _ = rows
    model = FoldFeatures(components=0.9, top=100).fit(table)
    keep = [0, 1, 2, 4, 5, 6, 7]
    low, mid, high = np.percentile(x[:, keep], [25, 50, 75], axis=0)
    z = (x[:, keep] - mid) / (high - low)
    value = np.sort(np.linalg.eigvalsh(np.cov(z.T, ddof=0)))[::-1]
    k = int(np.searchsorted(np.cumsum(value) / value.sum(), 0.9) + 1)
    got = np.array([r["v"] for r in model.transform(table).orderBy("id").select(vector_to_array("chosen").alias("v")).collect()])
    assert got.shape == (300, 7 + k) and np.allclose(got[:, :7], z)
    assert np.allclose(got[:, 7:].var(axis=0), value[:k]) and np.allclose(np.corrcoef(got[:, 7:].T), np.eye(k), atol=1e-9)
    model.save(str(tmp_path / "m"))
    again = FoldFeaturesModel.load(str(tmp_path / "m"))
    same = np.array([r["v"] for r in again.transform(table).orderBy("id").select(vector_to_array("chosen").alias("v")).collect()])
    assert (same == got).all()


def test_choice_keeps_what_tells(rows):
    table, _, _ = rows
    model = FoldFeatures(components=0.0, top=2).fit(table)
    assert [model.getOrDefault(model.keep)[k] for k in model.getOrDefault(model.chosen)] == [1, 7]


def test_inside_pipeline_and_cross_validator(spark, rows, tmp_path):
    table, _, y = rows
    stage = FoldFeatures(components=0.0)
    pipe = Pipeline(stages=[stage, LogisticRegression(featuresCol="chosen", labelCol="label", regParam=0.01)])
    grid = ParamGridBuilder().addGrid(stage.top, [1, 4]).build()
    folds = table.withColumn("fold", (F.col("id") % 2).cast("int"))
    best = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=2, foldCol="fold").fit(folds).bestModel
    best.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    one, two = ([r["prediction"] for r in m.transform(table).orderBy("id").collect()] for m in (best, again))
    assert one == two and np.mean(np.array(one) == y) > 0.85


@pytest.mark.parametrize(("size", "step"), [(16, 8), (4, 4), (3, 5)])
def test_table_function_equals_the_operator(spark, size, step):
    register_tables(spark)
    rows = [(k, i, float((i * i + k) % 17)) for k, n in ((1, 100), (2, 15), (3, 16), (4, 3)) for i in range(n)]
    spark.createDataFrame(rows, "k int, t int, v double").repartition(5).createOrReplaceTempView("series_of_test")
    got = spark.sql(f"SELECT k, window_idx, samples FROM sliding_windows(TABLE(SELECT * FROM series_of_test) PARTITION BY k ORDER BY t, key => 'k', value => 'v', size => {size}, step => {step})").collect()
    cut = windows.explode_windows(windows.number_samples(spark.table("series_of_test"), "k", ["t"]), size, step)
    told = cut.groupBy("k", "window_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("in_pos", "v"))), lambda x: x["v"]).alias("samples")).collect()
    key = lambda r: (r["k"], r["window_idx"], tuple(r["samples"]))
    assert sorted(map(key, got)) == sorted(map(key, told))


def test_table_function_says_what_is_wrong(spark):
    register_tables(spark)
    spark.range(3).createOrReplaceTempView("ids_of_test")
    with pytest.raises(Exception, match="not a column"):
        spark.sql("SELECT * FROM sliding_windows(TABLE(ids_of_test) PARTITION BY id, key => 'id', value => 'v', size => 2, step => 1)").collect()
    with pytest.raises(Exception, match="from 1 on"):
        spark.sql("SELECT * FROM sliding_windows(TABLE(ids_of_test) PARTITION BY id, key => 'id', value => 'id', size => 0, step => 1)").collect()
