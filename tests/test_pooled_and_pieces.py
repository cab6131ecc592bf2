import numpy as np
import pandas as pd

from quaywave.operators import blocks
from quaywave.plans import model_queries


def test_blocks_are_taken_in_pieces():
    batch = pd.DataFrame({"k": range(1300)})
    assert [len(b) for b in blocks._some([batch, batch[:3]])] == [512, 512, 276, 3]
    assert np.array_equal(pd.concat(blocks._some([batch]))["k"], batch["k"])


def test_pooled_rows_lie_in_many_tasks_whatever_the_file(spark, tmp_path):
    """One small file was one task, and every pass of an estimator read and joined it anew."""
    rows = [(i, [float(i % 7)] * 64, i % 10) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    pooled = model_queries._pooled(spark, str(tmp_path))
    assert pooled.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert pooled.count() == 3200 and {r["weight"] for r in pooled.select("weight").distinct().collect()} == {1.0}
