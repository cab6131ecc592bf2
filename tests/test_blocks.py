import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywave.functions import kernels
from quaywave.operators import blocks, windows


@pytest.mark.parametrize("size", [4000, 700, 40])
def test_blocks_filter_as_whole_series_do(spark, size):
    rng = np.random.default_rng(1)
    series = {"a": np.cumsum(rng.normal(size=2000)), "b": rng.normal(size=1999) + 30, "short": rng.normal(size=12), "one": np.array([3.0])}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "key string, t int, value double").repartition(5)
    samples = windows.number_samples(rows, "key", ["t"], F.floor(F.col("t") / 100))
    cut = blocks.cut_blocks(samples, "key", "value", size)
    assert cut.groupBy("key").count().where("key = 'a'").first()["count"] == max(1, 2000 // size)
    for sos in (kernels.butterworth_bandpass(4, 1, 40, 128), kernels.notch(50, 30, 128)):
        out = {}
        for r in blocks.zero_phase_blocks(cut, "key", sos).orderBy("key", "block").collect():
            out.setdefault(r["key"], []).extend(r["x"])
        for k, x in series.items():
            assert np.allclose(out[k], kernels.zero_phase(sos, x), atol=1e-9 * max(1, np.abs(x).max())), k


def test_short_blocks_are_refused(spark):
    rows = spark.createDataFrame([("a", b, 3, [1.0, 2.0]) for b in range(3)], "key string, block int, blocks int, x array<double>")
    with pytest.raises(Exception, match="samples"):
        blocks.zero_phase_blocks(rows, "key", kernels.notch(50, 30, 128)).collect()
