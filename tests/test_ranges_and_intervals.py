import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

from quaywave.functions import kernels
from quaywave.operators import information, joins
from quaywave.sources import ranges
from quaywave.sources.recordings import encode_cnt


def values(n=400, seed=0):
    """Two features and a class: one feature follows it, one doesn't. Classes of one, two and three rows among them."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    y[:6] = (10, 11, 11, 12, 12, 12)
    return y, np.stack([y + rng.normal(0, 0.4, n), rng.normal(size=n)], axis=1)


@pytest.mark.parametrize(("parts", "block"), [(2, 5), (8, 3), (64, 50_000)])
def test_knn_information_equals_the_whole_column(spark, parts, block):
    y, x = values()
    rows = spark.createDataFrame([(i, int(c), f, float(v[f])) for i, (c, v) in enumerate(zip(y, x)) for f in (0, 1)], "i int, y int, feature_idx int, value double").repartition(7)
    got = {r["feature_idx"]: r["mi"] for r in information.knn_information(rows, "y", parts=parts, block=block).collect()}
    for f in (0, 1):
        assert abs(got[f] - kernels.knn_mutual_information(x[:, f], y)) < 1e-8
    assert got[0] > 0.2 > got[1]


def test_knn_information_of_ties_nulls_and_nothing(spark):
    same = [(i, i % 2, 0, 1.0) for i in range(40)] + [(99, None, 0, 2.0), (98, 1, 0, None)]
    rows = spark.createDataFrame(same, "i int, y int, feature_idx int, value double")
    got = information.knn_information(rows, "y", noise=information.tie_break("feature_idx", "i"), parts=4, block=5).collect()
    assert len(got) == 1 and 0 <= got[0]["mi"] < 0.3
    lonely = spark.createDataFrame([(0, 0, 0, 1.0), (1, 1, 0, 2.0)], "i int, y int, feature_idx int, value double")
    assert information.knn_information(lonely, "y").collect()[0]["mi"] == 0.0
    assert information.knn_information(rows.where(F.lit(False)), "y").count() == 0


def test_digamma(spark):
    n = [1, 2, 3, 7, 100, 10**6]
    got = [r["d"] for r in spark.createDataFrame([(i,) for i in n], "n long").select("n", information.digamma(F.col("n")).alias("d")).orderBy("n").collect()]
    assert np.allclose(got, kernels._digamma(np.array(n, float)), atol=1e-9)


@pytest.mark.parametrize("small", [0, 1000])
def test_intervals_against_brute_force(spark, small):
    rng = random.Random(4)
    spans = [(k, rng.choice("ab"), s := rng.randrange(-500, 5000), s + rng.choice((0, -3, 1, 2, 7, 8, 64, 1000, 4000))) for k in range(200)] + [(900, "a", None, 5), (901, None, 0, 10)]
    points = [(k, rng.choice("ab"), rng.randrange(-600, 5600)) for k in range(400)] + [(1000, "a", None), (1001, None, 5)]
    a = spark.createDataFrame(points, "p long, key string, at long")
    b = spark.createDataFrame(spans, "q long, key string, start long, end long")
    got = Counter((r["p"], r["q"]) for r in joins.interval_join(a, b, "at", keys=("key",), small=small).collect())
    told = Counter((p, q) for p, k, x in points for q, j, s, e in spans if None not in (k, j, x, s) and k == j and s <= x < e)
    assert got == told and max(got.values()) == 1
    halves = [c for c in a.withColumn("at", F.col("at") / 3).columns]
    thirds = joins.interval_join(a.withColumn("at", F.col("at") / 3)[halves], b.drop("key").withColumns({"start": F.col("start") / 7, "end": F.col("end") / 7}), "at", small=small)
    assert Counter((r["p"], r["q"]) for r in thirds.collect()) == Counter((p, q) for p, _, x in points for q, _, s, e in spans if None not in (x, s) and s / 7 <= x / 3 < e / 7)
    assert joins.interval_join(a, b.limit(0), "at", keys=("key",), small=small).count() == 0


def test_filters_choose_files_and_ranges(spark, tmp_path):
    data = np.arange(100 * 2).reshape(100, 2)
    for name in ("3_0", "3_1"):
        (tmp_path / f"{name}.cnt").write_bytes(encode_cnt(data, ["FP1", "CZ"], 128))
    (tmp_path / "4_0.cnt").write_bytes(b"no recording at all: opening it fails")
    cut = [(k, k * 10, k * 10 + 10) for k in range(10)]
    reader = ranges.PushedCntReader({"path": str(tmp_path), "ranges": json.dumps(cut), "drop": "[]", "pack": "25"})
    assert len(reader.partitions()) == 3 * 5
    left = list(reader.pushFilters([IsNotNull(("subject",)), EqualTo(("subject",), 3), LessThan(("trial_idx",), 5), In(("session",), (0, 7)), GreaterThan(("fs",), 5)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    parts = reader.partitions()
    assert [(p.subject, p.session, [r[0] for r in p.ranges]) for p in parts] == [(3, 0, [0, 1]), (3, 0, [2, 3]), (3, 0, [4])]
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    with ranges.pushed_down(spark):
        rows = ranges.read_cnt_ranges(spark, str(tmp_path), cut).where("subject = 3 AND trial_idx < 5 AND channel = 1").collect()
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == before
    assert sorted((r["session"], r["trial_idx"], r["samples"]) for r in rows) == [(s, k, data[k * 10 : k * 10 + 10, 1].tolist()) for s in (0, 1) for k in range(5)]


def tensors(n=23):
    return [(s, t, k, [float(s * 1000 + t * 100 + k + j / 8) for j in range(6)]) for s in (1, 2) for t in (0, 1) for k in range(n)]


def test_npy_shards_there_and_back(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame(tensors(), "subject int, session int, row_idx long, samples array<float>").repartition(5)
    read = lambda: sorted((r["subject"], r["session"], r["row_idx"], r["channel"], tuple(r["samples"])) for r in ranges.read_npy_rows(spark, path, rows=4).collect())
    told = sorted((s, t, k, c, tuple(x[3 * c : 3 * c + 3])) for s, t, k, x in tensors() for c in (0, 1))
    for _ in range(2):  # overwriting leaves the same
        ranges.write_npy(rows, path, (2, 3), most=5)
        assert read() == told
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names[0] == "1_0_raw-00000.npy" and len(names) >= 4 * 5
    assert np.load(tmp_path / "out" / names[0]).shape[1:] == (2, 3)
    more = spark.createDataFrame([(1, 0, 0, [9.0] * 6)], "subject int, session int, row_idx long, samples array<float>")
    ranges.write_npy(more, path, (2, 3), overwrite=False)
    assert len(read()) == len(told) + 2 and (1, 0, 23, 0, (9.0, 9.0, 9.0)) in read()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    rows = [*tensors(), (3, 0, 0, [1.0, 2.0])]  # the last doesn't have the shape
    with pytest.raises(Exception, match="reshape|cannot|stack|shape"):
        ranges.write_npy(spark.createDataFrame(rows, "subject int, session int, row_idx long, samples array<float>"), str(path), (2, 3), most=5)
    assert not path.exists() or not [p.name for p in path.iterdir()]
