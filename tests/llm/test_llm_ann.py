import numpy as np

from quaywave.llm.ann import CentroidGraph, Settings, balanced_centroids, nearest_neighbours, probe_lists


def brute(rows, every=50, k=5):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            s = sorted(((-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for n, (i, y) in enumerate(good) if not (i == q and y is x)))
            out[q] = [(i, -v) for v, i in s[:k]]
    return out


def table(spark, rows):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    return frame.withColumn("key", frame["label"]).withColumn("list", frame["label"]).withColumn("v", frame["label"])


def test_small_tables_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [np.float32(np.sin(i * 1.7)), np.float32(np.cos(i)), np.float32(i % 3 - 1)]) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0]) for i in range(30)] + [(250, [1.0, 0.0, 0.0]), (300, None), (350, [0.0] * 3), (400, [nan, 1, 1]), (450, [inf, 1, 1]), (500, [1, None, 1]), (None, [1, 1, 1]), (550, [-1.0, 0, 0])]
    out = nearest_neighbours(table(spark, rows)).collect()
    told = brute(rows)
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(told)
    for q in told:
        assert np.allclose([s for _, s in got[q]], [s for _, s in told[q]], atol=1e-12) and [r["rank"] for r in out if r["query_id"] == q].__len__() == len(told[q])
    assert [i for i, _ in got[250]] == [200, 201, 202, 203, 204] and [i for i, _ in got[200]] == [201, 202, 203, 204, 205]


def test_few_and_no_vectors(spark):
    assert nearest_neighbours(table(spark, [(0, [1, 0])])).count() == 0
    assert nearest_neighbours(table(spark, [(0, [1, 0])]).limit(0)).count() == 0
    out = nearest_neighbours(table(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 1])])).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [2, 1]


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = nearest_neighbours(table(spark, rows), settings=Settings(list_size=40, sample=2000, beam=32, block=64)).collect()
    told, hits = brute(rows), 0
    for r in out:
        hits += r["vec_id"] in {i for i, _ in told[r["query_id"]]}
    assert hits / (5 * len(told)) >= 0.9 and len(out) == 5 * len(told)


def test_recall_where_lists_outnumber_the_beam(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = nearest_neighbours(table(spark, rows), every=100, settings=Settings(list_size=6, sample=6000, beam=16)).collect()
    told = brute(rows, every=100)
    hits = sum(r["vec_id"] in {i for i, _ in told[r["query_id"]]} for r in out)
    assert hits / (5 * len(told)) >= 0.9 and len(out) == 5 * len(told)


def test_graph_search_finds_the_nearest_centroid_and_sizes_are_even():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = balanced_centroids(x, 100, 1)
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=100)
    assert sizes.max() < 4 * sizes.mean()
    ids, far = CentroidGraph(c, 16, 1).search(x[:500], 32)
    assert (ids[:, 0] == np.argmax(x[:500] @ c.T, axis=1)).mean() > 0.97 and (np.diff(far, axis=1) >= -1e-9).all()


def test_the_ratio_alone_selects_the_lists():
    rng = np.random.default_rng(4)
    x, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(50, 64)), rng.normal(size=(300, 64))))
    far = np.sqrt(2 - 2 * x @ c.T)
    for ratio in (1.05, 1.2, 1.6):
        told = [set(np.flatnonzero(d <= ratio * d.min() + 1e-9)) for d in far]
        got = [set(row) for row in probe_lists(CentroidGraph(c, 24, 1), x, Settings(beam=16, probe_ratio=ratio))]
        assert sum(len(a & b) for a, b in zip(got, told)) >= 0.95 * sum(map(len, told)) and max(map(len, got)) > (16 if ratio > 1.05 else 0)


def test_lists_beyond_the_beam_are_read_without_loss(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)).astype(np.float32))]
    out = nearest_neighbours(table(spark, rows), settings=Settings(list_size=40, sample=2000, beam=8, block=64, probe_ratio=1.6, nearest=1.2)).collect()
    told = brute(rows)
    assert len(out) == 5 * len(told) and sum(r["vec_id"] == told[r["query_id"]][r["rank"] - 1][0] for r in out) >= 0.99 * len(out)


def test_a_vector_that_many_ask_for(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist()) for i in range(1200)]
    out = nearest_neighbours(table(spark, rows), every=2).collect()
    told, got = brute(rows, every=2), {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(told) and all(got[q] == ([0, 3, 6, 9, 12, 15] if q > 15 else [i for i in (0, 3, 6, 9, 12, 15) if i != q])[:5] for q in told if q % 3 == 0)


def test_lengths_that_square_out_of_range(spark):
    rows = [(k, [float(a) * 1e200, float(b) * 1e200]) for k, (a, b) in enumerate([(1, 0), (1, 1), (0, 1), (-1, 0)])] + [(50, [1e-200, 2e-200])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["query_id"]: [] for r in nearest_neighbours(frame).collect()}
    for r in nearest_neighbours(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 6)))
    assert got == {0: [(1, 0.707107), (50, 0.447214), (2, 0.0), (3, -1.0)], 50: [(1, 0.948683), (2, 0.894427), (0, 0.447214), (3, -0.447214)]}
