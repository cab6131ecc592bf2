"""Approximate nearest neighbours over balanced posting lists.

Vectors go to the lists of their nearest centroids; those near a boundary are replicated to several
lists. Centroids are searched through an in-memory neighbour graph. A query opens the lists whose
centroids are within a ratio of the nearest one's distance."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize, spread_join


@dataclass(frozen=True)
class Settings:
    """sample bounds what the centroids are fitted on, tune the further vectors that set the probing ratio; every vector is indexed."""

    sample: int = 16384
    tune: int = 4096
    aim: float = 0.97  # share of the true neighbours, within the tuning vectors, that the opened lists are to hold
    list_size: int = 192
    most_centroids: int = 4096
    degree: int = 24
    beam: int = 64
    replicas: int = 3
    replica_ratio: float = 1.05
    probe_ratio: float | None = None  # None: the least one that reaches the aim
    nearest: float = 0.0  # a nearest distance below this counts as this: a vector that a centroid was fitted on is too near to it
    block: int = 4096
    seed: int = 5


def balanced_centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means on unit vectors in which a full cluster looks farther away: sizes even out."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        owner = np.concatenate([np.argmax(x[a : a + 4096] @ centroids.T - penalty, axis=1) for a in range(0, len(x), 4096)])
        sizes = np.bincount(owner, minlength=k)
        penalty += 0.02 * (sizes * k / len(x) - 1)
        penalty -= penalty.min()
        order = np.argsort(owner, kind="stable")
        held = np.flatnonzero(sizes)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(sizes[held])[:-1]]), axis=0)
        centroids[held] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        empty = np.flatnonzero(sizes == 0)
        centroids[empty] = x[rng.choice(len(x), len(empty))]
    return centroids


class CentroidGraph:
    """Each centroid points to its nearest ones and to a few far ones; a beam walks from fixed entry points."""

    def __init__(self, centroids: np.ndarray, degree: int, seed: int) -> None:
        self.centroids, n = centroids, len(centroids)
        degree = min(degree, n - 1)
        near = np.concatenate([np.argsort(-(centroids[a : a + 256] @ centroids.T), axis=1, kind="stable")[:, : degree + 1] for a in range(0, n, 256)])
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        self.links = np.concatenate([near, far], axis=1)
        self.entries = np.linspace(0, n - 1, min(n, 16)).astype(np.int64)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each unit vector: centroids found, nearest first, and their distances; at most `beam`.

        All vectors of the batch take a step together: each opens its nearest centroid not yet opened
        among its best `beam`, until none has one left."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        seen = np.zeros((n, k), dtype=bool)
        ids = np.repeat(self.entries[None, :], n, axis=0)
        seen[:, self.entries] = True
        close = x @ self.centroids[self.entries].T
        opened = np.zeros(ids.shape, dtype=bool)
        rows = np.arange(n)
        while len(rows):
            want = np.where(opened[rows], -np.inf, close[rows])
            pick = np.argmax(want, axis=1)
            live = want[np.arange(len(rows)), pick] > -np.inf
            rows, pick = rows[live], pick[live]
            if not len(rows):
                break
            opened[rows, pick] = True
            near = self.links[ids[rows, pick]]
            fresh = ~seen[rows[:, None], near]
            sim = np.where(fresh, np.einsum("nd,njd->nj", x[rows], self.centroids[near]), -np.inf)
            seen[rows[:, None], near] = True
            # A link may repeat within a row; only its first place counts.
            order = np.argsort(near, axis=1, kind="stable")
            ordered = np.take_along_axis(near, order, axis=1)
            twin = np.zeros(near.shape, dtype=bool)
            np.put_along_axis(twin, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
            sim[twin] = -np.inf
            width = max(ids.shape[1], min(beam, ids.shape[1] + near.shape[1]))
            if width > ids.shape[1]:
                pad = width - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
                close = np.pad(close, ((0, 0), (0, pad)), constant_values=-np.inf)
                opened = np.pad(opened, ((0, 0), (0, pad)), constant_values=True)
            all_ids = np.concatenate([ids[rows], near], axis=1)
            all_close = np.concatenate([close[rows], sim], axis=1)
            all_open = np.concatenate([opened[rows], np.zeros(near.shape, dtype=bool)], axis=1)
            best = np.argsort(-all_close, axis=1, kind="stable")[:, :width]
            ids[rows], close[rows] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_close, best, axis=1)
            opened[rows] = np.take_along_axis(all_open, best, axis=1) | ~np.isfinite(close[rows])
        order = np.argsort(-close, axis=1, kind="stable")
        close = np.take_along_axis(close, order, axis=1)
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(close), close, -9)))


def replica_lists(graph: CentroidGraph, x: np.ndarray, s: Settings) -> list[list[int]]:
    """The nearest list, and others within the ratio whose centroid isn't nearer to a list already taken than to the vector."""
    ids, far = graph.search(x, s.beam)
    out = []
    for row, d in zip(ids, far):
        taken = [int(row[0])]
        for c, dc in zip(row[1:], d[1:]):
            if len(taken) == s.replicas or dc > s.replica_ratio * d[0] + 1e-9:
                break
            if all(np.sum((graph.centroids[c] - graph.centroids[t]) ** 2) > 0.25 * dc * dc for t in taken):
                taken.append(int(c))
        out.append(taken)
    return out


def least_ratio(graph: CentroidGraph, x: np.ndarray, queries: np.ndarray, s: Settings, k: int) -> float:
    """The distance ratio at which `aim` of the k nearest of x to the queries stand in opened lists.

    Neither x nor the queries are vectors that the centroids were fitted on. A whole table is denser than x, so its
    neighbours are nearer than these and their lists too: the ratio errs to the safe side."""
    needed = []
    for a in range(0, len(queries), 64):
        q = queries[a : a + 64]
        near = np.argpartition(-(q @ x.T), min(k, len(x)) - 1, axis=1)[:, :k]
        far = np.sqrt(np.maximum(0, 2 - 2 * (q @ graph.centroids.T)))
        for d, own in zip(far, near):
            needed += [d[lists].min() / max(d.min(), s.nearest, 1e-12) for lists in replica_lists(graph, x[own], s)]
    return float(np.quantile(needed, s.aim, method="higher")) if needed else 1.0


def tuned(graph: CentroidGraph, x: np.ndarray, queries: np.ndarray, s: Settings, k: int) -> Settings:
    """s with the median distance of the queries to their nearest centroid, and the ratio that is right with it."""
    if len(queries):
        s = replace(s, nearest=float(np.median([np.sqrt(max(0, 2 - 2 * (graph.centroids @ q).max())) for q in queries])))
    return replace(s, probe_ratio=least_ratio(graph, x, queries, s, k) if len(x) else 1.0)


def probe_lists(graph: CentroidGraph, x: np.ndarray, s: Settings) -> list[list[int]]:
    """All lists within the ratio, nearest first. The beam bounds none: where it ends inside the ratio, all centroids are measured."""
    ids, far = graph.search(x, s.beam)
    reach = s.probe_ratio * np.maximum(far[:, 0], s.nearest) + 1e-9
    out = [[int(c) for c, dc in zip(row, d) if c >= 0 and dc <= most] for row, d, most in zip(ids, far, reach)]
    for i in np.flatnonzero(far[:, -1] <= reach):
        d = np.sqrt(np.maximum(0, 2 - 2 * (graph.centroids @ x[i])))
        out[i] = [int(c) for c in np.argsort(d, kind="stable") if d[c] <= s.probe_ratio * max(d.min(), s.nearest) + 1e-9]
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish: no cosine changes by it."""
    most = np.abs(x).max(axis=1, keepdims=True, initial=0.0) if x.size else np.zeros((len(x), 1))
    return np.ldexp(x, -np.frexp(most)[1])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of a row, ties to smaller ids, whole."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        cand = np.flatnonzero(score >= edge)
    else:
        cand = np.arange(len(score))
    return cand[np.lexsort((ids[cand], -score[cand]))[:k]]


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """For each vector whose id is divisible by `every`: query_id, rank (from 1), vec_id, score (cosine in double).

    Candidates are all other rows; ties go to the smaller id. Null, zero or non-finite vectors, rows
    without an id and vectors not of the commonest dimension take no part. Rows with an equal vector fold
    into one with its k + 1 smallest ids, which is all that a result can show of them; so copies of one
    vector are searched once, whatever their number. Centroids and the probing ratio come from a bounded sample,
    every vector is indexed. Lists are cut into blocks of bounded size. A query
    whose lists hold fewer than k others, where there are more, is searched in all lists.
    An empty table gives an empty result."""
    s, spark = settings, vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = sizes[0]["d"] if sizes else 0
    rows = rows.where(F.size("v") == dims)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = materialize(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("key"), "v", "ids"), "ann-vectors")
    # Many queries may share one vector, here and where they get their answers.
    queries = materialize(rows.where(F.pmod("id", F.lit(every)) == 0), "ann-asking")
    asked = spread_join(queries, distinct.select("key", "v"), ["v"], ["id"]).select(F.col("id").alias("query_id"), F.col("key").alias("qkey"))
    asked = materialize(asked, "ann-queries")
    n = distinct.count()
    held = distinct.orderBy(F.xxhash64(F.lit(s.seed), "key"), "key").limit(s.sample + s.tune).select("v").toArrow().column(0).combine_chunks()
    sample = held.flatten().to_numpy().reshape(-1, max(dims, 1))
    unit = _scaled(sample)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    asking, apart, unit = np.split(unit, [min(s.tune, len(unit) // 4) // 8, min(s.tune, len(unit) // 4)])
    many = int(np.clip(n // s.list_size, 1, min(s.most_centroids, max(1, len(unit) // 4))))
    graph = CentroidGraph(balanced_centroids(unit, many, s.seed), s.degree, s.seed) if len(unit) else None
    if s.probe_ratio is None:
        s = tuned(graph, apart, asking, s, k) if graph is not None else replace(s, probe_ratio=1.0)
    sent = spark.sparkContext.broadcast(pickle.dumps(graph))  # at most most_centroids vectors and their links

    def lists(choose):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(sent.value)
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    x = _scaled(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                    found = choose(own, x / np.linalg.norm(x, axis=1, keepdims=True), s)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=["key", "v", "lists"])

        return run

    postings = distinct.select("key", "v").mapInArrow(lists(replica_lists), "key long, v array<double>, lists array<int>")
    postings = materialize(postings.select("key", "v", F.explode("lists").alias("list")), "ann-postings")
    blocks = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(s.block)).cast("int").alias("blocks"))
    wanted = distinct.join(asked.select(F.col("qkey").alias("key")).distinct(), "key", "left_semi").select("key", "v")

    def top(found: DataFrame) -> DataFrame:
        found = found.groupBy("qkey", "key").agg(F.max("score").alias("score"))
        best = Window.partitionBy("qkey").orderBy(F.desc("score"), "key")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")

    def search(queries: DataFrame) -> DataFrame:
        """queries: key, v, floor, list. The k + 1 best vectors of each query, over blocks of its lists, but none under its floor.

        A group of the scan is a block of a list's vectors and a block of the queries that open it, so
        neither many queries of one list nor a long list make a group large."""
        queries = materialize(queries, "ann-opened")
        asking = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(s.block)).cast("int").alias("askers"))
        parts = blocks.join(asking, "list")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        left = queries.join(parts, "list").select("key", "v", "floor", "list", every("blocks").alias("block"), one("askers").alias("asker"))
        right = postings.join(parts, "list").select("key", "v", "list", one("blocks").alias("block"), every("askers").alias("asker"))

        def scan(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(p):
                y, ids = _scaled(np.stack(p["v"].to_numpy())), p["key"].to_numpy()
                norm = np.linalg.norm(y, axis=1)
                for a in range(0, len(q), 512):
                    x, keys, floors = _scaled(np.stack(q["v"].to_numpy()[a : a + 512])), q["key"].to_numpy()[a : a + 512], q["floor"].to_numpy()[a : a + 512]
                    score = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * norm)
                    for key, line, floor in zip(keys, score, floors):
                        best = _best(line, ids, k + 1)
                        best = best[line[best] >= floor]
                        out += [(key, ids[b], line[b]) for b in best]
            return pd.DataFrame(out, columns=["qkey", "key", "score"]).astype({"qkey": "int64", "key": "int64", "score": "float64"})

        found = left.groupBy("list", "block", "asker").cogroup(right.groupBy("list", "block", "asker")).applyInPandas(scan, "qkey long, key long, score double")
        return top(found)

    def answers(found: DataFrame, queries: DataFrame) -> DataFrame:
        """A result row never needs more of the vectors than the k + 1 nearest, nor more ids of one than k + 1."""
        named = found.join(distinct.select("key", "ids"), "key").select("qkey", "score", F.explode("ids").alias("vec_id"))
        few = named.withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
        few = few.groupBy("qkey").agg(F.collect_list(F.struct("score", "vec_id")).alias("few"))
        out = spread_join(queries, few, ["qkey"], ["query_id"]).select("query_id", F.inline("few")).where("query_id <> vec_id")
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    # What the nearest lists hold sets a floor that rows of the further ones must reach: none of the k + 1 best is lost.
    lowest = F.lit(-2.0)
    probed = materialize(wanted.mapInArrow(lists(probe_lists), "key long, v array<double>, lists array<int>"), "ann-probed")
    found = materialize(search(probed.select("key", "v", lowest.alias("floor"), F.explode(F.slice("lists", 1, s.beam)).alias("list"))), "ann-near")
    more = probed.where(F.size("lists") > s.beam)
    if not more.isEmpty():
        floors = found.groupBy(F.col("qkey").alias("key")).agg(F.when(F.count(F.lit(1)) > k, F.min("score") - 1e-12).alias("least"))
        more = more.join(floors, "key", "left").select("key", "v", F.coalesce("least", lowest).alias("floor"), F.explode(F.slice("lists", s.beam + 1, F.size("lists"))).alias("list"))
        found = top(found.unionByName(search(more)))
    out = materialize(answers(found, asked), "ann-found")
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    short = asked.join(out.groupBy("query_id").agg(F.count(F.lit(1)).alias("got")), "query_id", "left").where(F.coalesce("got", F.lit(0)) < min(k, total - 1)).select("query_id", "qkey")
    short = materialize(short, "ann-short")
    if short.isEmpty():
        return out
    every_list = F.array(*[F.lit(r["list"]) for r in blocks.select("list").collect()])  # at most most_centroids
    whole = distinct.join(short.select(F.col("qkey").alias("key")).distinct(), "key", "left_semi").select("key", "v", lowest.alias("floor"), F.explode(every_list).alias("list"))
    return out.join(short, "query_id", "left_anti").unionByName(answers(search(whole), short))
