"""Arrow-batched forms of the numeric kernels: one array in, one array out, a stacked batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import kernels


def _stacked(column: str | Column, body: Callable[[np.ndarray], np.ndarray]) -> Column:
    """body over a (rows, n) stack; rows of one length go together, nulls stay null."""

    ship(SparkSession.active())

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out, sizes = np.empty(len(x), dtype=object), np.array([-1 if v is None else len(v) for v in x])
        for n in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == n)
            for a in range(0, len(rows), 64):  # keeps a stack's spectra within some tens of MB
                part = rows[a : a + 64]
                for r, v in zip(part, body(np.stack([x.iloc[i] for i in part]).astype(float))):
                    out[r] = v
        return pd.Series(out)

    return run(column)


def bandpass(column: str | Column, fs: float, low: float = 1.0, high: float = 45.0, order: int = 4) -> Column:
    sos = kernels.butterworth_bandpass(order, low, high, fs)
    return _stacked(column, lambda x: kernels.zero_phase(sos, x))


def remove_hum(column: str | Column, fs: float, centre: float = 50.0, quality: float = 30.0) -> Column:
    sos = kernels.notch(centre, quality, fs)
    return _stacked(column, lambda x: kernels.zero_phase(sos, x))


def bandpass_direct(column: str | Column, fs: float, low: float = 1.0, high: float = 50.0, order: int = 4) -> Column:
    b, a = kernels.polynomials(kernels.butterworth_bandpass(order, low, high, fs))
    return _stacked(column, lambda x: kernels.zero_phase_direct(b, a, x))


def remove_hum_direct(column: str | Column, fs: float, centre: float = 50.0, quality: float = 30.0) -> Column:
    b, a = kernels.polynomials(kernels.notch(centre, quality, fs))
    return _stacked(column, lambda x: kernels.zero_phase_direct(b, a, x))


def band_log_power(column: str | Column, fs: float, bands, order: int = 3) -> Column:
    """Log of the variance in each band: what stands in where spatial patterns give nothing."""
    filters = [kernels.butterworth_bandpass(order, low, high, fs) for _, low, high in bands]
    return _stacked(column, lambda x: np.stack([np.log(kernels.zero_phase(f, x).var(axis=-1) + 1e-10) for f in filters], axis=-1))


def stockwell_entropy(column: str | Column, fs: float, bands, low: float = 1.0, high: float = 50.0, count: int = 75) -> Column:
    return _stacked(column, lambda x: kernels.stockwell_entropy(x, fs, bands, low, high, count))


def stockwell_amplitude_entropy(column: str | Column, fs: float, bands, low: float = 1.0, high: float = 50.0, count: int = 75) -> Column:
    return _stacked(column, lambda x: kernels.stockwell_amplitude_entropy(x, fs, bands, low, high, count))


def filtered_entropy(column: str | Column, fs: float, bands) -> Column:
    return _stacked(column, lambda x: kernels.filtered_entropy(x, fs, bands))


def wavelet_log_variance(column: str | Column, order: int = 4, level: int = 5, mode: str = "symmetric") -> Column:
    return _stacked(column, lambda x: kernels.wavelet_log_variance(x, order, level, mode=mode))


def welch_density(column: str | Column, fs: float, nperseg: int) -> Column:
    return _stacked(column, lambda x: kernels.welch_density(x, fs, nperseg)[1])


def second_moments(rows: DataFrame, by: list[str], array: str, most: int = 1000) -> DataFrame:
    """by, n, total (array), products (flattened outer products).

    A task sums its rows first (of `most` groups at a time), then pieces of 64 entries are summed by position:
    no row ever holds more than one matrix, or 64 numbers of every task."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def part(batches):
        sums: dict = {}

        def out():
            keys = list(sums)
            frame = {c: [k[i] for k in keys] for i, c in enumerate(by)}
            return pd.DataFrame({**frame, "n": [sums[k][0] for k in keys], "entries": [np.concatenate([sums[k][1], sums[k][2].ravel()]) for k in keys]})

        for batch in batches:
            for key, group in batch.groupby(by, dropna=False) if by else [((), batch)]:
                x, key = np.stack(group[array].to_numpy()).astype(float), key if isinstance(key, tuple) else (key,)
                n, total, products = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(x), total + x.sum(axis=0), products + x.T @ x)
            if len(sums) > most:
                yield out()
                sums.clear()
        if sums:
            yield out()

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["n long", "entries array<double>"])
    parts = rows.where(F.col(array).isNotNull()).select(*by, array).mapInPandas(part, schema)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("entries") - 1) / 64).cast("int")), lambda k: F.slice("entries", k * 64 + 1, F.lit(64)))
    held = parts.select(*by, "n", F.posexplode(pieces).alias("at", "v")).groupBy(*by, "at").agg(F.sum("n").alias("n"), F.collect_list("v").alias("vs"))  # 64 numbers a task
    added = F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), F.get("vs", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    whole = held.withColumn("v", added).groupBy(*by).agg(F.max("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])).alias("e"))  # a matrix
    d = ((F.sqrt(1 + 4 * F.size("e").cast("double")) - 1) / 2).cast("int")
    return whole.withColumn("d", F.round(d).cast("int")).select(*by, "n", F.expr("slice(e, 1, d)").alias("total"), F.expr("slice(e, d + 1, d * d)").alias("products"))


def fit_pca(moments_row, share: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (columns, signs fixed) and explained shares: as many as reach `share`."""
    n, d = moments_row["n"], len(moments_row["total"])
    mean = np.array(moments_row["total"]) / n
    cov = np.array(moments_row["products"]).reshape(d, d) / n - np.outer(mean, mean)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    part = np.maximum(value, 0) / max(value.clip(0).sum(), 1e-300)
    k = int(np.searchsorted(np.cumsum(part), share - 1e-12) + 1)
    return mean, kernels.fix_signs(vector[:, :k]), part[:k]


def project(column: str | Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """(x - mean) @ components: a matrix of bounded size goes along with the function."""
    return _stacked(column, lambda x: (x - mean) @ components)


def fast_ica(x: np.ndarray, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Unmixing matrix of whitened rows by the symmetric fixed point with tanh; signs fixed."""
    rng, d = np.random.default_rng(seed), x.shape[1]

    def decorrelate(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = decorrelate(rng.normal(size=(d, d)))
    for _ in range(rounds):
        g = np.tanh(x @ w.T)
        fresh = decorrelate(g.T @ x / len(x) - np.diag((1 - g * g).mean(axis=0)) @ w)
        done = np.abs(np.abs((fresh * w).sum(axis=1)) - 1).max() < 1e-8
        w = fresh
        if done:
            break
    return kernels.fix_signs(w.T).T


def fit_ica(rows: DataFrame, array: str, mean: np.ndarray, whiten: np.ndarray, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """fast_ica of (array - mean) @ whiten over all rows: a round is one row of sums, the parts added in their order."""
    ship(rows.sparkSession)
    rng, d = np.random.default_rng(seed), whiten.shape[1]

    def decorrelate(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches):
            n, products, slopes = 0, np.zeros((d, d)), np.zeros(d)
            for batch in batches:
                x = (np.stack(batch[array].to_numpy()).astype(float) - mean) @ whiten
                g = np.tanh(x @ w.T)
                n, products, slopes = n + len(x), products + g.T @ x, slopes + (1 - g * g).sum(axis=0)
            yield pd.DataFrame({"sums": [np.concatenate([[float(n)], slopes, products.ravel()])]})

        parts = held.mapInPandas(part, "sums array<double>").select(F.spark_partition_id().alias("p"), "sums")
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("p", "sums"))), F.array_repeat(F.lit(0.0), 1 + d + d * d), lambda a, x: F.zip_with(a, x["sums"], lambda u, v: u + v))
        out = np.array(parts.agg(total.alias("s")).first()["s"])
        return out[1 + d :].reshape(d, d) / out[0], out[1 : 1 + d] / out[0]

    held = rows.where(F.col(array).isNotNull()).select(array).persist()
    w = decorrelate(rng.normal(size=(d, d)))
    for _ in range(rounds):
        products, slopes = sums(w)
        fresh = decorrelate(products - np.diag(slopes) @ w)
        done = np.abs(np.abs((fresh * w).sum(axis=1)) - 1).max() < 1e-8
        w = fresh
        if done:
            break
    held.unpersist()
    return kernels.fix_signs(w.T).T
