"""Filters over series that are longer than a row: a recurrence is run block by block, each from the state it is due.

A filter is linear, so a block's end state is that of the block begun at rest, plus a fixed small matrix (the power of
one sample's) times its start state. Blocks are run at rest first, all at once; the start states of a series' blocks
then follow from one small row a block; and the blocks are run again from these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..ship import ship
from ..sources.scratch import settle


def cut_blocks(samples: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """key, block, blocks, x: a series (pos, n as of number_samples) in arrays of `size` samples, the last of up to twice as many."""
    blocks = F.greatest(F.floor(F.col("n") / size), F.lit(1)).cast("int")
    rows = samples.withColumn("blocks", blocks).withColumn("block", F.least(F.floor(F.col("pos") / size).cast("int"), F.col("blocks") - 1))
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v"))))
    return rows.groupBy(key, "block", "blocks").agg(F.transform(sorted_, lambda s: s["v"]).alias("x"))


def run_sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second-order sections over the rows of x from a state (rows, sections, 2): the outputs and the end states."""
    y, state = x.T.copy(), state.copy()
    for k, s in enumerate(sos):
        z1, z2 = state[:, k, 0], state[:, k, 1]
        for t in range(len(y)):
            v = y[t].copy()
            y[t] = s[0] * v + z1
            z1 = s[1] * v - s[4] * y[t] + z2
            z2 = s[2] * v - s[5] * y[t]
        state[:, k, 0], state[:, k, 1] = z1, z2
    return y.T, state


def calm(sos: np.ndarray, first: float) -> np.ndarray:
    """The state in which the sections have seen `first` forever."""
    out = np.zeros((len(sos), 2))
    for k, s in enumerate(sos):
        out[k] = np.array(kernels._steady(s)) * first
        first = s[0] * first + out[k, 0]
    return out


def transition(sos: np.ndarray) -> np.ndarray:
    """What one sample of silence does to the state, as a matrix."""
    n = 2 * len(sos)
    _, end = run_sections(sos, np.zeros((n, 1)), np.eye(n).reshape(n, len(sos), 2))
    return end.reshape(n, n).T


def padding(sos: np.ndarray) -> int:
    zeros = min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    return 3 * (2 * len(sos) + 1 - zeros)


def _some(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Batches in pieces of a few rows: a row is a whole block, and each step copies its rows several times."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.iloc[a : a + rows]


def _one_way(rows: DataFrame, key: str, sos: np.ndarray, backward: bool) -> DataFrame:
    """rows: key, block, blocks, x. x filtered along the series, in or against its direction."""
    n, step = 2 * len(sos), -1 if backward else 1

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            for _, part in batch.groupby(batch["x"].map(len)):
                x = np.stack(part["x"].to_numpy())[:, ::step]
                _, end = run_sections(sos, x, np.zeros((len(x), len(sos), 2)))
                yield part[[key, "block"]].assign(length=x.shape[1], first=x[:, 0], end=list(end.reshape(-1, n)))

    def starts(part: pd.DataFrame) -> pd.DataFrame:
        part, matrix, power = part.sort_values("block", ascending=not backward), transition(sos), {}
        state, out = calm(sos, part["first"].iloc[0]).ravel(), []
        for length, end in zip(part["length"], part["end"]):
            out.append(state)
            if length not in power:
                power[length] = np.linalg.matrix_power(matrix, length)
            state = power[length] @ state + end
        return part[[key, "block"]].assign(state=out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            for _, part in batch.groupby(batch["x"].map(len)):
                x = np.stack(part["x"].to_numpy())[:, ::step]
                y, _ = run_sections(sos, x, np.stack(part["state"].to_numpy()).reshape(-1, len(sos), 2))
                yield part[[key, "block", "blocks"]].assign(x=list(y[:, ::step]))

    kind = dict(rows.dtypes)[key]
    small = rows.mapInPandas(ends, f"{key} {kind}, block int, length int, first double, end array<double>")
    due = small.groupBy(key).applyInPandas(starts, f"{key} {kind}, block int, state array<double>")  # a row a block
    return rows.join(due, [key, "block"]).select(key, "block", "blocks", "x", "state").mapInPandas(run, f"{key} {kind}, block int, blocks int, x array<double>")


def zero_phase_blocks(rows: DataFrame, key: str, sos: np.ndarray) -> DataFrame:
    """rows: key (not null), block, blocks, x. The same with x filtered forward and backward, as kernels.zero_phase does a whole series.

    Both ends are extended by their odd reflection first, so the first and the last block must hold more samples than
    padding(sos), unless a series is one block. No task holds a series; a series' states are one row a block."""
    ship(rows.sparkSession)
    pad = padding(sos)

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            out = []
            for block, blocks, x in zip(batch["block"], batch["blocks"], batch["x"]):
                most = min(pad, len(x) - 1)
                if blocks > 1 and block in (0, blocks - 1) and most < pad:
                    raise ValueError(f"the first and the last block need over {pad} samples")
                head = 2 * x[0] - x[most:0:-1] if block == 0 else x[:0]
                tail = 2 * x[-1] - x[-2 : -most - 2 : -1] if block == blocks - 1 else x[:0]
                out.append(np.concatenate([head, x, tail]))
            yield batch.assign(x=out)

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            out = []
            for block, blocks, x in zip(batch["block"], batch["blocks"], batch["x"]):
                most = pad if blocks > 1 else min(pad, (len(x) - 1) // 3)  # a short series of m samples became 3 m - 2
                out.append(x[most if block == 0 else 0 : len(x) - (most if block == blocks - 1 else 0)])
            yield batch.assign(x=out)

    schema = f"{key} {dict(rows.dtypes)[key]}, block int, blocks int, x array<double>"
    whole = settle(rows.select(key, "block", "blocks", "x").mapInPandas(extend, schema), "blocks-extended")
    forward = settle(_one_way(whole, key, sos, False), "blocks-forward")
    return _one_way(forward, key, sos, True).mapInPandas(trim, schema)
