"""Recordings and tensors from files in any store that Spark reads: bytes arrive by the binaryFile source."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Fixed layout of a Neuroscan CNT file: offsets in the 900-byte header and the 75-byte channel records.
CNT_HEADER, CNT_CHANNEL = 900, 75
AT_CHANNELS, AT_RATE, AT_EVENTS = 370, 376, 886
AT_BASELINE, AT_SENSITIVITY, AT_CALIBRATION = 47, 59, 71
#: Reference and eye channels that analyses leave out.
NOT_BRAIN = ("M1", "M2", "VEO", "HEO")


def cnt_layout(head: bytes) -> tuple[list[str], int, np.ndarray, np.ndarray, int]:
    """Names, rate, baselines, scales (to microvolts) and where the samples end. 64-bit sizes throughout."""
    n, rate = struct.unpack_from("<H", head, AT_CHANNELS)[0], struct.unpack_from("<H", head, AT_RATE)[0]
    names, base, scale = [], [], []
    for k in range(n):
        at = CNT_HEADER + CNT_CHANNEL * k
        names.append(head[at : at + 10].split(b"\0")[0].decode("latin-1").strip())
        base.append(struct.unpack_from("<h", head, at + AT_BASELINE)[0])
        scale.append(struct.unpack_from("<f", head, at + AT_SENSITIVITY)[0] * struct.unpack_from("<f", head, at + AT_CALIBRATION)[0] / 204.8)
    return names, rate, np.array(base, float), np.array(scale, float), struct.unpack_from("<I", head, AT_EVENTS)[0]


def encode_cnt(samples: np.ndarray, names: list[str], rate: int) -> bytes:
    """The smallest file that cnt_layout reads: samples (time, channel) as 32-bit integers of unit scale."""
    head = bytearray(CNT_HEADER + CNT_CHANNEL * len(names))
    struct.pack_into("<H", head, AT_CHANNELS, len(names))
    struct.pack_into("<H", head, AT_RATE, rate)
    for k, name in enumerate(names):
        at = CNT_HEADER + CNT_CHANNEL * k
        head[at : at + len(name)] = name.encode("latin-1")
        struct.pack_into("<f", head, at + AT_SENSITIVITY, 204.8)
        struct.pack_into("<f", head, at + AT_CALIBRATION, 1.0)
    body = samples.astype("<i4").tobytes()
    struct.pack_into("<I", head, AT_EVENTS, len(head) + len(body))
    return bytes(head) + body


def read_cnt(spark: SparkSession, path: str, ranges: list[tuple[int, int, int]] | None = None, drop: tuple[str, ...] = NOT_BRAIN, rate: int | None = None, width: int = 4) -> DataFrame:
    """subject, session, trial_idx, channel, channel_name, fs, samples; keys come from `{subject}_{session}.cnt`.

    ranges: (trial_idx, start, end) in samples; only those are decoded. One row per trial and channel bounds
    the row's size. Files with another rate than `rate`, where given, raise; names that don't parse are skipped."""
    ship(spark)
    files = keyed_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.cnt").load(path), "path").select("subject", "session", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, session, raw in zip(batch["subject"], batch["session"], batch["content"]):
                names, fs, base, scale, end = cnt_layout(raw)
                if rate is not None and fs != rate:
                    raise ValueError(f"{subject}_{session}: {fs} Hz, not {rate}")
                start = CNT_HEADER + CNT_CHANNEL * len(names)
                data = np.frombuffer(raw, dtype=f"<i{width}", offset=start, count=(end - start) // width // max(len(names), 1) * len(names)).reshape(-1, max(len(names), 1))
                keep = [k for k, name in enumerate(names) if name not in drop]
                for trial, a, b in ranges or [(0, 0, len(data))]:
                    part = (data[a:b][:, keep] - base[keep]) * scale[keep]
                    yield pd.DataFrame({"subject": subject, "session": session, "trial_idx": trial, "channel": range(len(keep)), "channel_name": [names[k] for k in keep], "fs": fs, "samples": list(part.T.astype(np.float32))})

    schema = "subject int, session int, trial_idx int, channel int, channel_name string, fs int, samples array<float>"
    return files.mapInPandas(decode, schema)


def keyed_files(files: DataFrame, path: str) -> DataFrame:
    """Adds subject and session from names like 3_1.cnt; other names are skipped."""
    name = F.element_at(F.split(path, "/"), -1)
    key = lambda k: F.regexp_extract(name, r"^(\d+)_(\d+)[._]", k)
    return files.where(key(1) != "").withColumn("subject", key(1).cast("int")).withColumn("session", key(2).cast("int"))


def discover(spark: SparkSession, path: str, suffix: str, companion: str) -> DataFrame:
    """subject, session, path of files with `suffix` that have a companion file with the other suffix."""
    listing = keyed_files(spark.read.format("binaryFile").load(path).select("path"), "path")
    mine = listing.where(F.endswith("path", F.lit(suffix)))
    return mine.join(listing.where(F.endswith("path", F.lit(companion))).select("subject", "session"), ["subject", "session"], "left_semi")


def skipped(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Names that an extension filter leaves out: for the report."""
    names = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.where(~F.endswith("name", F.lit(suffix)))


def npy_layout(raw: bytes) -> tuple[np.dtype, tuple[int, ...], int, bool]:
    """dtype, shape, where the data begin, Fortran order: the public header of the format."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    wide = raw[6] >= 2
    size = struct.unpack_from("<I" if wide else "<H", raw, 8)[0]
    start = (12 if wide else 10) + size
    head = ast.literal_eval(raw[start - size : start].decode("latin-1"))
    return np.dtype(head["descr"]), tuple(head["shape"]), start, head["fortran_order"]


def read_npy(spark: SparkSession, path: str, decimate: int = 1) -> DataFrame:
    """subject, session, row_idx, channel, samples of tensors (windows, channels, time) named {subject}_{session}_raw.npy.

    Decimation happens while decoding, without a full copy. Several files form one collection; rows carry
    their file's key, so no global index is needed."""
    ship(spark)
    files = keyed_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path), "path").select("subject", "session", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, session, raw in zip(batch["subject"], batch["session"], batch["content"]):
                kind, shape, start, fortran = npy_layout(raw)
                data = np.frombuffer(raw, dtype=kind, offset=start).reshape(shape, order="F" if fortran else "C")
                for w in range(shape[0]):
                    part = data[w, :, ::decimate].astype(np.float32)
                    yield pd.DataFrame({"subject": subject, "session": session, "row_idx": w, "channel": range(len(part)), "samples": list(part)})

    return files.mapInPandas(decode, "subject int, session int, row_idx long, channel int, samples array<float>")


def write_tensor(windows: DataFrame, path: str, keys: tuple[str, ...] = ("subject", "session")) -> None:
    """One row per (window, channel), partitioned by recording: the columnar stand-in for a tensor file."""
    windows.write.mode("overwrite").partitionBy(*keys).parquet(path)


def append_columns(spark: SparkSession, source: str, target: str, columns: dict[str, Column]) -> DataFrame:
    """source with new columns, written to target; columns that exist already are left alone, so a rerun changes nothing."""
    held = spark.read.parquet(source)
    held.withColumns({k: c for k, c in columns.items() if k not in held.columns}).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("classifier string, subject int, session int, fold int, accuracy double").csv(path, header=True)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)
