"""Ranges of recordings and tensors as partitions: a task seeks and reads the bytes of its range, not the file.

Python data sources. Paths are those of a folder that pyarrow can list (local or mounted, s3://, hdfs://, ..)."""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage

from ..ship import ship
from .recordings import AT_CHANNELS, CNT_CHANNEL, CNT_HEADER, NOT_BRAIN, cnt_layout, npy_layout

#: Where the session sets this, filters on keys choose files and ranges; else they are applied after the scan, to the same result.
PUSH = "spark.sql.python.filterPushdown.enabled"
#: Samples of each channel that a partition reads: 64 channels of four bytes make 64 MB.
PACK = 1 << 18
#: Bytes of a tensor file that a partition reads, in ranges of `rows` windows each.
NPY_PACK = 1 << 22

@dataclass
class Part(InputPartition):
    """Some ranges of one file: its key, and (a number of its own, start, end) of each, in samples or rows."""

    path: str
    subject: int
    session: int
    ranges: list[tuple[int, int, int]]
    first: int = 0  # the number of the recording's first row


def packed(ranges: list[tuple[int, int, int]], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Ranges in their order, put together up to `most` samples or rows a partition; a longer one stands alone."""
    held, size = [], 0
    for r in ranges:
        if held and size + r[2] - r[1] > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += r[2] - r[1]
    if held:
        yield held


_TESTS = {"EqualTo": lambda a, b: a == b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b, "In": lambda a, b: a in b}


class Keyed(DataSourceReader):
    """Readers whose files and ranges have keys."""

    keys: tuple[str, ...] = ()
    wanted: tuple[tuple, ...] = ()

    def passes(self, **keys: int) -> bool:
        return all(_TESTS[name](keys[column], value) for column, name, value in self.wanted if column in keys)


class Pushed:
    """Mixed into a Keyed reader: comparisons of keys with constants choose what is opened at all."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, against = type(f).__name__, getattr(f, "value", None)
            column = getattr(f, "attribute", ())
            if name == "IsNotNull" and len(column) == 1 and column[0] in self.keys:
                continue  # keys are never null
            if name in _TESTS and len(column) == 1 and column[0] in self.keys and against is not None:
                self.wanted = (*self.wanted, (column[0], name, against))
            else:
                yield f


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _files(folder: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path, subject, session) of names like 3_1.cnt, 3_1_raw.npy or, for shards, 3_1_raw-00002.npy, in their order; other names are skipped."""
    store, at = _store(folder)
    out = []
    for info in store.get_file_info(fs.FileSelector(at)):
        key = re.fullmatch(r"(\d+)_(\d+)(?:_raw)?(?:-(\d+))?" + re.escape(suffix), info.base_name)
        if key and info.is_file:
            out.append((int(key[1]), int(key[2]), int(key[3] or 0), info.path))
    return [(path, subject, session) for subject, session, _, path in sorted(out)]


class Opened:
    """A file, opened once for all of its ranges."""

    def __init__(self, folder: str, path: str) -> None:
        self.file = _store(folder)[0].open_input_file(path)

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bytes(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)


class CntReader(Keyed):
    keys = ("subject", "session", "trial_idx")

    def __init__(self, options: dict) -> None:
        self.folder, self.width, self.pack = options["path"], int(options.get("width", 4)), int(options.get("pack", PACK))
        self.ranges, self.drop = json.loads(options["ranges"]), set(json.loads(options["drop"]))

    def partitions(self) -> list[Part]:
        ranges = [(int(i), int(a), int(b)) for i, a, b in self.ranges if self.passes(trial_idx=i)]
        files = [f for f in _files(self.folder, ".cnt") if self.passes(subject=f[1], session=f[2])]
        return [Part(*file, part) for file in files for part in packed(ranges, self.pack)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with Opened(self.folder, part.path) as file:
            n = int.from_bytes(file.bytes(AT_CHANNELS, 2), "little")
            head = file.bytes(0, CNT_HEADER + n * CNT_CHANNEL)
            names, rate, base, scale, stop = cnt_layout(head)
            row, first = self.width * max(n, 1), len(head)
            keep = [k for k, name in enumerate(names) if name not in self.drop]
            for index, start, end in part.ranges:
                last = min(end, (stop - first) // row)
                if not n or start >= last:
                    continue
                data = np.frombuffer(file.bytes(first + start * row, (last - start) * row), dtype=f"<i{self.width}").reshape(-1, n)
                values = ((data[:, keep] - base[keep]) * scale[keep]).T.astype(np.float32)
                same = lambda x, t: pa.array(np.full(len(keep), x), t)
                samples = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * (last - start), pa.int32()), pa.array(values.ravel()))
                columns = [same(part.subject, pa.int32()), same(part.session, pa.int32()), same(index, pa.int32()), pa.array(range(len(keep)), pa.int32()), pa.array([names[k] for k in keep]), same(rate, pa.int32()), samples]
                yield pa.RecordBatch.from_arrays(columns, schema=_CNT)


class PushedCntReader(Pushed, CntReader):
    pass


_CNT = pa.schema([("subject", pa.int32()), ("session", pa.int32()), ("trial_idx", pa.int32()), ("channel", pa.int32()), ("channel_name", pa.string()), ("fs", pa.int32()), ("samples", pa.list_(pa.float32()))])


class CntRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cnt_ranges"

    def schema(self) -> str:
        return "subject int, session int, trial_idx int, channel int, channel_name string, fs int, samples array<float>"

    def reader(self, schema) -> CntReader:
        return (PushedCntReader if self.options.get("pushed") == "true" else CntReader)(self.options)


class NpyReader(Keyed):
    keys = ("subject", "session")

    def __init__(self, options: dict) -> None:
        self.folder, self.rows, self.decimate, self.pack = options["path"], int(options.get("rows", 64)), int(options.get("decimate", 1)), int(options.get("pack", 0))

    def _layout(self, path: str) -> tuple:
        with Opened(self.folder, path) as file:
            return npy_layout(file.bytes(0, 1 << 12))

    def partitions(self) -> list[Part]:
        """The collection's index counts the windows of all files, whichever are wanted; headers are read sixteen at a time."""
        files = _files(self.folder, ".npy")
        with ThreadPoolExecutor(16) as pool:
            sizes = [(layout[1][0], int(np.prod(layout[1][1:])) * layout[0].itemsize) for layout in pool.map(self._layout, (f[0] for f in files))]
        out, index, first = [], 0, {}
        for (path, subject, session), (n, row) in zip(files, sizes):
            start = first.setdefault((subject, session), index)
            if self.passes(subject=subject, session=session):
                ranges = [(index + a, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
                out += [Part(path, subject, session, part, start) for part in packed(ranges, max(self.rows, self.pack // max(row, 1)))]
            index += n
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with Opened(self.folder, part.path) as file:
            kind, shape, first, fortran = npy_layout(file.bytes(0, 1 << 12))
            if fortran:
                raise ValueError(f"{part.path}: rows of a tensor in Fortran order aren't ranges of bytes")
            row = int(np.prod(shape[1:])) * kind.itemsize
            for index, start, end in part.ranges:
                data = np.frombuffer(file.bytes(first + start * row, (end - start) * row), dtype=kind)
                data = data.reshape(-1, *shape[1:])[..., :: self.decimate].astype(np.float32)
                n, channels, size = data.shape
                number = np.repeat(np.arange(index, index + n), channels)
                same = lambda x: pa.array(np.full(n * channels, x, np.int32))
                samples = pa.ListArray.from_arrays(pa.array(np.arange(n * channels + 1) * size, pa.int32()), pa.array(data.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(number), same(part.subject), same(part.session), pa.array(number - part.first), pa.array(np.tile(np.arange(channels, dtype=np.int32), n)), samples], schema=_NPY)


class PushedNpyReader(Pushed, NpyReader):
    pass


_NPY = pa.schema([("global_idx", pa.int64()), ("subject", pa.int32()), ("session", pa.int32()), ("row_idx", pa.int64()), ("channel", pa.int32()), ("samples", pa.list_(pa.float32()))])


@dataclass
class Shards(WriterCommitMessage):
    """What a task wrote: (temporary path, subject, session, first row) of each shard."""

    shards: list[tuple[str, int, int, int]]


class NpyWriter(DataSourceArrowWriter):
    """Rows (subject, session, row_idx, samples) to shards of .npy files, in the order they come.

    A shard holds `rows` rows of one recording at most, so a task holds no more in memory and knows the header before it
    writes. Shards are written under names that no reader takes; commit gives them their numbers, in the order of
    their first rows, and abort deletes them. A task that fails deletes its own; those of lost executors go
    with the commit."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.shape, self.rows = options["path"], tuple(json.loads(options["shape"])), int(options.get("rows", 4096))
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shards:
        store, at = _store(self.folder)
        store.create_dir(at, recursive=True)
        out, held, key = Shards([]), [], None

        def flush() -> None:
            if held:
                path, data = f"{at}/.{self.job}-{uuid.uuid4().hex}", np.stack([x for _, x in held]).reshape(-1, *self.shape)
                out.shards.append((path, *key, held[0][0]))
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": data.shape})
                with store.open_output_stream(path) as file:
                    file.write(head.getvalue())
                    file.write(data.tobytes())
                held.clear()

        try:
            for batch in batches:
                subject, session, row, samples = (batch.column(batch.schema.get_field_index(c)) for c in ("subject", "session", "row_idx", "samples"))
                for s, t, r, x in zip(subject.to_pylist(), session.to_pylist(), row.to_pylist(), samples):
                    if (s, t) != key or len(held) == self.rows:
                        flush()
                        key = (s, t)
                    held.append((r, np.asarray(x.values, dtype="<f4")))
            flush()
        except BaseException:
            self._delete([p for p, *_ in out.shards])
            raise
        return out

    def _delete(self, paths: list[str]) -> None:
        store = _store(self.folder)[0]
        for path in paths:
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_file(path)

    def _left(self) -> list[str]:
        store, at = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return [f.path for f in found if f.base_name.startswith(f".{self.job}-")]

    def commit(self, messages: list[Shards | None]) -> None:
        store, at = _store(self.folder)
        store.create_dir(at, recursive=True)
        before = [path for path, *_ in _files(self.folder, ".npy")]
        if self.overwrite:
            self._delete(before)
        number: dict[tuple[int, int], int] = {}
        for path in [] if self.overwrite else before:
            subject, session, shard = re.fullmatch(r".*/(\d+)_(\d+)_raw(?:-(\d+))?\.npy", path).groups()
            number[int(subject), int(session)] = max(number.get((int(subject), int(session)), 0), int(shard or 0) + 1)
        for path, subject, session, _ in sorted((x for m in messages if m for x in m.shards), key=lambda x: x[1:]):
            k = number.get((subject, session), 0)
            number[subject, session] = k + 1
            store.move(path, f"{at}/{subject}_{session}_raw-{k:05}.npy")
        self._delete(self._left())

    def abort(self, messages: list[Shards | None]) -> None:
        self._delete(self._left())


class NpyRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "global_idx long, subject int, session int, row_idx long, channel int, samples array<float>"

    def reader(self, schema) -> NpyReader:
        return (PushedNpyReader if self.options.get("pushed") == "true" else NpyReader)(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


@contextmanager
def pushed_down(spark: SparkSession) -> Iterator[None]:
    """Within it, filters are handed to the sources of this module by what runs there; the session's setting is restored."""
    before = spark.conf.get(PUSH, "false")
    spark.conf.set(PUSH, "true")
    try:
        yield
    finally:
        spark.conf.set(PUSH, before)


def read_cnt_ranges(spark: SparkSession, path: str, ranges: list[tuple[int, int, int]], drop: tuple[str, ...] = NOT_BRAIN, width: int = 4, pack: int = PACK) -> DataFrame:
    """subject, session, trial_idx, channel, channel_name, fs, samples of every (trial_idx, start, end) of every file. Ranges end with the file.

    A partition reads ranges of one file, up to `pack` samples of each channel; its file is opened, and its header read, once.
    Comparisons of subject, session and trial_idx with constants choose files and ranges before anything is read, where the session sets PUSH."""
    ship(spark)
    spark.dataSource.register(CntRanges)
    return spark.read.format("cnt_ranges").options(path=path, ranges=json.dumps(ranges), drop=json.dumps(list(drop)), width=str(width), pack=str(pack), pushed=spark.conf.get(PUSH, "false")).load()


def read_npy_rows(spark: SparkSession, path: str, rows: int = 64, decimate: int = 1, pack: int = NPY_PACK) -> DataFrame:
    """Several tensor files as one collection: global_idx counts their windows in the order of their keys, (file, row_idx) tells the place.

    `rows` windows of a file are read at a time, and a partition reads up to `pack` bytes of it; every `decimate`-th sample is kept."""
    ship(spark)
    spark.dataSource.register(NpyRows)
    return spark.read.format("npy_rows").options(path=path, rows=str(rows), decimate=str(decimate), pack=str(pack), pushed=spark.conf.get(PUSH, "false")).load()


def write_files(files: DataFrame, folder: str) -> int:
    """files: name, content (binary). Each is written beside its place and moved there, so a task that runs again changes nothing."""
    ship(files.sparkSession)

    def write(batches):
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = f"{at}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return files.select("name", "content").mapInArrow(write, "name string").agg(F.count(F.lit(1)).alias("n")).first()["n"]


def write_npy(rows: DataFrame, path: str, shape: tuple[int, ...], most: int = 4096, overwrite: bool = True) -> None:
    """rows: subject, session, row_idx, samples (flat, of `shape`). Written as .npy shards that read_npy_rows reads in the order of row_idx.

    Rows are dealt by ranges of their keys, so a recording may be many tasks' work and no task holds one whole."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(NpyRows)
    keys = ["subject", "session", "row_idx"]
    cast = rows.select(F.col("subject").cast("int"), F.col("session").cast("int"), F.col("row_idx").cast("long"), F.col("samples").cast("array<float>"))
    dealt = cast.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.write.format("npy_rows").mode("overwrite" if overwrite else "append").options(path=path, shape=json.dumps(list(shape)), rows=str(most)).save()
