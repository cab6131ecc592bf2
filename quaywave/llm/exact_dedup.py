"""Exact deduplication by Grace hashing.

Rows with equal texts form a group; one row of each group stays. Groups are made by comparing whole
contents, never only hashes. A map-side table first folds the copies inside each task's rows, so a text that a third
of all rows share reaches the exchange once per task and not once per row. The exchange deals the
folded records by hash; a task whose share outgrows its table writes it to spill files by further
hash bits and recurses, until each bucket fits. Spill files live and die inside one task attempt,
like those of a sort; an executor that is lost takes nothing with it that a rerun cannot make anew."""

from __future__ import annotations

import hashlib
import os
import pickle
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..ship import ship
from .common import materialize, spread_join, text_of

_HEAD = struct.Struct("<QqQQQ")
_NONE = -(1 << 63)
Record = tuple[int, int, int, bytes, bytes]  # hash, largest id, rows, content, what else the row with that id carries


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete content does."""

    def __init__(self, slots: int = 1024) -> None:
        self.slots, self.hashes, self.contents, self.best, self.rows, self.rest, self.bytes = [-1] * slots, [], [], [], [], [], 0

    def add(self, h: int, top: int, n: int, content: bytes, rest: bytes = b"") -> None:
        """A content met again keeps the larger (id, rest) and adds up its rows."""
        mask, i = len(self.slots) - 1, h & (len(self.slots) - 1)
        while (at := self.slots[i]) >= 0:
            if self.hashes[at] == h and self.contents[at] == content:
                self.best[at], self.rest[at] = max((self.best[at], self.rest[at]), (top, rest))
                self.rows[at] += n
                return
            i = (i + 1) & mask
        self.slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(top)
        self.rows.append(n)
        self.rest.append(rest)
        self.bytes += len(content) + len(rest) + 160
        if len(self.hashes) * 5 > len(self.slots) * 3:
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for at, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = at

    def drain(self) -> Iterator[Record]:
        yield from zip(self.hashes, self.best, self.rows, self.contents, self.rest)
        self.__init__()


def fold(records: Iterable[Record], budget: int) -> Iterator[Record]:
    """Folds copies as far as a table of `budget` bytes sees them; the same content may leave more than once."""
    table = ContentTable()
    for record in records:
        table.add(*record)
        if table.bytes > budget:
            yield from table.drain()
    yield from table.drain()


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as file:
        while head := file.read(_HEAD.size):
            h, top, n, size, more = _HEAD.unpack(head)
            yield h, top, n, file.read(size), file.read(more)


def grace(records: Iterable[Record], budget: int, depth: int = 0, fan_bits: int = 4) -> Iterator[Record]:
    """Each distinct content once. Recursion ends where the hash has no bits left: contents that still
    share a bucket then have one 64-bit hash, and the table compares them whatever its size."""
    table, folder, files = ContentTable(), None, {}
    shift = 64 - fan_bits * (depth + 1)

    def spill() -> None:
        for h, top, n, content, rest in table.drain():
            k = (h >> shift) & ((1 << fan_bits) - 1)
            if k not in files:
                files[k] = open(os.path.join(folder.name, str(k)), "wb")
            files[k].write(_HEAD.pack(h, top, n, len(content), len(rest)) + content + rest)

    try:
        for record in records:
            table.add(*record)
            if table.bytes > budget and shift >= 0:
                folder = folder or tempfile.TemporaryDirectory(prefix="grace-")
                spill()
        if folder is None:
            yield from table.drain()
            return
        spill()
        for file in files.values():
            file.close()
        for k in sorted(files):
            yield from grace(_read(os.path.join(folder.name, str(k))), budget, depth + 1, fan_bits)
            os.unlink(os.path.join(folder.name, str(k)))
    finally:
        for file in files.values():
            file.close()
        if folder is not None:
            folder.cleanup()


def _arrow(records: Iterable[Record], finish, schema: pa.Schema, rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for record in records:
        held.append(finish(*record))
        held_bytes += len(record[3]) + len(record[4])
        if len(held) >= rows or held_bytes >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_PARTIAL = pa.schema([("h", pa.int64()), ("top", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), ("rest", pa.binary())])


def _folded(rows: DataFrame, records, table_bytes: int) -> DataFrame:
    """Map-side fold of `records` (batch to records), then the exchange that deals by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (record for batch in batches for record in records(batch))
        yield from _arrow(fold(stream, table_bytes), lambda h, top, n, content, rest: (h - (1 << 63), top, n, content, rest), _PARTIAL)

    return rows.mapInArrow(run, "h long, top long, n long, content binary, rest binary").repartition("h")


def _resolved(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[Record]:
    def rows() -> Iterator[Record]:
        for batch in batches:
            for h, top, n, content, rest in zip(*(batch.column(i) for i in range(5))):
                yield h.as_py() + (1 << 63), top.as_py(), n.as_py(), content.as_py(), rest.as_py()

    return grace(rows(), table_bytes)


def grace_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts equal the empty text. The row with the largest id stays; rows with a null id never stay
    before one with an id, and of repeated rows with the same id each is kept (kept tells by id; keep_one
    keeps a single row). Extra columns are ignored, an empty table gives an empty result. table_bytes bounds
    each table. Rows find the group of their text by its SHA-256; a text that many rows share is a hot key there."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("content"))
    whole = pa.schema([("sha", pa.string()), ("top", pa.int64()), ("n", pa.int64())])

    def records(batch: pa.RecordBatch) -> Iterator[Record]:
        for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_py()
            yield xxhash.xxh3_64_intdigest(raw), _NONE if key is None else key, 1, raw, b""

    def finish(h: int, top: int, n: int, content: bytes, rest: bytes) -> tuple:
        return hashlib.sha256(content).hexdigest(), None if top == _NONE else top, n

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _arrow(_resolved(batches, table_bytes), finish, whole)

    groups = _folded(texts, records, table_bytes).mapInArrow(resolve, "sha string, top long, n long")
    members = materialize(docs.select(F.col(id_col).alias("id"), F.sha2(text_of(text_col), 256).alias("sha")), "exact-members")
    return spread_join(members, groups, ["sha"], ["id"]).select(
        F.col("id").alias(id_col),
        F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("top")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs that stay, all columns: exactly one for each distinct text, null counting as empty.

    The row with the largest id stays; rows without an id stay only where none of their text has one. Of
    repeated rows with that id a single one stays, chosen by the bytes of its other columns, so reruns agree. The
    other columns travel with the text through the same fold, exchange and tables: the whole is one exchange."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    others = [c for c in names if c != text_col]

    def records(batch: pa.RecordBatch) -> Iterator[Record]:
        keys, text = batch.column(0).to_pylist(), batch.column(1)
        rest = zip(*(batch.column(2 + i).to_pylist() for i in range(len(others)))) if others else [()] * len(keys)
        for key, content, values in zip(keys, text, rest):
            raw = b"" if content.as_py() is None else content.as_py().encode("utf-8", "surrogatepass")
            yield xxhash.xxh3_64_intdigest(raw), _NONE if key is None else key, 1, raw, pickle.dumps((content.as_py() is not None, values), 4)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(h: int, top: int, n: int, content: bytes, rest: bytes) -> tuple:
            told, values = pickle.loads(rest)
            by_name = dict(zip(others, values)) | {text_col: content.decode("utf-8", "surrogatepass") if told else None}
            return tuple(by_name[c] for c in names)

        yield from _arrow(_resolved(batches, table_bytes), finish, to_arrow_schema(schema))

    rows = docs.select(F.col(id_col).cast("long").alias("__quaywave_id"), F.col(text_col).alias("__quaywave_text"), *others)
    return _folded(rows, records, table_bytes).mapInArrow(resolve, schema)
