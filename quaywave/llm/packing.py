"""Best-fit packing planned over a histogram of piece lengths."""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize, rank_within, text_of

#: The byte-level vocabulary in tiktoken's form, which encodes several times faster; the ids equal those
#: of byte_bpe_50k.json under `tokenizers` (a test holds them together).
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 0
_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Text to ids; one encoder per process. `vocabulary`: a name for public_tokenizers.path, or a path."""
    if vocabulary not in _encoders:
        import public_tokenizers

        path = vocabulary if "/" in vocabulary else str(public_tokenizers.path(vocabulary))
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            _encoders[vocabulary] = lambda text: model.encode(text, add_special_tokens=False).ids
        else:
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special = {"<|endoftext|>": 50256} if 50256 not in ranks.values() else {}
            model = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

            def encode(text: str) -> list[int]:
                try:
                    return model.encode(text, allowed_special="all")
                except ValueError:  # its pattern gives up on very long white space; `tokenizers` does not
                    return encoder(vocabulary.removesuffix(".tiktoken") + ".json")(text)

            _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """(piece, start, length): all of `capacity` ids but the first, which takes what is over."""
    first = (len(ids) - 1) % capacity + 1
    starts = [0, *range(first, len(ids), capacity)]
    return [(k, a, b - a) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def cut_documents(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """Every document's ids and the closing id, as pieces: id, piece, start, length, ids_crc32."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), END], dtype="<u4")
                out += [(key, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, a, n in pieces_of(ids, capacity)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, sequences, offset).

    The pieces of a length with ranks first .. first + ranks - 1 go, `ranks / sequences` after each other
    from `offset` on, to the sequences from the first on. Open sequences with equal content are one run
    of numbers; a placement extends the fullest run that fits and splits it at most once. So the work and
    the plan depend on the number of lengths, not of documents."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: [(first sequence, sequences)]
    rooms: list[int] = []
    plan, fresh = [], 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room and room not in runs:
            bisect.insort(rooms, room)
        if room:
            runs[room].append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            each = min(room // length, left)
            used = min(n, left // each)
            plan.append((length, rank, used * each, first, used, capacity - room))
            rank, left = rank + used * each, left - used * each
            put(room - each * length, (first, used))
            if used < n:
                if room == capacity and at >= len(rooms) and not left:
                    fresh -= n - used
                elif room == capacity:  # sequences that are still empty hold the rest of this length
                    plan.append((length, rank, left, first + used, 1, 0))
                    put(room - left * length, (first + used, 1))
                    rank, left = rank + left, 0
                else:
                    put(room, (first + used, n - used))
    return plan


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the closing id alone. Only documents over `capacity` ids are cut. The
    histogram has at most `capacity` rows, the plan a bounded number of runs, whatever the corpus; pieces
    find their slot by joining on their rank within their length. Repeated rows are packed as often as
    they occur. An empty table gives an empty result."""
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, id_col, text_col, capacity, vocabulary), "pack-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, capacity)
    schema = "length long, first_rank long, ranks long, first_sequence long, sequences long, room_at long"
    runs = spark.createDataFrame(plan, schema)
    ranked = rank_within(pieces, ["length"], [F.col("id"), F.col("piece"), F.col("ids_crc32")])
    # A run is found by its index within its length: the running list of first ranks is one small array per length.
    starts = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "ranks", "first_sequence", "sequences", "room_at"))).alias("runs"))
    placed = ranked.join(F.broadcast(starts), "length")  # at most `capacity` rows
    low = F.size(F.filter("runs", lambda r: r["first_rank"] <= F.col("rank")))
    placed = placed.withColumn("run", F.element_at("runs", low)).withColumn("in_run", F.col("rank") - F.col("run.first_rank"))
    sequence = F.col("run.first_sequence") + F.pmod(F.col("in_run"), F.col("run.sequences"))
    offset = F.col("run.room_at") + F.expr("in_run div run.sequences") * F.col("length")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
