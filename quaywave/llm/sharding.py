"""Sharding by vector bin packing over bytes, words and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rank_within, spread_join, text_of, word_count


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit, heaviest first: among shards with room in every dimension, or else in bytes
    (column 0), the one whose residual capacity has the largest dot product with the unit's vector.

    Capacities are the even shares; vectors are in units of those. Ties go to the lowest shard."""
    whole = vectors.sum(0)
    loads = vectors / np.where(whole > 0, whole / shards, 1.0)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -loads[:, 0])):
        fits = np.flatnonzero((residual >= loads[i] - 1e-12).all(1))
        if not len(fits):
            fits = np.flatnonzero(residual[:, 0] >= residual[:, 0].max() - 1e-12)
        scores = residual[fits] @ loads[i]
        out[i] = fits[np.argmax(scores)]
        residual[out[i]] -= loads[i]
    return out


def even_out(vectors: np.ndarray, owner: np.ndarray, shards: int, rounds: int = 2000) -> np.ndarray:
    """Moves units from the shard with most bytes to the one with least while that narrows the two."""
    owner, size = owner.copy(), vectors[:, 0]
    load = np.bincount(owner, weights=size, minlength=shards)
    for _ in range(rounds):
        high, low = int(np.argmax(load)), int(np.argmin(load))
        gap = load[high] - load[low]
        mine = np.flatnonzero((owner == high) & (size > 0) & (size < gap))
        if not len(mine):
            break
        i = mine[np.argmin(np.abs(size[mine] - gap / 2))]
        owner[i] = low
        load[high] -= size[i]
        load[low] += size[i]
    return owner


def size_class(bytes_: Column, words: Column, rows: Column) -> Column:
    """A name for groups of about the same bytes (eight steps an octave), words a byte and rows a byte (two steps an octave).

    So there are some thousands of classes, whatever the number of groups: their number grows with the
    logarithms of what the largest and the smallest group hold."""
    step = lambda x, n: F.round(F.log2(x) * n).cast("int")
    return F.concat_ws(".", step(bytes_, 8), step((words + 1) / bytes_, 2), step(rows / bytes_, 2))


def plan_shards(single: list[tuple], classes: list[tuple], shards: int, fine: int = 128) -> tuple[list[int], list[tuple[str, int, list[int]]]]:
    """single: (.., bytes, words, rows) of groups placed for themselves. classes: (name, groups, bytes, words, rows).

    Returns the shard of each single group; and of each class (name, groups a turn, the shard of each turn): its
    groups take turns, each a vector of the class's mean group times their number, which is at most 1 / fine of a shard's
    share in every dimension, or one group. So there are at most 3 * fine * shards turns beside one a class, however
    many groups; all turns and single groups are placed together."""
    vectors = [np.array([float(x) for x in one[-3:]]) for one in single]
    whole = sum(vectors, np.zeros(3)) + sum((np.array([float(x) for x in c[2:]]) for c in classes), np.zeros(3))
    share = np.where(whole > 0, whole / shards, np.inf)
    turns = []
    for name, groups, *held in classes:
        mean = np.array([float(x) for x in held]) / groups
        each = max(1, int(1 / (fine * (mean / share).max())))
        sizes = [each] * (groups // each) + ([groups % each] if groups % each else [])
        turns.append((name, each, len(sizes)))
        vectors += [mean * n for n in sizes]
    if not vectors:
        return [], []
    stacked = np.stack(vectors)
    owner = even_out(stacked, place(stacked, shards), shards).tolist()
    out, at = [], len(single)
    for name, each, n in turns:
        out.append((name, each, owner[at : at + n]))
        at += n
    return owner[: len(single)], out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, heavy: float = 1 / 64) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 8), text_crc32, shard, slot.

    Equal texts are a group and share a shard. Every group is placed where the dot product of its vector (bytes,
    words, rows) with the residual capacity is highest: a group over `heavy` of a shard's share by its own
    vector (there are at most shards / heavy of those), the others by that of their class of about equal vectors, whose
    groups take turns by their rank within the class. Only a group over a whole share is split, into parts of a
    sixteenth by the hash of the id: no shard could hold it.
    slot counts a shard's rows from 0, without gaps, in counted parts. Null texts are empty; repeated rows are
    sharded as often as they occur; ties in the packing go to the lowest shard. Extra columns are ignored, an
    empty table gives an empty result."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            word_count(text).alias("words"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("group"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    share = max(1.0, total / shards)
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")]
    groups = materialize(rows.groupBy("group").agg(*sums), "shard-groups")
    own = F.col("bytes") > share * heavy
    parts = F.when(F.col("bytes") > share, F.ceil(F.col("bytes") * 16 / F.lit(share))).otherwise(1).cast("int")
    big = materialize(groups.where(own).select("group", parts.alias("parts")), "shard-heavy")
    # At most shards / heavy groups can exceed total / shards * heavy bytes: small enough to send to every task.
    part = F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.col("parts")).cast("int")
    few = rows.join(F.broadcast(big), "group").withColumn("part", part)
    single = sorted(tuple(r) for r in few.groupBy("group", "part").agg(*sums).collect())
    light = groups.where(~own).select("group", "n", size_class(F.col("bytes"), F.col("words"), F.col("n")).alias("class"), "bytes", "words")
    light = materialize(light, "shard-light")
    classes = light.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.sum("n").alias("n"))
    owner, turns = plan_shards(single, sorted(tuple(r) for r in classes.collect()), shards)

    heavy_at = spark.createDataFrame([(*one[:2], to) for one, to in zip(single, owner)], "group long, part int, shard int")
    turn_at = spark.createDataFrame(turns, "class string, each int, owners array<int>")  # a row a class
    ranked = rank_within(light, ["class"], [F.col("group")]).join(F.broadcast(turn_at), "class")
    at = ranked.select("group", F.get("owners", F.expr("cast(rank div each as int)")).alias("shard"))
    rest = rows.join(F.broadcast(big.select("group")), "group", "left_anti")
    names = ["id", "size", "text_crc32", "shard"]
    # An empty text weighs little, yet may be a third of all rows: such a key is dealt.
    dealt = spread_join(rest, at, ["group"], ["id"], sizes=light.select("group", F.col("n").alias("_n"))).select(*names)
    dealt = materialize(dealt.unionByName(few.join(F.broadcast(heavy_at), ["group", "part"]).select(*names)), "shard-dealt")
    ranked = rank_within(dealt, ["shard"], [F.col("id"), F.col("text_crc32"), F.col("size")], name="slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
