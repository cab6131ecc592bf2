"""Near-duplicate detection by BagMinHash signatures, banding and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize, member_test, spread_join, text_of
from .components import connected_components
from .shingles import _GOLD, mix, multisets, shingle_hashes

#: Two texts of overlap 0.8 share no band with probability (1 - 0.8 ** 5) ** 26 = 3e-5.
BANDS, ROWS = 26, 5
#: The time of a position that no point fell on.
NEVER = np.int64(2**63 - 1)


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (texts x m) of multisets given as rows of text, element hash, integer weight.

    Every element owns Poisson processes over time x weight x position, one per dyadic range of weights
    [0,1), [1,2), [2,4), ..., of rate m times the range's width. A point counts if its weight lies below
    the element's; ranges that straddle it thin their points down the hierarchy by a uniform draw. The
    earliest time at each position then agrees between two multisets with probability sum(min) / sum(max).
    A process stops once its time passes the latest entry of its text's signature: later points change nothing.
    Times are whole numbers of 2 ** -44, so that sums don't depend on how points are drawn in blocks, and thus
    not on the texts beside this one; positions of a text without elements hold NEVER."""
    own, key, low, width, top = [], [], [], [], []
    level, at = 0, np.arange(len(text))
    while len(at):
        lower = 0 if level == 0 else 1 << (level - 1)
        own.append(text[at])
        key.append(mix(element[at] + np.uint64(int(_GOLD) * (2 * level + 1) % (1 << 64))))
        low.append(np.full(len(at), float(lower)))
        width.append(np.full(len(at), float(max(lower, 1))))
        top.append(weight[at].astype(float))
        level += 1
        at = at[weight[at] > (1 << (level - 1))]
    signature = np.full(texts * m, NEVER)
    if not own:
        return signature.reshape(texts, m)
    own, key, low, width, top = map(np.concatenate, (own, key, low, width, top))
    time, drawn, latest = np.zeros(len(own), dtype=np.int64), 0, np.full(texts, NEVER)
    step = np.uint64(0xD1342543DE82EF95)
    while len(own):
        block = int(np.clip((1 << 17) // len(own), 1, 32))
        h = mix(key[:, None] + step * np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64)[None, :])
        gaps = (-np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * (2.0**44 / m) / width[:, None]).astype(np.int64)
        times = time[:, None] + np.cumsum(gaps, axis=1)
        other = mix(h ^ step)
        place = (other >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        good = times < latest[own][:, None]
        wide = np.flatnonzero(low + width > top)
        if len(wide):
            cell = low[wide, None] + np.floor((other[wide] & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[wide, None])
            good[wide] &= cell < top[wide, None]
        spot = own[:, None] * m + place.astype(np.int64)
        np.minimum.at(signature, spot[good], times[good])
        latest = signature.reshape(texts, m).max(axis=1)
        time, drawn = times[:, -1], drawn + block
        live = time < latest[own]
        own, key, low, width, top, time = own[live], key[live], low[live], width[live], top[live], time[live]
    return signature.reshape(texts, m)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        keys = mix(keys * _GOLD ^ bits[:, :, j])
    return keys.view(np.int64)


def _chunks(texts: list[bytes], size: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for b, text in enumerate(texts):
        if b > a and (held + len(text) > size or b - a >= rows):
            yield a, b
            a, held = b, 0
        held += len(text)
    if len(texts) > a:
        yield a, len(texts)


def _read(column: pa.Array, rows: int = 1024) -> Iterator[tuple[int, int, list[bytes]]]:
    """Texts of a batch's column by chunks, from a up to b; no more than `rows` of them are taken out of the batch at a time."""
    for at in range(0, len(column), rows):
        texts = column.slice(at, rows).to_pylist()
        for a, b in _chunks(texts, rows=rows):
            yield at + a, at + b, texts[a:b]


def fingerprint(text_col: str) -> Column:
    """128 bits of the SHA-256 of a text (null: empty): what stands for the text in slim tables."""
    return F.unhex(F.substring(F.sha2(text_of(text_col), 256), 1, 32))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, rep (fingerprint of the text), words, bands (empty without words)."""
    schema = pa.schema([("id", pa.int64()), ("rep", pa.binary()), ("words", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _read(batch.column(2)):
                text, hashes, words = _shingled(part, k)
                keys = band_keys(bag_minhash(*multisets(text, hashes), len(part)))
                has = words > 0
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(has, keys.shape[1], 0))]).astype(np.int32), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words), lists], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), fingerprint(text_col).alias("rep"), F.encode(text_of(text_col), "UTF-8").alias("content"))
    return texts.mapInArrow(run, "id long, rep binary, words long, bands array<long>")


def _shingled(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return shingle_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, k)


class Overlaps:
    """Exact multiset overlaps of one text of a block with all of them, each in one sweep over the block's shingles."""

    def __init__(self, texts: list[bytes], k: int) -> None:
        text, hashes, _ = _shingled(texts, k)
        text, hashes, self.times = multisets(text, hashes)
        order = np.argsort(text, kind="stable")
        self.text, self.times = text[order], self.times[order]
        self.of = np.searchsorted(self.text, np.arange(len(texts) + 1))
        names, self.ids = np.unique(hashes[order], return_inverse=True)
        self.weight = np.bincount(self.text, weights=self.times, minlength=len(texts))
        self.mark = np.zeros(len(names))

    def centre(self) -> int:
        """The text whose shingles are the commonest in the block."""
        spread = np.bincount(self.ids, minlength=len(self.mark))
        return int(np.argmax(np.bincount(self.text, weights=spread[self.ids] * self.times, minlength=len(self.weight)) / np.maximum(self.weight, 1)))

    def with_all(self, u: int) -> np.ndarray:
        own = slice(self.of[u], self.of[u + 1])
        self.mark[self.ids[own]] = self.times[own]
        both = np.bincount(self.text, weights=np.minimum(self.mark[self.ids], self.times), minlength=len(self.weight))
        self.mark[self.ids[own]] = 0
        return both / np.maximum(self.weight + self.weight[u] - both, 1)


def _links(k: int, least: float):
    """rows: rep, content, cls (null: a class of its own). Links u, v, overlap that connect a block as all its links would.

    From the text at its centre on, members outside the largest class meet all others; two members of
    one class need no test. So every pair that ends in different classes has been compared exactly."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        reps, found = rows["rep"].to_numpy(), []
        if len(reps) > 1:
            near, met = Overlaps(list(rows["content"]), k), np.zeros(len(reps), dtype=bool)
            label = pd.factorize(rows["cls"].where(rows["cls"].notna(), rows["rep"]))[0]
            u = near.centre()
            while True:
                met[u] = True
                overlap = near.with_all(u)
                for v in np.flatnonzero(overlap >= least):
                    if label[v] != label[u]:
                        found.append((reps[u], reps[v], overlap[v]))
                        label[label == label[v]] = label[u]
                open_ = np.flatnonzero(~met & (label != np.bincount(label).argmax()))
                if not len(open_):
                    break
                u = open_[0]
        return pd.DataFrame(found, columns=["u", "v", "overlap"])

    return run


_LINK = "u binary, v binary, overlap double"
#: Counters of the shingle frequencies that order a prefix: their number bounds what the driver gathers and sends.
COUNTERS = 1 << 18


def tokens_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, token): the multiset of shingles as a set, the i-th occurrence of a shingle being a token of its own."""
    text, hashes, _ = _shingled(texts, k)
    text, hashes, times = multisets(text, hashes)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(text, times), mix(np.repeat(hashes, times) + nth.astype(np.uint64) * _GOLD)


def prefixes(texts: list[bytes], k: int, least: float, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, short): of n tokens of a text the n - ceil(least * n) + 1 that come first by (count, token).

    short marks the first n - ceil(2 * least / (1 + least) * n) + 1 of them. Two texts of overlap `least` or more share at least
    least / (1 + least) of the tokens of both together, which is no less than that share of twice the smaller text, and than
    `least` of the larger one: so a token of the larger text's prefix is in the smaller one's short prefix."""
    text, token = tokens_of(texts, k)
    order = np.lexsort((token, counts[(token % np.uint64(len(counts))).astype(np.int64)], text))
    text, token = text[order], token[order]
    n = np.bincount(text, minlength=len(texts))
    rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    upto = lambda share: (n - np.ceil(share * n - 1e-9) + 1)[text]
    first = rank < upto(least)
    return text[first], token[first], (rank < upto(2 * least / (1 + least)))[first]


def _count_tokens(texts: DataFrame, k: int) -> np.ndarray:
    """How often tokens fall on each of COUNTERS counters: sums in the task, then one small aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, _, part in _read(batch.column(0)):
                counts += np.bincount((tokens_of(part, k)[1] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["at", "n"])

    sums = texts.select("content").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return counts


def _prefix_links(open_: DataFrame, texts: DataFrame, k: int, least: float, block: int, block_words: int) -> DataFrame:
    """open_: rep, cls, words. All links between texts of different classes that connect them as all would.

    Texts are grouped by the tokens of their prefixes, the rarest first; of groups with the same members one
    remains, and none in which all have one class or no text holds the token in its short prefix. A group that outgrows a
    block meets in cells of a block of those texts and a block of all. A template that many texts share is in the short
    prefixes only of those of which it makes up some eight ninths, and these are alike: so texts that a template
    brings together without being alike don't meet by it."""
    held = materialize(open_.join(texts.hint("merge"), "rep").select("rep", "cls", "words", "content"), "near-open")
    counts = held.sparkSession.sparkContext.broadcast(_count_tokens(held, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _read(batch.column(3)):
                text, token, short = prefixes(part, k, least, counts.value)
                rows = batch.slice(a, b - a).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(token.view(np.int64)), pa.array(short)], names=["rep", "cls", "words", "token", "short"])

    rows = materialize(held.mapInArrow(run, "rep binary, cls binary, words long, token long, short boolean"), "near-prefixes")
    hash_, short = F.xxhash64("rep"), F.col("short")
    sets = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"), F.min("rep").alias("low"), F.bit_xor(hash_).alias("who"), F.count_if(short).alias("few"), F.coalesce(F.sum(F.when(short, F.col("words"))), F.lit(0)).alias("few_w"), F.coalesce(F.bit_xor(F.when(short, hash_)), F.lit(0)).alias("few_who"), (F.min("cls") != F.max("cls")).alias("mixed"))
    groups = sets.where("n > 1 AND mixed AND few > 0").groupBy("n", "w", "low", "who", "few", "few_w", "few_who").agg(F.min("token").alias("token"))
    few_blocks = F.ceil(F.greatest(F.col("few") / F.lit(block), F.col("few_w") / F.lit(block_words))).cast("int")
    groups = materialize(groups.select("token", F.col("n").alias("_n"), _blocks(block, block_words), few_blocks.alias("few_blocks")), "near-groups")
    cells = spread_join(rows, groups.drop("_n"), ["token"], ["rep"], sizes=groups.select("token", "_n"))
    at = lambda n: F.pmod(F.xxhash64("token", "rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A short one lies in a row of cells, every text in a column; where both are one cell it is there once.
    across = F.when(F.col("short"), F.transform(every("blocks"), lambda j: F.struct(at("few_blocks").alias("i"), j.alias("j"))))
    down = F.transform(every("few_blocks"), lambda i: F.struct(i.alias("i"), at("blocks").alias("j")))
    places = F.array_distinct(F.concat(down, F.coalesce(across, F.array().cast("array<struct<i:int,j:int>>"))))
    cells = cells.select("rep", "cls", "token", F.inline(places))
    return cells.join(held.select("rep", "content").hint("merge"), "rep").groupBy("token", "i", "j").applyInPandas(_links(k, least), _LINK)


def _blocks(block: int, block_words: int) -> Column:
    return F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("w") / F.lit(block_words))).cast("int").alias("blocks")


def _solve(docs: DataFrame, id_col: str, text_col: str, k: int, least: float, block: int, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: id, rep; texts: rep, low, rows, component; links: u, v, overlap). rep stands for a text, low is its smallest id."""
    ship(docs.sparkSession)
    sig = materialize(signatures(docs, id_col, text_col, k), "near-signatures")
    reps = materialize(sig.groupBy("rep").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"), F.first("words").alias("words"), F.first("bands").alias("bands")), "near-texts")
    # Sets of ids grow with the corpus: these joins are never to be broadcast, whatever a size at hand.
    banded = reps.select("rep", "words", F.explode("bands").alias("key"))
    sets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("n > 1")
    buckets = materialize(sets.groupBy("n", "w", "low", "who").agg(F.min("key").alias("key")).select("key", F.col("n").alias("_n"), _blocks(block, block_words)), "near-buckets")
    members = spread_join(banded, buckets.drop("_n"), ["key"], ["rep"], sizes=buckets.select("key", "_n"))
    members = materialize(members.select("key", "rep", "words", "blocks", F.pmod(F.xxhash64("key", "rep"), F.col("blocks")).cast("int").alias("own")), "near-members")
    contents = docs.select(fingerprint(text_col).alias("rep"), F.encode(text_of(text_col), "UTF-8").alias("content"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """rep, content of the texts that are wanted (and of a few others), so that the rest isn't exchanged.

        One content a text: copies fold in the map-side part, and joins by rep need no further exchange."""
        test = member_test(wanted, "rep")
        return contents.where(test(F.col("rep"))).groupBy("rep").agg(F.first("content").alias("content"))

    texts = texts_of(materialize(members.select("rep").distinct(), "near-wanted"))
    compared = members.select("key", "own", "rep", F.lit(None).cast("binary").alias("cls")).join(texts.hint("merge"), "rep")
    links = materialize(compared.groupBy("key", "own").applyInPandas(_links(k, least), _LINK), "near-links")
    labels = connected_components(links)
    large = members.where("blocks > 1")
    if not large.isEmpty():
        large = materialize(large.join(labels.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").select("key", "rep", "words", F.coalesce("component", "rep").alias("cls")), "near-large")
        split = large.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count(F.lit(1)).alias("_n")).where("a <> b").select("key", "_n")
        open_ = materialize(spread_join(large, split.select("key"), ["key"], ["rep"], sizes=split).select("rep", "cls", "words").distinct(), "near-doubt")
        if not open_.isEmpty():
            links = materialize(links.unionByName(_prefix_links(open_, texts_of(open_.select("rep")), k, least, block, block_words)), "near-links")
            labels = connected_components(links)
    out = reps.select("rep", "low", "rows").join(labels.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    return sig.select("id", "rep"), materialize(out.select("rep", "low", "rows", F.coalesce("component", "rep").alias("component")), "near-classes"), links


def _classes(texts: DataFrame) -> DataFrame:
    """component, class_id (smallest id), class_size (rows), stands (the text that has that id)."""
    first = F.min_by("rep", F.struct(F.col("low").isNull(), "low", "rep"))
    return texts.groupBy("component").agg(F.min("low").alias("class_id"), F.sum("rows").alias("class_size"), first.alias("stands"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, block: int = 250, block_words: int = 1 << 18) -> DataFrame:
    """One row per input row: id, text_rep (smallest id with the same text), class_id, class_size (rows), kept.

    Two texts are linked if the multisets of their k-word shingles overlap by `least` or more; classes are
    the connected components of the links and of equal texts, named by their smallest id, which is kept. So a
    text may be less than `least` alike to the one that is kept for it, by a chain of links.
    Null texts equal the empty one; texts without words are linked to equal texts only. Rows are told by
    their texts, so ids may repeat or be null; a class in which no row has an id has a null class_id, and
    its own class_size. Extra columns are ignored, an empty table gives an empty result.

    Equal texts fold first. Texts that share a band are a bucket; of buckets with the same members one
    remains. Buckets are dealt into blocks of bounded rows and words, and a task compares a block's texts
    exactly, from the text at its centre on, without emitting pairs: only links that join classes leave it. A
    hot bucket thus costs its blocks, not their pairs; its blocks meet through the other bands, in which
    they are dealt otherwise. Members of buckets of several blocks that still hold several classes then
    meet by their rarest shingles (_prefix_links), which misses no pair. So no link between classes is left out."""
    rows, texts, _ = _solve(docs, id_col, text_col, k, least, block, block_words)
    # Each of the three is a table at hand; classes and texts may be hot.
    named = spread_join(texts, _classes(texts).drop("stands"), ["component"], ["rep"])
    named = materialize(named.select("rep", F.col("low").alias("text_rep"), "class_id", "class_size"), "near-named")
    sizes = texts.select("rep", F.col("rows").alias("_n"))
    return spread_join(rows, named, ["rep"], ["id"], sizes=sizes).select(F.col("id").alias(id_col), "text_rep", "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, block: int = 250, block_words: int = 1 << 18) -> DataFrame:
    """u, v (smallest ids of two texts), overlap: the exact links that connect the classes of near_duplicates.

    Pairs that add nothing to a class aren't among them; a text without any id shows as null."""
    _, texts, links = _solve(docs, id_col, text_col, k, least, block, block_words)
    at = lambda c: texts.select(F.col("rep").alias(c), F.col("low").alias(f"{c}_id"))
    out = links.join(at("u").hint("merge"), "u").join(at("v").hint("merge"), "v")
    return out.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"), "overlap")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, block: int = 250, block_words: int = 1 << 18) -> DataFrame:
    """The rows of docs that stand for their class, all columns: exactly one for each class.

    That is the row with the class's smallest id; in a class without ids, one of its smallest text. Of
    repeated rows a single one stays, the first by a hash of its columns. An empty table gives an empty one."""
    _, texts, _ = _solve(docs, id_col, text_col, k, least, block, block_words)
    stands = _classes(texts).select(F.col("stands").alias("__quaywave_rep"))
    names = docs.columns
    plain = [F.col(f.name) for f in docs.schema if "map" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*names), F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.xxhash64(*plain)))
    rows = docs.groupBy(fingerprint(text_col).alias("__quaywave_rep")).agg(first.alias("__quaywave_row"))
    return rows.join(stands.hint("merge"), "__quaywave_rep", "left_semi").select("__quaywave_row.*")
