"""Alignment of two tokenizers over the same bytes by byte-owner arrays, with corpus-wide counts of linked ids."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize, text_of

#: Vocabularies by name for public_tokenizers.path, or as paths: byte-level BPE and sentencepiece. A is byte_bpe_50k.json
#: in tiktoken's form, which encodes several times faster; a test holds the ids of both together on every code point.
A, B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Id pairs that hold more than 1 / HEAD of all links are fewer than HEAD, whatever the corpus: these are broadcast.
HEAD = 1 << 18


def _place(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if "/" in vocabulary else str(public_tokenizers.path(vocabulary))


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokens:
    """One tokenizer: texts to ids, and every id's bytes. Special tokens' strings in a text are plain text."""

    _open: dict[str, Tokens] = {}

    def __init__(self, vocabulary: str) -> None:
        path = _place(vocabulary)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            byte = _byte_level()
            names = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
            self.bytes_of = [bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x in names]
            self.encode: Callable[[list[str]], list[list[int]]] = lambda texts: [e.ids for e in model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            model = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            named = {i: x for x, i in ranks.items()}
            self.bytes_of = [named.get(i, b"") for i in range(max(named) + 1)]

            def encode(text: str) -> list[int]:
                try:
                    return model.encode(" " + text, disallowed_special=())
                except ValueError:  # its pattern gives up on very long white space; `tokenizers` does not
                    return Tokens.of(vocabulary.removesuffix(".tiktoken") + ".json").encode([text])[0]

            self.encode = lambda texts: [encode(t) for t in texts]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            raw = re.compile("<0x([0-9A-Fa-f]{2})>")
            self.bytes_of = [bytes([int(raw.fullmatch(x)[1], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
            self.encode = lambda texts: model.encode(texts, num_threads=1)

    @classmethod
    def of(cls, vocabulary: str) -> Tokens:
        """One a process."""
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary)
        return cls._open[vocabulary]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.bytes_of])

    def whole(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Owners:
    """Alignment of some documents' tokens. a, b: ids one document after another; n_a, n_b: how many each has.

    Both give the same bytes, document by document. Every byte has an owner on either side; where the pair
    of owners changes an overlap begins, where both change at once a group has ended."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> None:
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        own_a, own_b = np.repeat(np.arange(len(a), dtype=np.int32), len_a[a]), np.repeat(np.arange(len(b), dtype=np.int32), len_b[b])
        new_a, new_b = (np.concatenate([[True] * (len(x) > 0), x[1:] != x[:-1]]) for x in (own_a, own_b))
        self.overlap_a, self.overlap_b = (x[new_a | new_b] for x in (own_a, own_b))
        last = np.concatenate([np.flatnonzero(new_a & new_b)[1:] - 1, [len(own_a) - 1] * (len(own_a) > 0)]).astype(np.int64)
        self.end_a, self.end_b = own_a[last], own_b[last]  # the tokens that end a group: a link
        doc = np.repeat(np.arange(len(n_a)), n_a)
        self.n_overlaps = np.bincount(doc[self.overlap_a], minlength=len(n_a))
        self.link_doc = doc[self.end_a]
        self.n_groups = np.bincount(self.link_doc, minlength=len(n_a))

    def spelled(self, names: np.ndarray, size: int) -> list[str]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`. names: every id with ',', '|', ';' and nothing after it."""
        after_a, after_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        after_a[self.end_a], after_b[self.end_b] = 1, 2
        after_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        group_a = np.searchsorted(self.end_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.end_b, np.arange(len(self.b)))
        items = np.empty(len(self.a) + len(self.b), dtype=object)
        items[np.arange(len(self.a)) + np.concatenate([[0], self.end_b + 1])[group_a]] = names[self.a + after_a * size]
        items[np.arange(len(self.b)) + (self.end_a + 1)[group_b]] = names[self.b + after_b * size]
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return ["".join(items[x:y]) for x, y in zip(at[:-1], at[1:])]


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` in all, or of one row."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield start, k
            start, held = k, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, pa.int32()))


_ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, n_overlaps long, groups string, link_a array<int>, link_b array<int>"


def aligned_rows(docs: DataFrame, id_col: str, text_col: str, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """row (any number, distinct), id, n_a, n_b, n_groups, n_overlaps, groups (`a1,a2|b1;a3|b2,b3`), link_a, link_b (the ids linked).

    A text has no tokens if it is empty or a tokenizer changes its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Tokens.of(vocabulary_a), Tokens.of(vocabulary_b)
        size = max(len(one.lengths), len(two.lengths))
        names = np.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(size)], dtype=object)
        for batch in batches:
            for x, y in _parts(pc.binary_length(batch.column(2)).to_numpy(), 1 << 17):
                texts = batch.column(2).slice(x, y - x).to_pylist()
                a, b = one.encode(texts), two.encode(texts)
                for k, text in enumerate(texts):
                    said = b" " + text.encode()
                    if not text or one.whole(a[k]) != said or two.whole(b[k]) != said:
                        a[k], b[k] = [], []
                flat_a, n_a = _flat(a)
                flat_b, n_b = _flat(b)
                own = Owners(flat_a, flat_b, n_a, n_b, one.lengths, two.lengths)
                columns = [batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), *(pa.array(n) for n in (n_a, n_b, own.n_groups, own.n_overlaps))]
                columns += [pa.array(own.spelled(names, size), pa.string()), _lists(flat_a[own.end_a], own.n_groups), _lists(flat_b[own.end_b], own.n_groups)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ALIGNED.split(", ")])

    ship(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, _ALIGNED)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows of a batch at a time, the links of each, and the id pair of every link as one number."""
    for batch in batches:
        sizes = np.asarray(batch.column("link_a").value_lengths()).astype(np.int64)
        for x, y in _parts(sizes, 1 << 18):
            part = batch.slice(x, y - x)
            a, b = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("link_a", "link_b"))
            yield part, sizes[x:y], a << 32 | b


def count_pairs(rows: DataFrame) -> DataFrame:
    """a, b, count (links that hold the pair), best (whether no id of A has more links with this b). Counted in each batch, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, found in _linked(batches):
            keys, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "count"])

    sums = rows.select("link_a", "link_b").mapInArrow(count, "a int, b int, count long").groupBy("a", "b").agg(F.sum("count").alias("count"))
    sums = materialize(sums, "align-counts")
    most = F.broadcast(sums.groupBy("b").agg(F.max("count").alias("most")))  # at most B's vocabulary
    return sums.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_scores(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, n_links, n_best (links whose pair is best for its b), count_sum (of their counts).

    The commonest pairs, fewer than HEAD, are looked up where the rows lie. Only links of the others are
    exchanged, one row a document and pair; none of these pairs holds over 1 / HEAD of all links, so none is hot."""
    total = pairs.agg(F.sum("count")).first()[0] or 0
    head = pairs.where(F.col("count") > F.lit(total // HEAD)).select("a", "b", "count", "best").toArrow()
    keys = head.column("a").to_numpy().astype(np.int64) << 32 | head.column("b").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    # A last key that no link has spares the look-up its ends.
    known = rows.sparkSession.sparkContext.broadcast((np.append(keys[order], np.int64(2**63 - 1)), *(np.append(head.column(c).to_numpy()[order].astype(np.int64), 0) for c in ("count", "best"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = known.value
        for batch, sizes, found in _linked(batches):
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(keys, found)
            rare = np.flatnonzero(keys[at] != found)
            at[rare] = len(keys) - 1
            before = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[before]) for x in (best, count)]
            each = np.bincount(doc[rare], minlength=len(sizes))
            out = [batch.column("row"), pa.array(sizes), *map(pa.array, sums), _lists(found[rare] >> 32, each), _lists(found[rare] & 0xFFFFFFFF, each)]
            yield pa.RecordBatch.from_arrays(out, names=["row", "n_links", "n_best", "count_sum", "rare_a", "rare_b"])

    slim = rows.select("row", "link_a", "link_b").mapInArrow(score, "row long, n_links long, n_best long, count_sum long, rare_a array<int>, rare_b array<int>")
    slim = materialize(slim, "align-scores")
    rare = slim.where(F.size("rare_a") > 0).select("row", F.explode(F.arrays_zip("rare_a", "rare_b")).alias("x")).groupBy("row", F.col("x.rare_a").alias("a"), F.col("x.rare_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rare = rare.join(pairs.hint("merge"), ["a", "b"]).select("row", F.lit(0).cast("long").alias("n_links"), F.when(F.col("best"), F.col("n")).otherwise(0).cast("long").alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    return slim.select(*rare.columns).unionByName(rare).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = A, vocabulary_b: str = B, keep: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Aligns every text's tokens by a byte-level tokenizer (of space + text) and a sentencepiece one (which adds the space).

    Returns (documents, pairs). documents: id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, and `keep`:
    columns made of the alignment itself, by default groups, spelled `a1,a2|b1;a3|b2,b3`. pairs: a, b, count, best.
    Groups end where tokens of both end at one byte; the two tokens that do are linked; a pair's count says how
    many links of the corpus hold it.
    Null and empty texts, and those whose bytes a tokenizer changes (a literal U+2581, say), have no tokens
    and all zeros. Every row is aligned for itself, so ids may repeat or be null, and copies count as often as
    they occur. Other columns are ignored; an empty table gives empty tables. A text is aligned whole."""
    keep = {"groups": F.col("groups")} if keep is None else keep
    rows = aligned_rows(docs, id_col, text_col, vocabulary_a, vocabulary_b)
    names = ["n_a", "n_b", "n_groups", "n_overlaps"]
    rows = materialize(rows.select("row", "id", *names, *(c.alias(n) for n, c in keep.items()), "link_a", "link_b"), "align-rows")
    pairs = materialize(count_pairs(rows), "align-pairs")
    out = rows.drop("link_a", "link_b").join(link_scores(rows, pairs).hint("merge"), "row")
    return out.select(F.col("id").alias(id_col), *names, "n_links", "n_best", "count_sum", *keep), pairs
