"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A token's input joins an embedding of the word with the mean of embeddings of its character n-grams (both
hashed). The network reads windows of words; every text is covered whole by overlapping windows, and its
score is that of its most toxic window."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize, text_of

_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and of its training; sample and sample_words bound the documents that training sees, each of them whole."""

    window: int = 48
    stride: int = 36
    words: int = 1 << 14
    grams: int = 1 << 15
    word_dim: int = 8
    char_dim: int = 16
    hidden: int = 12
    attend: int = 12
    sample: int = 2000  # documents of each label
    sample_words: int = 1 << 23  # and words of all of them together: documents past that are left out of training, whole
    early: float = 0.5  # share of the windows that each of the first two epochs draws
    early_most: int = 12  # about so many of one document: a long one shall not outweigh the others
    epochs: int = 7
    batch: int = 512
    rate: float = 0.01
    seed: int = 7


def tokens(text: str, most: int = 60) -> list[str]:
    """Runs of letters and digits; of a longer run, pieces of `most` characters that overlap by half, so no middle is lost."""
    out = []
    for run in _TOKEN.findall(text.lower()):
        if len(run) <= most:
            out.append(run)
        else:
            starts = range(0, len(run) - most, most // 2)
            out += [run[a : a + most] for a in (*starts, len(run) - most)]
    return out


def windows_of(n: int, shape: Shape) -> list[int]:
    """Starts of the windows over n tokens: every `stride`, and one that ends with the text; one if n is small."""
    if n <= shape.window:
        return [0]
    starts = list(range(0, n - shape.window, shape.stride))
    return [*starts, n - shape.window]


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def hashed(kinds: list[str], shape: Shape, block: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its bucket, the buckets of its character n-grams (3 and 4, its ends marked), how many those are.

    Words are hashed `block` at a time: what that takes on its way is many times what it gives."""
    parts = [_hashed(kinds[a : a + block], shape) for a in range(0, len(kinds), block)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _hashed(kinds: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [f"<{k}>" for k in kinds]
    code = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(r) for r in raw])
    last = np.repeat(np.cumsum(sizes), sizes)
    at, owners, found = np.arange(len(code)), [], []
    owner = np.repeat(np.arange(len(raw)), sizes)
    h = code * _GOLD
    for n in range(2, 5):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :] * _GOLD if len(h) > 1 else h[:0]
        if n > 2:
            good = at[: len(h)] + n <= last[: len(h)]
            owners.append(owner[: len(h)][good])
            found.append((h[good] >> np.uint64(20)) % np.uint64(shape.grams))
    order = np.argsort(np.concatenate(owners), kind="stable")
    words = np.array([zlib.crc32(k.encode("utf-8", "surrogatepass")) % shape.words for k in kinds], dtype=np.int64)
    return words, np.concatenate(found)[order].astype(np.int32), np.bincount(np.concatenate(owners), minlength=len(raw))


def sum_by(spots: np.ndarray, values: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct spots and the sums of their rows of values: one each in turn, or those numbered in `rows`."""
    order = np.argsort(spots, kind="stable")
    ordered = spots[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order if rows is None else rows[order]], first, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.tanh(x * np.float32(0.5))
    y *= np.float32(0.5)
    y += np.float32(0.5)
    return y


@dataclass
class Network:
    """Parameters: E (words), C (character n-grams), and for both directions W (2,d,3h), b, U (2,h,3h); attention A, a, v; out o, c."""

    shape: Shape
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, shape: Shape) -> Network:
        rng, d, h = np.random.default_rng(shape.seed), shape.word_dim + shape.char_dim, shape.hidden
        draw = lambda *size, scale: rng.normal(0, scale, size).astype(np.float32)
        p = {
            "E": draw(shape.words, shape.word_dim, scale=0.1), "C": draw(shape.grams, shape.char_dim, scale=0.3),
            "W": draw(2, d, 3 * h, scale=d**-0.5), "b": np.zeros((2, 1, 3 * h), np.float32), "U": draw(2, h, 3 * h, scale=h**-0.5),
            "A": draw(2 * h, shape.attend, scale=(2 * h) ** -0.5), "a": np.zeros(shape.attend, np.float32), "v": draw(shape.attend, scale=0.5),
            "o": draw(2 * h, scale=0.3), "c": np.zeros(1, np.float32),
        }
        return cls(shape, p)

    def inputs(self, word: np.ndarray, gram: np.ndarray, sizes: np.ndarray, block: int = 1 << 12) -> np.ndarray:
        """The n-grams' rows are gathered for `block` words at a time."""
        out, last = np.empty((len(word), self.shape.word_dim + self.shape.char_dim), np.float32), np.cumsum(sizes)
        out[:, : self.shape.word_dim] = self.p["E"][word]
        for a in range(0, len(word), block):
            n = sizes[a : a + block]
            start, end = last[a] - sizes[a], last[a + len(n) - 1]
            sums = np.add.reduceat(self.p["C"][gram[start:end]], last[a : a + block] - n - start, axis=0)
            out[a : a + block, self.shape.word_dim :] = sums / n[:, None].astype(np.float32) ** 0.5
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The inputs' part of both directions' gates, and last the row for padding, which keeps the state."""
        g = np.einsum("nd,kdg->kng", x, self.p["W"], optimize=True) + self.p["b"]
        pad = np.zeros((2, 1, g.shape[2]), np.float32)
        pad[:, :, : self.shape.hidden] = 40
        return np.concatenate([g, pad], axis=1)

    def gates_of(self, word: np.ndarray, gram: np.ndarray, sizes: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """gates(inputs(..)) of a whole lexicon, in blocks that bound what the n-grams' rows take."""
        ends, out = np.cumsum(sizes), np.empty((2, len(word) + 1, 3 * self.shape.hidden), np.float32)
        for a in range(0, len(word), block):
            b = min(a + block, len(word))
            out[:, a : b + 1] = self.gates(self.inputs(word[a:b], gram[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b]))  # the next block covers the row for padding
        return out

    def states(self, gates: np.ndarray, index: np.ndarray, trail: list | None = None) -> np.ndarray:
        """index: windows x words into the gates, -1 for padding. Returns states (words, windows, 2h)."""
        h, n, t = self.shape.hidden, *index.shape
        state, out = np.zeros((2, n, h), np.float32), np.empty((t, n, 2 * h), np.float32)
        order = np.stack([np.arange(t), np.arange(t)[::-1]], axis=1)
        for i, j in order:
            g = np.stack([gates[0][index[:, i]], gates[1][index[:, j]]])
            u = state @ self.p["U"]
            zr = sigmoid(g[..., : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(g[..., 2 * h :] + r * u[..., 2 * h :])
            if trail is not None:
                trail.append((state, z, r, new, u[..., 2 * h :]))
            state = new + z * (state - new)
            out[i, :, :h], out[j, :, h:] = state[0], state[1]
        return out

    def attention(self, out: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        u = np.tanh(out @ self.p["A"] + self.p["a"])
        e = u @ self.p["v"] + np.where(index.T < 0, np.float32(-1e9), np.float32(0))
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", alpha, out, optimize=True)
        return u, alpha, pooled, pooled @ self.p["o"] + self.p["c"][0]

    def logits(self, gates: np.ndarray, index: np.ndarray, rows: int = 512) -> np.ndarray:
        parts = [index[a : a + rows] for a in range(0, len(index), rows)]
        return np.concatenate([self.attention(self.states(gates, part), part)[3] for part in parts]) if parts else np.zeros(0, np.float32)

    def gradients(self, x: np.ndarray, index: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy; the second result is for the inputs x."""
        h, (n, t), p = self.shape.hidden, index.shape, self.p
        gates, trail = self.gates(x), []
        out = self.states(gates, index, trail)
        u, alpha, pooled, logit = self.attention(out, index)
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        grad = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["o"]
        d_alpha = np.einsum("nk,tnk->tn", d_pooled, out, optimize=True)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
        grad["v"] = np.einsum("tn,tna->a", d_e, u, optimize=True)
        grad["A"], grad["a"] = np.einsum("tnk,tna->ka", out, d_u, optimize=True), d_u.sum(axis=(0, 1))
        d_out = alpha[:, :, None] * d_pooled + d_u @ p["A"].T
        d_gates, d_U = np.zeros_like(gates), np.zeros_like(p["U"])
        d_state = np.zeros((2, n, h), np.float32)
        flat = [np.zeros((t, n, 3 * h), np.float32) for _ in range(2)]
        for s in range(t - 1, -1, -1):
            i, j = s, t - 1 - s
            state, z, r, new, un = trail[s]
            d_state[0] += d_out[i, :, :h]
            d_state[1] += d_out[j, :, h:]
            d_new = d_state * (1 - z) * (1 - new * new)
            d_z = d_state * (state - new) * z * (1 - z)
            d_r = d_new * un * r * (1 - r)
            full = np.concatenate([d_z, d_r, d_new * r], axis=2)
            d_U += state.transpose(0, 2, 1) @ full
            d_state = d_state * z + full @ p["U"].transpose(0, 2, 1)
            flat[0][i] = np.concatenate([d_z[0], d_r[0], d_new[0]], axis=1)
            flat[1][j] = np.concatenate([d_z[1], d_r[1], d_new[1]], axis=1)
        for k in range(2):
            spots, sums = sum_by(index.T.ravel(), flat[k].reshape(-1, 3 * h))
            d_gates[k][spots] = sums  # padding is -1: the last row
        d_gates = d_gates[:, :-1]
        grad["U"], grad["b"] = d_U, d_gates.sum(axis=1, keepdims=True)
        grad["W"] = np.einsum("nd,kng->kdg", x, d_gates, optimize=True)
        return grad, np.einsum("kng,kdg->nd", d_gates, p["W"], optimize=True)


class Lexicon:
    """Numbers for words: windows are held as small arrays."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def encode(self, words: list[str]) -> np.ndarray:
        return np.array([self.at.setdefault(w, len(self.at)) for w in words], dtype=np.int32)


def train(samples: list[tuple[list[np.ndarray], int]], lexicon: Lexicon, shape: Shape) -> Network:
    """samples: the windows (numbers of the lexicon's words) of each document, with its label.

    A document's label says that some window is toxic, not which. In the first epochs drawn windows of a document
    carry its label; later, of all its windows, only the most toxic one of each toxic document does, and clean documents
    give their most toxic window and some others."""
    net, rng = Network.fresh(shape), np.random.default_rng(shape.seed)
    word, grams, sizes = hashed(list(lexicon.at) or ["-"], shape)
    first = np.cumsum(sizes) - sizes
    index = np.full((sum(len(w) for w, _ in samples), shape.window), -1, dtype=np.int32)
    owner, label, row = [], [], 0
    for d, (wins, y) in enumerate(samples):
        for win in wins:
            index[row, : len(win)] = win
            owner.append(d), label.append(y)
            row += 1
    owner, label = np.array(owner, dtype=np.int64), np.array(label, dtype=np.float32)
    many = np.bincount(owner, minlength=len(samples))
    apart = np.arange(len(samples)) % 4 == 3  # every fourth document sets the cut and trains nothing
    learn = np.flatnonzero(~apart[owner]) if len(samples) else owner
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in "EC"}
    square = {k: np.zeros(len(net.p[k]), np.float32) for k in "EC"}
    step = 0
    for epoch in range(shape.epochs if len(samples) else 0):
        rows = learn[rng.random(len(learn)) < np.minimum(shape.early, shape.early_most / many[owner[learn]])]
        if epoch >= 2:
            gates = net.gates_of(word, grams, sizes)
            score = np.full(len(index), -np.inf)
            score[learn] = net.logits(gates, index[learn])
            del gates
            order = learn[np.lexsort((-score[learn], owner[learn]))]
            best = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            mine = ~apart[owner]
            also = mine & (label == 0) & (rng.random(len(index)) < 0.15)
            sure = mine & (label == 1) & (score > 1.5)
            rows = np.unique(np.concatenate([best, np.flatnonzero(also | sure)]))
        rows = rng.permutation(rows)
        rate = shape.rate * (1.0 if epoch < shape.epochs - 2 else 0.3)
        for a in range(0, len(rows), shape.batch):
            part = index[rows[a : a + shape.batch]]
            used, local = np.unique(part, return_inverse=True)
            local = local.reshape(part.shape)
            if len(used) and used[0] < 0:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            n = sizes[used]
            gram = grams[np.repeat(first[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            x = net.inputs(word[used], gram, n)
            grad, d_x = net.gradients(x, local, label[rows[a : a + shape.batch]])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                net.p[k] -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            spread = d_x[:, shape.word_dim :] / n[:, None].astype(np.float32) ** 0.5
            for k, ids, g, of in (("E", word[used], d_x[:, : shape.word_dim], None), ("C", gram, spread, np.repeat(np.arange(len(n), dtype=np.int32), n))):
                spots, total = sum_by(ids, g, of)
                square[k][spots] += (total * total).mean(axis=1)
                net.p[k][spots] -= 5 * rate * total / (np.sqrt(square[k][spots])[:, None] + 1e-6)
    if len(samples) and 0 < label.sum() < len(label):
        gates = net.gates_of(word, grams, sizes)
        top = np.full(len(samples), -np.inf)
        np.maximum.at(top, owner, net.logits(gates, index))
        truth = np.array([y for _, y in samples])
        own = apart if 0 < truth[apart].sum() < apart.sum() else ~apart | True
        net.p["c"] -= np.float32(_cut(top[own], truth[own]))
    return net


def _cut(score: np.ndarray, truth: np.ndarray, clean: float = 3.0) -> float:
    """The cut with the least error rates, that of clean documents counting `clean` times; the middle of its gap."""
    order = np.argsort(score)
    score, truth = score[order], truth[order]
    miss = np.concatenate([[0], np.cumsum(truth / max(truth.sum(), 1))]) + np.concatenate([clean * np.cumsum(((1 - truth) / max((1 - truth).sum(), 1))[::-1])[::-1], [0]])
    k = int(np.argmin(miss))
    return float((score[max(k - 1, 0)] + score[min(k, len(score) - 1)]) / 2)


class Scorer:
    """Scores texts; remembers the gates of words it has met, up to `memory` of them besides those of the texts at hand.

    Room for these is taken at once, of which the system gives what is used: growing it would hold it twice on the way."""

    def __init__(self, net: Network, memory: int = 1 << 16) -> None:
        self.net, self.memory = net, memory
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = None  # the old ones go first
        self.gates = np.zeros((2, self.memory + (1 << 15), 3 * self.net.shape.hidden), np.float32)

    def _learn(self, fresh: list[str], block: int = 1 << 12) -> None:
        while len(self.known) + len(fresh) >= self.gates.shape[1] - 1:
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
        for k in range(0, len(fresh), block):
            words, a = fresh[k : k + block], len(self.known)
            made = self.net.gates_of(*hashed(words, self.net.shape))
            self.gates[:, a : a + len(words)], self.gates[:, -1] = made[:, :-1], made[:, -1]
            self.known |= zip(words, range(a, a + len(words)))

    def scores(self, texts: list[str], words_at_once: int = 1 << 14) -> np.ndarray:
        out, a = np.empty(len(texts)), 0
        while a < len(texts):
            b, held, parts = a, 0, []
            while b < len(texts) and held < words_at_once:
                parts.append(tokens(texts[b]))
                held += len(parts[-1])
                b += 1
            if len(self.known) > self.memory:
                self._forget()
            fresh = list(dict.fromkeys(w for part in parts for w in part if w not in self.known))
            if fresh or not self.known:
                self._learn(fresh or ["-"])
            out[a:b] = self._score(parts)
            a = b
        return out

    def _score(self, parts: list[list[str]]) -> np.ndarray:
        shape, known = self.net.shape, self.known
        flat = np.array([known[w] for part in parts for w in part] + [-1] * shape.window, dtype=np.int64)
        starts, owner, ends, base = [], [], [], 0
        for d, part in enumerate(parts):
            mine = windows_of(len(part), shape)
            starts += [base + s for s in mine]
            owner += [d] * len(mine)
            base += len(part)
            ends += [base] * len(mine)
        spot = np.array(starts)[:, None] + np.arange(shape.window)
        index = np.where(spot < np.array(ends)[:, None], flat[np.minimum(spot, len(flat) - 1)], -1)
        top = np.full(len(parts), -np.inf)
        np.maximum.at(top, np.array(owner), self.net.logits(self.gates, index))
        return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Network:
    """Trains on at most shape.sample documents of each label (those first by a seeded hash of the id), and of these on
    as many as hold shape.sample_words words together, in the same order: what reaches the driver is bounded in both.

    docs: doc_id, text; labels: doc_id, toxic. A document with several labels counts as toxic if one says so;
    of a doc_id that repeats, the text that sorts first is seen. Of a sampled document all windows are seen. Null labels,
    ids and texts are left out or empty; without rows of both labels the network is a fresh or one-sided one, which still scores."""
    ship(docs.sparkSession)
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [told.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(shape.seed), "doc_id"), "doc_id").limit(shape.sample) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # at most 2 * shape.sample rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(tokens(text)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string())], names=["id", "y", "words"])

    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text")
    one = rows.mapInArrow(cut, "id long, y int, words string").groupBy("id", "y").agg(F.min("words").alias("words"))  # at most 2 * shape.sample rows
    one = materialize(one.withColumn("n", F.regexp_count("words", F.lit(" ")) + 1), "toxicity-sample")
    upto = F.sum("n").over(Window.orderBy(F.xxhash64(F.lit(shape.seed), "id"), "id"))
    kept = one.select("id", "n").withColumn("upto", upto).where(F.col("upto") <= shape.sample_words).select("id")
    held = one.join(F.broadcast(kept), "id").select("id", "y", "words").collect()
    lexicon, samples, last = Lexicon(), [], None
    for r in sorted(held, key=lambda r: (r["id"], r["words"])):
        if r["id"] != last:
            words = lexicon.encode(r["words"].split())
            samples.append(([words[s : s + shape.window] for s in windows_of(len(words), shape)], r["y"]))
        last = r["id"]
    del held
    return train(samples, lexicon, shape)


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Null texts are empty; a text without words has the score of an empty window.

    Whole texts are read, whatever their length. Repeated rows score alike, null ids stay null, extra columns are
    ignored, an empty table gives an empty result."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps((net.shape, net.p)))  # a few MB, by Shape alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*pickle.loads(sent.value)))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores below `least`, all columns; no exchange.

    Repeated rows stay or go together; null ids and texts (empty) are fine; an empty table gives an empty one."""
    ship(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(pickle.dumps((net.shape, net.p))), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*pickle.loads(sent.value)))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                scores = scorer.scores([x or "" for x in part.column(at).to_pylist()])
                yield part.filter(pa.array(scores < least))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
