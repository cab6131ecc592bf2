import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywave.llm.toxicity import Lexicon, Network, Scorer, Shape, drop_toxic, fit_toxicity, hashed, held_out, score_toxicity, tokens, train, windows_of

SMALL = Shape(window=8, stride=6, words=512, grams=1024, epochs=14, batch=64)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 8, 9, 14, 15, 100):
        starts = windows_of(n, SMALL)
        covered = {i for s in starts for i in range(s, min(n, s + 8))}
        assert covered == set(range(n)) and all(b - a <= 6 for a, b in zip(starts, starts[1:]))


def test_gradients_equal_differences():
    shape = Shape(window=4, stride=3, words=16, grams=32, word_dim=2, char_dim=3, hidden=3, attend=2)
    net, rng = Network.fresh(shape), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, index, y = rng.normal(size=(6, 5)), np.array([[0, 1, 2, 3], [4, 5, -1, -1], [2, 2, 0, -1]]), np.array([1.0, 0.0, 1.0])

    def loss(x):
        z = net.attention(net.states(net.gates(x), index), index)[3].astype(float)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    grad, d_x = net.gradients(x, index, y)
    eps = 1e-2
    for name in ("W", "U", "b", "A", "a", "v", "o", "c"):
        flat, g = net.p[name].reshape(-1), np.asarray(grad[name]).reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            held = flat[i]
            flat[i] = held + eps
            up = loss(x)
            flat[i] = held - eps
            down = loss(x)
            flat[i] = held
            assert g[i] == pytest.approx((up - down) / (2 * eps), abs=3e-3), name
    x2 = x.copy()
    x2[2, 1] += eps
    x3 = x.copy()
    x3[2, 1] -= eps
    assert d_x[2, 1] == pytest.approx((loss(x2) - loss(x3)) / (2 * eps), abs=3e-3)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(120)]
    out = []
    for i in range(n):
        t = [str(w) for w in rng.choice(words, rng.integers(3, 40))]
        y = int(i % 3 == 0)
        if y:
            t[rng.integers(len(t))] = str(rng.choice(["zzbad", "zzworse", "ZZbadly!"]))
        out.append((i, " ".join(t), y))
    return out


def test_learns_and_scores_the_same_in_any_batch():
    rows, lexicon = texts(400, 1), Lexicon()
    samples = []
    for _, t, y in rows:
        w = tokens(t)
        samples.append(([lexicon.encode(w[a : a + 8]) for a in windows_of(len(w), SMALL)], y))
    net = train(samples, lexicon, SMALL)
    fresh = texts(200, 1)[100:] + [(0, "", 0), (1, "zz" * 500, 0), (2, "x " * 20000, 0)]
    one = Scorer(net).scores([t for _, t, _ in fresh])
    assert ((one[:100] >= 0.5) == [y for _, _, y in fresh[:100]]).mean() > 0.95
    assert np.allclose(one, [Scorer(net, memory=10).scores([t], words_at_once=5)[0] for _, t, _ in fresh], atol=1e-5)


def slow_score(net, text):
    """One window, one word, one direction at a time."""
    p, h, words = net.p, net.shape.hidden, tokens(text)
    sig = lambda v: 1 / (1 + np.exp(-v))
    inputs = []
    for w in words:
        word, grams, n = hashed([w], net.shape)
        inputs.append(np.concatenate([p["E"][word[0]], sum(p["C"][g] for g in grams) / np.sqrt(n[0])]).astype(float))

    def walk(xs, k):
        state, out = np.zeros(h), []
        for x in xs:
            g, u = x @ p["W"][k] + p["b"][k][0], state @ p["U"][k]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            out.append(state)
        return out

    best = -np.inf
    for a in windows_of(len(words), net.shape):
        xs = inputs[a : a + net.shape.window]
        if not xs:
            continue
        both = [np.concatenate(s) for s in zip(walk(xs, 0), walk(xs[::-1], 1)[::-1])]
        e = [np.tanh(s @ p["A"] + p["a"]) @ p["v"] for s in both]
        alpha = np.exp(np.array(e) - max(e))
        pooled = sum(a * s for a, s in zip(alpha / alpha.sum(), both))
        best = max(best, pooled @ p["o"] + p["c"][0])
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def test_scores_equal_a_slow_pass_over_every_window():
    net = Network.fresh(SMALL)
    rows = [t for _, t, _ in texts(40, 8)] + ["a", "a b c d e f g h", "x y " * 30, "w" * 400]
    assert np.allclose(Scorer(net).scores(rows), [slow_score(net, t) for t in rows], atol=1e-4)


def test_frames(spark, docs_of, edge):
    rows = [(i + 100, t) for i, t, _ in texts(300, 2)] + edge
    labels = spark.createDataFrame([(i + 100, y, "clash") for i, _, y in texts(300, 2)] + [(100, None, "x"), (None, 1, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    net = fit_toxicity(docs_of(rows), labels, SMALL)
    out = score_toxicity(docs_of(rows), net).collect()
    truth = {i + 100: y for i, _, y in texts(300, 2)}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in out if r["doc_id"] in truth]) > 0.95
    kept = drop_toxic(docs_of(rows), net)
    assert kept.columns == docs_of(rows).columns and kept.count() == sum(r["score"] < 0.5 for r in out)
    assert score_toxicity(docs_of(rows).limit(0), net).count() == 0
    nothing = fit_toxicity(docs_of(rows), labels.limit(0), SMALL)
    assert score_toxicity(docs_of(edge), nothing).count() == len(edge)


def test_held_out_rows_by_crc(spark):
    out = spark.range(200).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_held_out_accuracy_on_the_tables(spark, sf):
    path = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    net = fit_toxicity(docs, labels.where(~held_out()))
    seen = score_toxicity(docs, net).join(labels.where(held_out()), "doc_id").select("score", "toxic").toPandas()
    hit = (seen["score"] >= 0.5) == (seen["toxic"] == 1)
    assert hit[seen["toxic"] == 1].mean() >= 0.9 and hit[seen["toxic"] == 0].mean() >= 0.97


def test_the_middle_of_a_long_run_is_read():
    run = "".join(np.random.default_rng(9).choice(list("abcdefgh"), 1000))
    for text in (run[:60], run[:61], run[:90], run):
        got = tokens(text)
        assert max(map(len, got)) <= 60 and all(any(text[a : a + 30] in g for g in got) for a in range(max(1, len(text) - 29)))
    grams = [set(hashed(tokens(text), Shape())[1].tolist()) for text in (run, run[:500] + "zzworse" + run[507:], "zzworse")]
    assert len(grams[1] - grams[0]) >= 8 and len(grams[2] - grams[1]) <= 4  # all but those with an end mark


def test_the_sample_is_bounded_in_words(spark):
    rows = [(i, f"good words number {i} " * 10 if i % 2 else f"vile nasty stuff {i} " * 10) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    few = Shape(window=8, stride=6, words=512, grams=1024, epochs=1, batch=64, sample_words=400)
    net = fit_toxicity(docs, labels, few)  # ten documents
    assert net.shape.sample_words == 400
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(docs, net).collect()}
    assert all(0 <= s <= 1 for s in scored.values())


def test_hashing_a_lexicon_takes_little_more_than_what_it_gives():
    """The driver hashes the whole lexicon of the sample: all words at once took over ten times the result on the way."""
    import tracemalloc

    kinds = [f"word{k}of{k * 7919 % 100003}" for k in range(60_000)]
    tracemalloc.start()
    word, grams, sizes = hashed(kinds, Shape())
    peak, held = tracemalloc.get_traced_memory()[1], word.nbytes + grams.nbytes + sizes.nbytes
    tracemalloc.stop()
    assert peak < 4 * held
    some = [hashed(kinds[a : a + 1], Shape()) for a in (0, 8191, 8192, 59_999)]
    at = np.cumsum(sizes)
    for a, (w, g, n) in zip((0, 8191, 8192, 59_999), some):
        assert w[0] == word[a] and n[0] == sizes[a] and np.array_equal(g, grams[at[a] - sizes[a] : at[a]])


def test_a_scorer_holds_few_words_at_a_time():
    """Words of 2^17 tokens at once, and gates that doubled as a copy, took most of a Python worker's memory."""
    import tracemalloc

    texts = [" ".join(f"w{k * 7919 % 1000003}x{k}" for k in range(a, a + 200)) for a in range(0, 140_000, 200)]
    net = Network.fresh(Shape())
    tracemalloc.start()
    scores = Scorer(net).scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    some = [0, 1, 350, 699]  # alike, whatever was met before
    assert np.allclose(scores[some], [Scorer(net).scores([texts[k]])[0] for k in some], atol=1e-5)
