import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quaywave.llm.mixing import fit_budget, knapsack, mix_sources, mixed


def pour(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets the slow way: share by weight, cap, hand the excess round again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_knapsack_finds_the_best_sum():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 15), 4)
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 40)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
        chosen = knapsack(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(chosen, counts)) and sum(a * b for a, b in zip(chosen, lengths)) == max(sums)


def test_budget_fits_large_histograms_exactly():
    rng = random.Random(3)
    lengths = list(range(1, 3000, 7))
    counts = [rng.randint(1, 400) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        taken = fit_budget(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(taken, counts)) and sum(a * b for a, b in zip(taken, lengths)) == min(budget, total)


def check(rows, frame):
    size = lambda t: len([w for w in (t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w])
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    targets, taken = pour(sizes), Counter()
    out = frame.collect()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    longest = max((size(t) for _, t, _ in rows), default=0)
    assert all(targets[s] - taken[s] <= longest + 1 and taken[s] <= targets[s] + 1e-6 for s in sizes)


def test_sources_meet_their_targets_and_reruns_agree(docs_of):
    rng = random.Random(4)
    sources = ["a", "b", None, "é", "Z", "hot"]
    rows = [(i, "w " * rng.randint(0, 40), "hot" if i % 3 == 0 else rng.choice(sources)) for i in range(1500)]
    frame = mix_sources(docs_of(rows))
    check(rows, frame)
    assert sorted(map(str, frame.collect())) == sorted(map(str, mix_sources(docs_of(rows).repartition(3)).collect()))


def test_edges(docs_of, edge):
    rows = [(*r, "s" if i % 2 else None) for i, r in enumerate(edge)]
    check(rows, mix_sources(docs_of(rows)))
    assert mix_sources(docs_of(rows).limit(0)).count() == 0
    check([(1, None, None), (2, "", "a")], mix_sources(docs_of([(1, None, None), (2, "", "a")])))


def test_rows_are_repeated_as_taken(docs_of):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(200)]
    told = {r["doc_id"]: r["copies"] for r in mix_sources(docs_of(rows)).collect()}
    out = mixed(docs_of(rows))
    got = {r["doc_id"]: r["c"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert out.columns == docs_of(rows).columns and got == {k: v for k, v in told.items() if v}
