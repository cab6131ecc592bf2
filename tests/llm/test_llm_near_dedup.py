import random
import re
from collections import Counter

import numpy as np

from quaywave.llm.components import connected_components
from quaywave.llm.near_dedup import COUNTERS, NEVER, Overlaps, _shingled, bag_minhash, keep_representatives, near_duplicates, near_links, prefixes, tokens_of
from quaywave.llm.shingles import multisets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w)))))


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def classes(rows):
    """Brute force: smallest id of the component over equal texts and links of 0.8 or more."""
    reps = {}
    for i, t in rows:
        if i is not None:
            reps[t or ""] = min(i, reps.get(t or "", i))
    ids, sets = list(reps.values()), {i: shingles(t) for t, i in reps.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(reps[t or ""]) for i, t in rows if i is not None}


def corpus(seed, groups=6, hot=60):
    rng, rows, i = random.Random(seed), [], 0
    words = [f"w{k}" for k in range(400)]
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for _ in range(hot if g == 0 else rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(1000 + k, rows[k][1]) for k in range(10)] + [(2000, "one two"), (2001, "one  two"), (2002, "same " * 50), (2003, "same " * 55), (2004, "same " * 90)]
    return rows


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(1)
    for top in (2, 5, 40):
        e = rng.integers(1, 2**62, 300).astype(np.uint64)
        a = rng.integers(0, top, 300)
        b = np.where(rng.random(300) < 0.7, a, rng.integers(0, top, 300))
        text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = bag_minhash(text, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m=8000)
        assert (s < NEVER).all() and abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def bits(texts):
    data = [t.encode() for t in texts]
    text, hashes, _ = _shingled(data, 5)
    return bag_minhash(*multisets(text, hashes), len(data))


def test_signatures_do_not_depend_on_the_texts_beside():
    rng = random.Random(5)
    said = lambda n: " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(99)) for _ in range(n))
    some = [said(n) for n in (1, 6, 12, 25, 60, 400)] + ["ab " * 700]
    alone = np.concatenate([bits([t]) for t in some])
    for others in (1, 10, 300, 1000):
        beside = [said(rng.choice((5, 13, 300))) for _ in range(others)]
        assert (bits(beside + some)[others:] == alone).all() and (bits(some + beside)[: len(some)] == alone).all()


def test_pairs_over_two_files_as_in_one(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    left, right = [], []
    for k in range(240):
        n = (6, 13, 25, 40, 60)[k % 5]
        text = [rng.choice(words) for _ in range(n)]
        more = text + [rng.choice(words) for _ in range((n - 4) // 4)]  # n - 4 shingles of (n - 4) * 5 / 4: overlap 0.8
        left.append((2 * k, " ".join(text)))
        right.append((2 * k + 1, " ".join(more)))
    filler = [(10_000 + k, " ".join(rng.choice(words) for _ in range(300))) for k in range(300)]
    schema = "doc_id long, text string"
    spark.createDataFrame(left + filler, schema).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame(right, schema).coalesce(1).write.parquet(f"{tmp_path}/b")
    told = classes(left + right + filler)
    for docs in (spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b"), spark.createDataFrame(left + right + filler, schema).coalesce(1)):
        assert {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()} == told


def test_exact_overlaps():
    texts = [t for _, t in corpus(3)][:40] + ["", "a", "a b c d", "a b c d e", "é 😀 x y z w"]
    near = Overlaps([t.encode() for t in texts], 5)
    for u in range(0, len(texts), 7):
        assert np.allclose(near.with_all(u), [jaccard(shingles(texts[u]), shingles(t)) for t in texts])


def test_against_brute_force_at_any_block_size(docs_of):
    rows = corpus(1)
    told = classes(rows)
    for block in (1000, 7):
        out = near_duplicates(docs_of(rows), block=block).collect()
        assert {r["doc_id"]: r["class_id"] for r in out} == told and len(out) == len(rows)
    sizes = Counter(told.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)
    assert sorted(r["doc_id"] for r in keep_representatives(docs_of(rows)).collect()) == sorted(sizes)


def test_edges(docs_of, edge):
    out = near_duplicates(docs_of(edge)).collect()
    told = classes(edge)
    assert len(out) == len(edge) and all(told[r["doc_id"]] == r["class_id"] for r in out if r["doc_id"] is not None)
    assert near_duplicates(docs_of(edge).limit(0)).count() == 0


def test_prefixes_of_like_texts_meet():
    texts = [t.encode() for _, t in corpus(5)][:70] + [b"same " * 50, b"same " * 55, b"a", b"a b c d e f", b""]
    text, token, short = prefixes(texts, 5, 0.8, np.random.default_rng(0).integers(0, 9, COUNTERS))
    sets = [set(token[text == i].tolist()) for i in range(len(texts))]
    few = [set(token[(text == i) & short].tolist()) for i in range(len(texts))]
    sizes = [sum(shingles(t.decode()).values()) for t in texts]
    like = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(shingles(texts[i].decode()), shingles(texts[j].decode())) >= 0.8]
    assert len(like) > 100 and all(sets[i] & sets[j] for i, j in like)
    assert all(few[i] & sets[j] if sizes[i] <= sizes[j] else few[j] & sets[i] for i, j in like)


def test_a_template_alone_brings_no_texts_together():
    rng = random.Random(9)
    passage = " ".join(f"t{k}" for k in range(160))
    texts = [f"{passage} {' '.join(f'u{g}x{k}' for k in range(30))} {rng.random()}".encode() for g in range(300)]
    text, token, short = prefixes(texts, 5, 0.8, _count(texts))
    members, index = Counter(token.tolist()), Counter(token[short].tolist())
    assert max(members.values()) > 250 and max((members[t] for t in index), default=0) < 10


def _count(texts):
    counts = np.zeros(COUNTERS, dtype=np.int64)
    np.add.at(counts, (tokens_of(texts, 5)[1] % np.uint64(COUNTERS)).astype(np.int64), 1)
    return counts


def template(seed, groups=40, each=3):
    """Texts that share a long passage, and so bands, but are alike only within their small groups."""
    rng = random.Random(seed)
    words, rows = [f"w{k}" for k in range(3000)], []
    passage = [rng.choice(words) for _ in range(70)]
    for g in range(groups):
        own = [rng.choice(words) for _ in range(24)]
        for _ in range(each):
            copy = passage + own
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_a_bucket_of_many_classes_over_many_blocks(docs_of):
    rows = template(3)
    told = classes(rows)
    assert len(set(told.values())) > 20
    for block in (5, 250):
        out = near_duplicates(docs_of(rows), block=block).collect()
        assert {r["doc_id"]: r["class_id"] for r in out} == told
    text = dict(rows)
    links = near_links(docs_of(rows), block=5).collect()
    assert all(abs(r["overlap"] - jaccard(shingles(text[r["u"]]), shingles(text[r["v"]]))) < 1e-12 and r["overlap"] >= 0.8 for r in links)
    assert len({min(r["u"], r["v"]) for r in links} | {max(r["u"], r["v"]) for r in links}) == sum(n for n in Counter(told.values()).values() if n > 1)


def test_rows_without_ids_and_repeated_rows(docs_of):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(None, base), (None, "other words here"), (None, base + " more"), (4, "x y z"), (4, "x y z"), (4, "another text of that id")]
    out = [(r["doc_id"], r["class_id"], r["class_size"]) for r in near_duplicates(docs_of(rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, None, 2), (None, None, 1), (None, None, 2), (4, 4, 2), (4, 4, 2), (4, 4, 1)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in keep_representatives(docs_of(rows)).collect()]
    assert len(kept) == 4 and {t for _, t in kept} >= {"x y z", "other words here", "another text of that id"}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(None, 3), (4, 4)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    rng.shuffle(edges)
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {n: find(n) for n in {x for e in edges if e[0] is not None and e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
