import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quaywave.llm.packing import best_fit, encoder, pack_documents, pieces_of


def unroll(plan):
    """(length, rank) -> (sequence, offset)."""
    out = {}
    for length, first, ranks, sequence, n, at in plan:
        for k in range(ranks):
            out[length, first + k] = (sequence + k % n, at + k // n * length)
    return out


def check_plan(counts, capacity):
    slots = unroll(best_fit(counts, capacity))
    assert Counter(n for n, _ in slots) == Counter({k: v for k, v in counts.items() if v})
    filled = defaultdict(list)
    for (n, _), (s, at) in slots.items():
        filled[s].append((at, n))
    for parts in filled.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= capacity
    return len(filled)


def one_by_one(counts, capacity):
    """Best-fit decreasing over single pieces."""
    rooms = []
    for n in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_whole_gapless_and_as_good_as_single_pieces():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(3, 40)
        counts = {n: rng.randint(0, 9) for n in range(1, capacity + 1) if rng.random() < 0.7}
        made = check_plan(counts, capacity)
        assert made <= one_by_one(counts, capacity)
        assert made >= -(-sum(k * v for k, v in counts.items()) // capacity)
    assert best_fit({}, 8) == []


def test_plan_does_not_grow_with_counts():
    counts = {n: 10**9 // n for n in range(1, 2049)}
    assert len(best_fit(counts, 2048)) < 30000


def test_pieces():
    for n in (1, 5, 2048, 2049, 5000):
        parts = pieces_of(np.zeros(n), 2048)
        assert sum(p[2] for p in parts) == n and all(p[2] == 2048 for p in parts[1:]) and [p[1] for p in parts] == [0, *np.cumsum([p[2] for p in parts])[:-1]]


TEXTS = ["", "Hello, world's  end\n\n x", "naïve 😀 日本語 １２３", "a" * 3000, " \t\r\n ", "<|endoftext|> x", "don't DON'T 12345   ..."]


def test_ids_equal_the_tokenizers_library(spark, sf):
    fast, slow = encoder(), encoder("byte_bpe_50k.json")
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        assert list(fast(t)) == list(slow(t))


def test_against_brute_force(docs_of, edge):
    rows = edge + [(10 + i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "word " * (i % 40)) for i in range(300)]
    encode = encoder("byte_bpe_50k.json")
    told = Counter()
    for i, t in rows:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        for k, a, n in pieces_of(ids, 64):
            told[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    out = pack_documents(docs_of(rows), capacity=64).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == told
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 64
    assert len(filled) <= 1.02 * sum(r["length"] for r in out) / 64 + 2
    assert pack_documents(docs_of(rows).limit(0)).count() == 0


def test_hot_length(docs_of):
    out = pack_documents(docs_of([(i, "same text") for i in range(2000)]), capacity=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 2000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_vocabulary_is_a_parameter(name):
    assert list(encoder(name)("the end"))


def test_very_long_white_space_is_encoded():
    from quaywave.llm.packing import encoder

    for text in (" " * 1_000_000, "a" + " \n" * 1_000_000 + "b"):
        assert encoder()(text) == encoder("byte_bpe_50k.json")(text)


def test_ids_of_every_code_point_and_of_whole_tables(spark, sf):
    fast, plain = encoder(), encoder("byte_bpe_50k.json")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [sep.join(points[k : k + 512]) for k in range(0, len(points), 512) for sep in ("", "a", " ", "'s1 ", "<|endoftext|>")]
    whole = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else sf
    texts += [r["text"] for r in spark.read.parquet(f"{whole}/documents.parquet").where("text IS NOT NULL").select("text").collect()]
    assert all(fast(t) == plain(t) for t in texts)
