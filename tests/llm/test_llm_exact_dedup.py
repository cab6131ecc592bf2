import hashlib
import random

import pytest
import xxhash

from quaywave.llm.exact_dedup import ContentTable, fold, grace, grace_dedup, keep_one


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        out.append((i, top, len(ids), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in frame.collect()), key=str)


@pytest.mark.parametrize("budget", [200, 5000, 64 << 20])
def test_any_table_size_gives_the_same_groups(budget):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 4))) for _ in range(2000)]
    records = [(xxhash.xxh3_64_intdigest(t), i, 1, t, b"%d" % i) for i, t in enumerate(texts)]
    told = {c: (top, n) for _, top, n, c, rest in grace(fold(records, budget), budget) if rest == b"%d" % top}
    assert told == {t: (max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}
    assert len(list(grace(records, budget))) == len(told)


def test_colliding_hashes_compare_contents():
    records = [(7, i, 1, c, b"") for i, c in enumerate([b"a", b"b", b"a", b"c", b"b"])]
    assert sorted((c, top, n) for _, top, n, c, _ in grace(records, 1)) == [(b"a", 2, 2), (b"b", 4, 2), (b"c", 3, 1)]
    table = ContentTable(2)
    for r in records:
        table.add(*r)
    assert len(table.hashes) == 3


def test_edges(spark, docs_of, edge):
    assert found(grace_dedup(docs_of(edge))) == brute(edge)
    assert grace_dedup(docs_of(edge).limit(0)).count() == 0


def test_hot_text_and_rows_kept(docs_of):
    rows = [(i, "same" if i % 3 else f"text {i % 50}") for i in range(3000)]
    assert found(grace_dedup(docs_of(rows), table_bytes=500)) == brute(rows)
    kept = keep_one(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({b[1] for b in brute(rows)}) and kept.columns == docs_of(rows).columns


def test_against_sql(spark, sf):
    from oracle import both

    from quaywave.llm.queries import ORACLES, QUERIES

    for name in ("op1_exact_dedup", "op10_chat_format", "op8_url_filter"):
        if name in ORACLES:
            rows, told = both(QUERIES[name], ORACLES[name], spark, sf)
            assert rows == told
