"""The registered queries over whole tables, against brute force where SQL can't tell their rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_llm_ann
import test_llm_mixing
import test_llm_near_dedup
import test_llm_pii
import test_llm_sharding
import test_llm_toxicity

from quaywave.llm.packing import encoder, pieces_of
from quaywave.llm.queries import QUERIES
from quaywave.llm.toxicity import fit_toxicity, held_out

COLUMNS = {
    "op1": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op2": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3": ["doc_id", "size", "source_size", "target", "taken"],
    "op4": ["query_id", "rank", "vec_id", "score"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "class_id"],
    "op8": ["page_id", "host", "path", "rule", "verdict"],
    "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op11": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


def named(n):
    return next(q for k, q in QUERIES.items() if k.startswith(f"{n}_"))


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns(n, spark, sf):
    assert set(COLUMNS[n]) <= set(named(n)(spark, sf).columns)


def test_personal_data(spark, sf, rows):
    out = {r["doc_id"]: r for r in named("op2")(spark, sf).collect()}
    for i, text, _ in rows:
        told = test_llm_pii.brute(text)
        assert out[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [told.count(k + ":") for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, told.split(","))) <= set(out[i]["spans"].split(","))


def test_mix(spark, sf, rows):
    frame = named("op3")(spark, sf)
    test_llm_mixing.check(rows, frame.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id"))
    assert sorted(map(str, frame.collect())) == sorted(map(str, named("op3")(spark, sf).collect()))


def test_neighbours(spark, sf):
    held = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    told, out = test_llm_ann.brute(held), named("op4")(spark, sf).collect()
    exact = {(q, i): s for q in told for i, s in told[q]}
    assert len(out) == 5 * len(told) and sum((r["query_id"], r["vec_id"]) in exact for r in out) >= 0.9 * len(out)
    assert all(np.isclose(r["score"], exact[r["query_id"], r["vec_id"]], atol=1e-12) for r in out if (r["query_id"], r["vec_id"]) in exact)


def test_packing(spark, sf, rows):
    encode, told, filled = encoder("byte_bpe_50k.json"), Counter(), defaultdict(list)
    for i, text, _ in rows:
        ids = np.array([*encode(text or ""), 0], dtype="<u4")
        told.update((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, a, n in pieces_of(ids, 2048))
    out = named("op5")(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == told
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(parts[-1]) <= 2048
    assert len(filled) <= -(-sum(r["length"] for r in out) // 2048) * 1.05 + 1


def test_toxicity_rows(spark, sf, rows):
    out = {r["doc_id"]: r for r in named("op6")(spark, sf).collect()}
    assert set(out) == {i for i, _, _ in rows}
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())


def test_toxicity_scores_equal_a_slow_pass(spark, sf, rows):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = fit_toxicity(docs, labels.where(~held_out()))
    out = {r["doc_id"]: r["score"] for r in named("op6")(spark, sf).collect()}
    few = [(i, t) for i, t, _ in rows if t and len(t) < 6000]
    assert len(few) > 150 and all(abs(out[i] - test_llm_toxicity.slow_score(net, t)) < 1e-3 for i, t in few)


def test_near_copies(spark, sf, rows):
    told = test_llm_near_dedup.classes([(i, t) for i, t, _ in rows])
    assert {r["doc_id"]: r["class_id"] for r in named("op7")(spark, sf).collect()} == told


def test_shards(spark, sf, rows):
    out = named("op9")(spark, sf).collect()
    test_llm_sharding.check(rows, out)
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    load, homes, weight = Counter(), defaultdict(set), Counter()
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        load[r["shard"]] += r["size"]
        homes[texts[r["doc_id"]]].add(r["shard"])
        weight[texts[r["doc_id"]]] += r["size"]
    share = sum(load.values()) / 24
    assert all(len(homes[t]) == 1 for t, n in weight.items() if n <= share)
    heaviest = max(n for n in weight.values())
    assert max(load.values()) <= max(1.02 * share, heaviest) and (heaviest > share / 2 or min(load.values()) >= 0.98 * share)
