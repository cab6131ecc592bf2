import os
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaywave.llm import alignment
from quaywave.llm.alignment import B, Tokens, align_documents
from quaywave.llm.queries import op11_align

A = "byte_bpe_50k.json"


def brute(rows):
    """Per row: n_a, n_b, groups text, links, n_best, count_sum, overlaps, by walking end offsets."""
    one = Tokenizer.from_file(str(public_tokenizers.path(A)))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(B)))
    byte_a, byte_b = Tokens.of(A).bytes_of, Tokens.of(B).bytes_of
    out, counts = [], Counter()
    for key, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        said = (" " + (text or "")).encode()
        if not text or b"".join(byte_a[i] for i in a) != said or b"".join(byte_b[i] for i in b) != said:
            a, b = [], []
        ends, spans = [], []
        for ids, table in ((a, byte_a), (b, byte_b)):
            at, e = 0, []
            for i in ids:
                at += len(table[i])
                e.append(at)
            ends.append(e)
            spans.append([(y - len(table[i]), y) for i, y in zip(ids, e)])
        groups, i, j, links = [], 0, 0, []
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        overlaps = sum(p < s and r < q for p, q in spans[0] for r, s in spans[1]) if len(a) < 2000 else None
        out.append((key, len(a), len(b), ";".join(groups), links, overlaps))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [(k, na, nb, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), o) for k, na, nb, g, x, o in out], counts


def test_both_forms_of_the_vocabulary_give_the_same_ids(spark, sf):
    json, fast = Tokens.of(A), Tokens.of(alignment.A)
    assert json.bytes_of[: len(fast.bytes_of)] == fast.bytes_of and len(json.bytes_of) - len(fast.bytes_of) == 1
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [sep.join(points[k : k + 512]) for k in range(0, len(points), 512) for sep in ("", "a", " ", "'s1 ")]
    whole = sf if not os.path.isdir("/root/testdata/sf0.1") else "/root/testdata/sf0.1"
    texts += [r["text"] for r in spark.read.parquet(f"{whole}/documents.parquet").where("text IS NOT NULL").select("text").collect()]
    texts += [" " * 1_000_000, " \n" * 600_000, "x" * 20_000]
    for k in range(0, len(texts), 500):
        assert json.encode(texts[k : k + 500]) == fast.encode(texts[k : k + 500])


ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "\x00 nul", "  two  spaces ", " 　wide", "naïve façade ﬁne Å", "𝔘𝔫𝔦 😀👩‍👩‍👧", "\r\n\t mixed \n\n lines", "x" * 3000, "日本語のテキスト", "é combining", "🏽", " "]


def check(spark, docs, rows):
    told, counts = brute(rows)
    aligned, pairs = align_documents(docs)
    got = aligned.collect()
    mine = Counter((r["doc_id"], r["n_a"], r["n_b"], r["groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in got)
    assert mine == Counter(t[:7] for t in told)
    assert all(r["n_groups"] == r["n_links"] for r in got)
    over = Counter((t[3], t[7]) for t in told if t[7] is not None)
    assert all(over[(r["groups"], r["n_overlaps"])] for r in got if r["n_a"] < 2000)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(counts)


def test_against_brute_force_on_edges(spark, docs_of, edge):
    rows = [(r[0], r[1]) for r in edge] + [(100 + k, t) for k, t in enumerate(ODD)]
    check(spark, docs_of(rows), rows)


def test_pairs_beyond_the_broadcast_ones(spark, docs_of, monkeypatch):
    rows = [(k, f"word{k % 7} thing number {k} is here, {'again ' * (k % 5)}") for k in range(60)]
    for head in (1, 3, 40):
        monkeypatch.setattr(alignment, "HEAD", head)
        check(spark, docs_of(rows), rows)


def test_query_digests_the_groups(spark, sf):
    import hashlib

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    told, _ = brute(rows)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = Counter((k, na, nb, n, n, best, total, sha(g)) for k, na, nb, g, n, best, total, _ in told)
    got = op11_align(spark, sf).drop("n_overlaps").collect()
    assert Counter(tuple(r) for r in got) == want


def test_empty_table(spark, docs_of):
    docs = docs_of([(1, "a")]).where(F.lit(False))
    aligned, pairs = align_documents(docs)
    assert pairs.count() == 0 and aligned.count() == 0
