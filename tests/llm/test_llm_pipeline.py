from collections import Counter

import corpus_pipeline as p
from quaywave.llm.toxicity import fit_toxicity, held_out, score_toxicity
from test_llm_near_dedup import classes


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    net = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()))
    clean = {r["doc_id"] for r in score_toxicity(docs, net).where("score < 0.5").collect()}
    one = p.toxicity(spark, docs, sf)
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(rows) == clean and one.columns == columns

    two = p.exact_dedup(spark, one, sf)
    last = {}
    for i, t in rows.items():
        last[t] = max(i, last.get(t, i))
    left = {r["doc_id"] for r in two.collect()}
    assert left == set(last.values()) and two.columns == columns

    three = p.near_dedup(spark, two, sf)
    told = classes([(i, rows[i]) for i in left])
    left = {r["doc_id"] for r in three.collect()}
    assert left == set(told.values()) and three.columns == columns

    four = p.mixing(spark, three, sf)
    times = Counter(r["doc_id"] for r in four.collect())
    assert set(times) <= left and max(times.values()) <= 2 and four.columns == columns
    words = lambda ids: sum(len(rows[i].split()) * n for i, n in ids.items())
    assert abs(words(times) - 1.5 * words(Counter(left))) < 0.02 * words(Counter(left))

    five = p.packing(spark, four, sf).collect()
    assert Counter(r["doc_id"] for r in five if r["piece"] == 0) == times
    filled = Counter()
    for r in five:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_run_names_its_stages(spark, sf):
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert p.run(spark, sf).count() > 0


def test_repeated_rows_null_ids_and_long_white_space(spark, sf, tmp_path, docs_of):
    """Through the whole run: every distinct text once after the dedup stages, each row at most twice, none lost in packing."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, words(i), f"s{i % 3}") for i in range(40)]
    rows += [(3, words(3), "s0"), (3, words(3), "s0"), (100, words(4), "s1"), (None, words(5), "s2"), (None, words(200), "s2"), (None, words(200), "s2"), (None, None, None), (7, "", "s1"), (101, words(8) + " more", "s2")]
    rows += [(300, "a" + " " * 1_200_000 + "b", "s1")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {t or "" for _, t, _ in rows}

    two = p.exact_dedup(spark, docs, str(tmp_path)).collect()
    assert Counter(r["text"] or "" for r in two) == Counter(texts)
    assert {r["doc_id"] for r in two if r["text"] in (words(4), words(5), words(3))} == {100, 5, 3}

    three = p.near_dedup(spark, docs, str(tmp_path)).collect()
    assert Counter(r["text"] or "" for r in three) == Counter(texts - {words(8) + " more"})
    assert [r["doc_id"] for r in three if r["text"] in (words(4), words(200))].count(None) == 1

    four = Counter((r["doc_id"], r["text"]) for r in p.mixing(spark, docs, str(tmp_path)).collect())
    times = Counter((i, t) for i, t, _ in rows)
    assert all(n <= 2 * times[k] for k, n in four.items())

    five = p.packing(spark, docs, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in five if r["piece"] == 0) == Counter(i for i, _, _ in rows)
    out = p.run(spark, str(tmp_path)).collect()
    assert all(n <= 2 for n in Counter(r["doc_id"] for r in out if r["piece"] == 0 and r["doc_id"] is not None).values())


def test_empty_tables(spark, tmp_path, docs_of):
    docs_of([(1, "a")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
