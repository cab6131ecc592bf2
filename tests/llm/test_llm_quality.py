import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from quaywave.llm import quality
from quaywave.llm.quality import RULES, fit_cutoffs, judge_quality, most_failures, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark, docs_of, edge):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in edge]
    for k in range(60):
        rows.append((100 + k, "".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "#", "É", " ", "\x0b"]) for _ in range(rng.randrange(200)))))
    rows += [(900, "one two three four " * 3), (901, "a a a a"), (902, "x y z\nx y z\nx y z"), (903, "\n".join(["same line"] * 9)), (904, " ".join(f"w{k % 4001}" for k in range(50_000)))]
    out = text_stats(docs_of(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["id"], *(r[n] for n in names), r["base_failed"]) for r in out) == Counter((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows for c in [counts(t)])


def exact(n, risk, doubt):
    risk, whole, k = Fraction(risk), Fraction(0), -1
    for i in range(n + 1):
        whole += comb(n, i) * risk**i * (1 - risk) ** (n - i)
        if whole > Fraction(doubt):
            return k
        k = i
    return k


@pytest.mark.parametrize("risk", [0.05, 0.008, 0.3])
def test_bounds_are_exact(spark, risk):
    doubt = 0.002
    sizes = [0, 1, 5, 17, 59, 100, 250, 700]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", most_failures(F.col("n"), risk, F.lit(doubt)).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == {n: exact(n, risk, doubt) for n in sizes}


def test_a_large_holdout_does_not_underflow(spark):
    k = spark.range(1).select(most_failures(F.lit(2_000_000), 0.01, F.lit(0.001)).alias("k")).first()["k"]
    assert 19_400 < k < 19_700  # n p - 3.09 sd = 19565


def labelled(n=3000, strata=("en", "de", None), seed=1):
    """Bad texts are full of symbols; one good text in two hundred is, too. In `xx` half of the good ones are."""
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        stratum = rng.choice([*strata, "xx"]) if k % 50 else "tiny"
        good = rng.random() < 0.85
        signs = rng.random() < (0.5 if stratum == "xx" else 0.005) if good else True
        rows.append((k, " ".join(f"w{rng.randrange(10**6)}" + ("#" * rng.randint(2, 3) if signs else "") for _ in range(60)), stratum))
        labels.append((k, int(good)))
    return rows, labels


def test_false_rejections_stay_within_the_bound(spark, docs_of):
    rows, labels = labelled()
    docs = docs_of([(i, t) for i, t, _ in rows]).drop("lang").join(spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, lang string"), "doc_id")
    told = spark.createDataFrame([*labels, *labels[:50], (None, 0), (5, None)], "doc_id long, quality int")
    stats = text_stats(docs)
    found = fit_cutoffs(stats, told, risk=0.3).collect()
    strata = {r["stratum"] for r in found if r["rule"] == "symbols"}
    assert {"en", "de", None} <= strata and "xx" not in strata and "tiny" not in strata
    for r in found:
        assert r["lost"] <= r["allowed"] == exact(r["good"], 0.3 / len(RULES), 0.05 / (5 * len(RULES))) and r["caught"] > 0
    out = {r["doc_id"]: r for r in judge_quality(docs, told, risk=0.3, price=10.0).collect()}
    good = {i for i, g in labels if g}
    where = {i: s for i, _, s in rows}
    for s in ("en", "de", None):
        mine = [i for i in out if where[i] == s]
        lost = sum(not out[i]["kept"] for i in mine if i in good) / sum(i in good for i in mine)
        caught = sum(not out[i]["kept"] for i in mine if i not in good) / sum(i not in good for i in mine)
        assert lost <= 0.02 and caught >= 0.8
    assert all(out[i]["kept"] for i in out if where[i] in ("xx", "tiny"))


def test_small_strata_are_judged_together(spark, docs_of, monkeypatch):
    monkeypatch.setattr(quality, "STRATA", 4)
    rows, labels = labelled(1600, strata=("a", "b", "c", "d", "e"), seed=3)
    rows = [(i, t, "en" if s in ("a", "b") else s) for i, t, s in rows if s != "xx"] + [(9000, rows[0][1], "unseen"), (9001, "w# " + " ".join(f"q{k}##" for k in range(60)), "unseen")]
    docs = docs_of([(i, t) for i, t, _ in rows]).drop("lang").join(spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, lang string"), "doc_id")
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    found = fit_cutoffs(text_stats(docs), told, risk=0.2).collect()
    assert {(r["pooled"], r["stratum"]) for r in found} == {(False, "en"), (True, None)}
    out = {r["doc_id"]: r for r in judge_quality(docs, told, risk=0.2).collect()}
    assert not out[9001]["kept"] and out[9001]["reason"] == "symbols"


def test_a_rule_that_adds_nothing_is_left_out(spark, docs_of):
    """Bad texts are full of symbols and of long words; a few good ones have long words. Symbols tell all that is to tell."""
    rng, rows, labels = random.Random(6), [], []
    for k in range(2500):
        bad, long = k % 10 == 0, k % 10 == 0 or k % 700 == 1
        rows.append((k, " ".join(f"{'w' * (12 if long else 2)}{rng.randrange(10**4)}" + ("##" if bad else "") for _ in range(60))))
        labels.append((k, int(not bad)))
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    found = fit_cutoffs(text_stats(docs_of(rows)), told, price=1.0).collect()
    assert [(r["rule"], r["own_lost"], r["own_caught"]) for r in found] == [("symbols", 0, 250)]
    out = {r["doc_id"]: r["kept"] for r in judge_quality(docs_of(rows), told, price=1.0).collect()}
    assert all(out[k] == bool(good) for k, good in labels)


def test_copies_count_once_and_edges(spark, docs_of, edge):
    docs = docs_of([(r[0], r[1]) for r in edge] + [(50 + k, " ".join(f"v{j}" for j in range(80))) for k in range(300)])
    told = spark.createDataFrame([(50 + k, 1) for k in range(300)] + [(1, 0), (3, 1)], "doc_id long, quality int")
    assert {r["good"] for r in fit_cutoffs(text_stats(docs), told).collect()} <= {1}
    out = judge_quality(docs, told).collect()
    assert len(out) == len(edge) + 300 and all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] >= 50) for r in out)
    none = told.where(F.lit(False))
    assert sum(r["kept"] for r in judge_quality(docs, none).collect()) == 300
    assert judge_quality(docs.where(F.lit(False)), told).count() == 0
