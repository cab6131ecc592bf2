from collections import Counter

from pyspark.sql import functions as F

from quaywave.llm.common import materialize, rank_within, sweep, word_count


def test_ranks_are_gapless_within_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id"))
    out = rank_within(rows, ["k"], [F.col("id")], spread=16).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["k"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in groups.values()) and len(out) == 5000
    again = rank_within(rows.repartition(7), ["k"], [F.col("id")], spread=16).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_tables_are_swept(spark):
    sweep(spark)
    kept = materialize(spark.range(3), "t")
    assert kept.count() == 3 and sweep(spark) == 1 and sweep(spark) == 0


def test_words_are_runs_without_ascii_space(spark):
    texts = ["", "a", " a\tb\n\x0bc\x0c\rd ", "é ü x", "a" * 50]
    told = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()]
    assert told == [0, 1, 4, 2, 1]
