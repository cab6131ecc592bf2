import datetime as dt
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from oracle import both
from pyspark.sql import functions as F

from jobs import event_windows, fold_features
from jobs.queries import ORACLES, QUERIES
from quaywave.operators.spread import spread_join

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, sf):
    rows, told = both(QUERIES[name], ORACLES[name], spark, sf)
    assert rows == told


def events(days, per_day=120, start=0):
    first = dt.datetime(2024, 3, 1)
    return [(start + d * 10_000 + k, first + dt.timedelta(days=d, minutes=9 * k + d), k % 7, ("a", "b", None)[k % 3], float((k * k + d) % 97), "p") for d in days for k in range(per_day)]


def state(spark, out):
    rows = event_windows.read_windows(spark, out)
    return Counter(tuple(r) for r in rows.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in rows.dtypes)).collect())


def whole(spark, rows):
    samples = spark.createDataFrame(rows, EVENTS).where("ts IS NOT NULL AND value IS NOT NULL").withColumn("day", F.to_date("ts"))
    out = event_windows.day_windows(samples, 16, 8)
    return Counter(tuple(r) for r in out.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes)).collect())


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    config = event_windows.settings()
    add = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    files = lambda: Counter(r[0] for r in event_windows.read_windows(spark, out).select(F.input_file_name()).distinct().collect())

    one = events([0, 1, 2])
    add(one)
    event_windows.run(spark, source, out, mark, config)
    assert state(spark, out) == whole(spark, one)
    before, kept = state(spark, out), files()

    event_windows.run(spark, source, out, mark, config)  # nothing new: nothing is written
    assert state(spark, out) == before and files() == kept

    late = events([1], per_day=40, start=500_000)  # another file of a day that was there, shuffled in time
    odd = [(1, None, 1, "a", 1.0, "p"), (2, dt.datetime(2024, 3, 1, 5), 1, "a", None, "p")]
    two = late + events([5]) + odd + [late[0]] * 3
    add(two)
    caplog.clear()
    event_windows.run(spark, source, out, mark, config)
    assert state(spark, out) == whole(spark, one + two)
    assert f"read {len(two) - len(odd)} events" in caplog.text  # what is new alone
    days = {}
    for r in event_windows.read_windows(spark, out).select("day", F.input_file_name().alias("file")).distinct().collect():
        days.setdefault(r["day"], set()).add(r["file"])
    untouched = {f for d, fs in days.items() if d in (dt.date(2024, 3, 1), dt.date(2024, 3, 3)) for f in fs}
    assert untouched <= set(kept) and not days[dt.date(2024, 3, 2)] & set(kept)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


def test_growing_copy_of_the_given_events(spark, sf, tmp_path):
    given = spark.read.parquet(f"{'/root/testdata/sf0.01' if os.path.isdir('/root/testdata/sf0.01') else sf}/events.parquet")
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    sizes = []
    for part in (0, 1):  # the second half brings more of every day
        given.where(F.pmod("event_id", F.lit(2)) == part).coalesce(2).write.mode("append").parquet(source)
        event_windows.run(spark, source, out, mark, event_windows.settings())
        sizes.append(sum(state(spark, out).values()))
    every = event_windows.day_windows(given.where("value IS NOT NULL").withColumn("day", F.to_date("ts")), 16, 8)
    assert sizes[0] < sizes[1] and state(spark, out) == Counter(tuple(r) for r in every.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in every.dtypes)).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    out, config = str(tmp_path / "out"), event_windows.settings()
    batch = spark.createDataFrame(events([0, 4]), EVENTS)
    event_windows.update(batch, 0, out, config)
    before = state(spark, out)
    event_windows.update(batch, 0, out, config)
    assert state(spark, out) == before == whole(spark, events([0, 4]))


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "in"))
    event_windows.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), event_windows.settings())
    assert event_windows.read_windows(spark, str(tmp_path / "out")).count() == 0


def test_command_line(spark, tmp_path):
    spark.createDataFrame(events([0]), EVENTS).write.parquet(str(tmp_path / "in"))
    args = [x for n, p in (("events", "in"), ("out", "out"), ("checkpoint", "mark")) for x in (f"--{n}", str(tmp_path / p))]
    done = subprocess.run([sys.executable, "-m", "jobs.event_windows", *args], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 120 events" in done.stderr and "windows of 1 days" in done.stderr
    assert state(spark, str(tmp_path / "out")) == whole(spark, events([0]))


def texts(spark, path, rows, labels):
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, fold string").write.parquet(f"{path}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels")


def test_folds_of_texts(spark, tmp_path):
    said = lambda n, k: " ".join("x" * (1 + (i * i + k) % 9) for i in range(n))
    rows = [(k, said(60 + 10 * k, k), f"s{k % 7}" if k % 5 else None) for k in range(40)] + [(90, None, "s1"), (91, "", "s2"), (92, "short one", None), (None, said(99, 1), "s1"), (3, said(70, 5), "s3")]
    labels = [(k, k % 2) for k in range(0, 40, 1)] + [(3, 0), (3, 1), (90, 1), (91, 0), (92, 1), (None, 1), (5, None), (777, 1)]
    texts(spark, tmp_path, rows, labels)
    out, config = str(tmp_path / "out"), fold_features.settings()
    taken = []
    for _ in range(2):
        fold_features.run(spark, str(tmp_path / "documents"), str(tmp_path / "labels"), out, config)
        taken.append(Counter((r["doc_id"], r["source"], r["quality"], r["window_idx"], r["fold"], *(round(x, 9) for x in [*r["features"], *r["scaled"]])) for r in fold_features.read_windows(spark, out).collect()))
    assert taken[0] == taken[1]
    windows = Counter(k for k, *_ in taken[0].elements())
    assert windows == Counter({k: (len(t.split()) - 64) // 32 + 1 for k, t, _ in rows if k is not None and k not in (3,) and t and len(t.split()) >= 64} | {3: sum((len(t.split()) - 64) // 32 + 1 for k, t, _ in rows if k == 3)})
    homes = {}
    for _, source, _, _, fold, *_ in taken[0]:
        assert homes.setdefault(source, fold) == fold
    assert set(homes.values()) == {0, 1, 2} and "none" in homes
    for f in range(3):  # the training rows' mean is what a fold is scaled by
        train = [r[5] for r in taken[0].elements() if r[4] != f]
        mean, std = sum(train) / len(train), (sum(x * x for x in train) / len(train) - (sum(train) / len(train)) ** 2) ** 0.5
        assert all(abs((r[5] - mean) / std - r[11]) < 1e-6 for r in taken[0] if r[4] == f)
    report = {r["fold"]: r["valid"] for r in spark.read.parquet(f"{out}/report").collect()}
    assert set(report) == {0, 1, 2}


def test_no_texts(spark, tmp_path):
    texts(spark, tmp_path, [(1, "too short", "s")], [(1, 1)])
    fold_features.run(spark, str(tmp_path / "documents"), str(tmp_path / "labels"), str(tmp_path / "out"), fold_features.settings())
    assert fold_features.read_windows(spark, str(tmp_path / "out")).count() == 0


def test_hot_and_null_keys_are_joined_whole(spark):
    many = spark.createDataFrame([("hot", k) for k in range(3000)] + [(None, k) for k in range(500)] + [(f"k{k % 50}", k) for k in range(200)], "key string, n long")
    one = spark.createDataFrame([("hot", 1), (None, 2), *((f"k{k}", 10 + k) for k in range(40))], "key string, v long")
    for how in ("inner", "left"):
        got = Counter(tuple(r) for r in spread_join(many, one, ["key"], ["n"], how, parts=16).select("key", "n", "v").collect())
        assert got == Counter(tuple(r) for r in many.join(one, ["key"], how).select("key", "n", "v").collect())
