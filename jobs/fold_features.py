"""Builds a training table from labelled texts: windowed features, in folds that never split a source, scaled without leakage.

    python -m jobs.fold_features --documents DIR --labels DIR --out DIR [--config FILE]

A text is a series of word lengths, cut into overlapping windows as a recording is. Sources are dealt to folds
by their commonest label. Every window is scaled with the statistics of the rows outside its fold, that is, of those a
model is trained on when the fold is held out. Writes <out>/windows (by fold), <out>/scaling (fold, feature, mean,
std) and <out>/report (fold, train_classes, test_classes, valid); a rerun replaces them by the same rows."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywave.operators import folds
from quaywave.operators.features import array_features
from quaywave.operators.scaling import fit_standard_held_out
from quaywave.operators.spread import spread_join
from quaywave.operators.windows import cut_windows

log = logging.getLogger(__name__)
CONFIG = Path(__file__).with_suffix(".json")
WINDOWS = "doc_id long, source string, quality int, window_idx int, features array<double>, scaled array<double>, fold int"


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source (null: a source of its own), quality, text. A document labelled twice has the higher label; null texts are empty."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    source = F.when(F.col("source").isNull(), "none").otherwise(F.concat(F.lit("="), "source")).alias("source")
    return documents.select("doc_id", source, F.coalesce("text", F.lit("")).alias("text")).join(one, "doc_id")


def windows_of(texts: DataFrame, config: dict) -> DataFrame:
    """doc_id, source, quality, window_idx, features. Texts shorter than a window have none. Each text stays in its row."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(config["word"]), F.lit(0)), lambda w: F.length(w))
    series = texts.select("doc_id", "source", "quality", lengths.alias("lengths"))
    cut = cut_windows(series, "lengths", config["size"], config["step"])
    return cut.select("doc_id", "source", "quality", "window_idx", array_features("samples", tuple(config["features"])).alias("features"))


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> None:
    docs, told = spark.read.parquet(documents), spark.read.parquet(labels)
    log.info("reading %d documents and %d labels", docs.count(), told.count())  # from footers
    windows_of(labelled_texts(docs, told), config).write.mode("overwrite").parquet(f"{out}/unfolded")
    cut = spark.read.parquet(f"{out}/unfolded")

    dealt = folds.stratified_group_kfold(cut, [], "source", "quality", config["folds"])  # a row a source
    assigned = spread_join(cut, dealt.select("source", "fold"), ["source"], ["doc_id", "window_idx"])
    values = assigned.select("fold", F.posexplode("features").alias("feature", "value"))
    fit_standard_held_out(values, ["feature"]).select("fold", "feature", "mean", "std").coalesce(1).write.mode("overwrite").parquet(f"{out}/scaling")  # folds x features rows
    statistics = spark.read.parquet(f"{out}/scaling").groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("s"))
    scaled = F.zip_with("features", "s", lambda x, s: (x - s["mean"]) / s["std"])
    rows = assigned.join(F.broadcast(statistics), "fold", "left").select("doc_id", "source", "quality", "window_idx", "features", scaled.alias("scaled"), "fold")
    spread = F.pmod(F.xxhash64("doc_id", "window_idx"), F.lit(config["files_per_fold"]))
    rows.repartition("fold", spread).write.mode("overwrite").partitionBy("fold").parquet(f"{out}/windows")
    whole = read_windows(spark, out)
    log.info("wrote %d windows in %d folds to %s/windows", whole.count(), config["folds"], out)
    if not folds.leaks(whole, "source").isEmpty():
        raise ValueError(f"a source lies in several folds of {out}/windows")
    report = folds.valid_folds(whole, [], "quality", config["folds"])
    report.coalesce(1).write.mode("overwrite").parquet(f"{out}/report")  # a row a fold
    log.info("wrote %s/report", out)


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(WINDOWS).parquet(f"{out}/windows")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "labels", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("fold_features").getOrCreate()
    try:
        run(spark, args.documents, args.labels, args.out, settings(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
