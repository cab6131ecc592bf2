"""From raw documents to packed sequences: toxicity, exact copies, near copies, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents. In every stage null texts are empty, a null source is a source, rows may lack an id or
repeat one, extra columns pass through, ties fall alike in reruns, and an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaywave.llm.common import materialize
from quaywave.llm.exact_dedup import keep_one
from quaywave.llm.mixing import mixed
from quaywave.llm.near_dedup import keep_representatives
from quaywave.llm.packing import pack_documents
from quaywave.llm.toxicity import drop_toxic, fit_toxicity, held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose most toxic window scores 0.5 or more, repeated rows alike.

    Learns from labels outside the held-out fifth; whole texts are scored. No exchange of documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return drop_toxic(docs, fit_toxicity(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every distinct text, that with the largest id; of repeated rows a single one."""
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every class of near copies (five words, 0.8, linked), that with the smallest id; classes are told by texts."""
    return keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows so that each source comes near its target; a row is taken twice at most, repeated rows each for themselves."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every row is packed."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: A trained network and a packing plan have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
