import pytest

#: Extra columns whose names the operators use inside.
CLASHES = ("id", "key", "size", "row", "rank", "u", "v", "sha", "content", "n", "class_id", "__x")


@pytest.fixture
def docs_of(spark):
    """(doc_id, text[, source]) rows to a documents table with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for name in CLASHES:
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return make


#: Nulls, empties, ties, repeated rows, a very long text, odd code points.
EDGE = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a b c"), (None, "a b c"), (None, None), (5, "x " * 30000), (6, "é😀  z"), (7, " \t\n")]


@pytest.fixture
def edge():
    return list(EDGE)
