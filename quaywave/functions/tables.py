"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..ship import ship


class SlidingWindows:
    """sliding_windows(TABLE(t) PARTITION BY k ORDER BY (ts, id), key => 'k', value => 'v', size => 16, step => 8)

    One row per complete window of the partition's rows, in their order: the key's value, window_idx, samples. Fewer than
    size + step values are held, whatever the length of a series; null values are left out. A partition is one
    task's work: operators.windows.explode_windows is the form that splits a series."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, size: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("sliding_windows: the first argument is a table")
        names = rows.dataType.fieldNames()
        for what, named in (("key", key), ("value", value)):
            if named.value not in names:
                raise ValueError(f"sliding_windows: {what} => {named.value!r} is not a column of {names}")
        for what, number in (("size", size), ("step", step)):
            if not isinstance(number.value, int) or number.value < 1:
                raise ValueError(f"sliding_windows: {what} => a whole number from 1 on")
        return AnalyzeResult(StructType().add(key.value, rows.dataType[key.value].dataType).add("window_idx", IntegerType()).add("samples", ArrayType(DoubleType())))

    def __init__(self) -> None:
        self.held: list[float] = []
        self.index = self.skip = 0

    def eval(self, rows: Row, key: str, value: str, size: int, step: int) -> Iterator[tuple]:
        if rows[value] is None:
            return
        if self.skip:
            self.skip -= 1
            return
        self.held.append(float(rows[value]))
        if len(self.held) == size:
            yield rows[key], self.index, list(self.held)
            self.index += 1
            self.skip = max(0, step - size)
            self.held = self.held[step:]


def register_tables(spark: SparkSession) -> None:
    """Makes the table functions of this module known to the session's SQL."""
    ship(spark)
    spark.udtf.register("sliding_windows", udtf(SlidingWindows))
