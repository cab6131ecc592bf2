"""Partitioned tables of which a run replaces some partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def replace_parts(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows so that exactly the partitions they name are replaced; a repeated run leaves the same table.

    The writer's own option: the session's settings stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
