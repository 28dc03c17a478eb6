"""Writers for result tables (inventory S11)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_params_text(df: DataFrame, column: str = "params") -> DataFrame:
    """A params map as JSON text with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(column)))
    return df.withColumn(column, F.to_json(ordered))


def flatten_for_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that CSV can hold them."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("symbol", "timeframe"), fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Write a result partitioned by its run keys (parquet, csv with header, or json)."""
    keys = [c for c in partition_by if c in df.columns]
    out = flatten_for_text(df) if fmt == "csv" else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*keys) if keys else writer).save(path)


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summary rows as JSON lines."""
    df.write.mode(mode).json(path)
