"""Registered queries and their SQL twins."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = fn(spark, sf_dir)
            dates = {f.name for f in df.schema.fields if f.dataType.typeName() == "date"}
            return df.select(*[F.col(c).cast("string").alias(c) if c in dates else F.col(c) for c in df.columns])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r6(column: Column | str) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])
