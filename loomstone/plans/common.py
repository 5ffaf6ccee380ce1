"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Register a function of a ``Tables`` under its name; ``sql`` gives the same rows in DuckDB."""

        def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[fn.__name__] = lambda spark, d: fn(Tables(spark, d))
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add


class Tables:
    """The parquet tables of a folder; the times of ``events`` come as instants in UTC."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for c, t in df.dtypes:
            if t == "timestamp_ntz":
                df = df.withColumn(c, F.col(c).cast("timestamp"))
        return df


def now_of(df: DataFrame, ts: str) -> Column:
    """The greatest time of a table as a literal: the anchor in place of a clock; null where there is none."""
    return F.lit(df.agg(F.max(ts)).first()[0]).cast("timestamp")
