"""Where queries and their SQL twins are listed."""

from __future__ import annotations

from pyspark.sql import SparkSession

QUERIES: dict = {}
ORACLE: dict = {}


class Tables:
    """Column-pruned, lazily read tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} listed twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add
