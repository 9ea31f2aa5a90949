"""Sinks: partitioned parquet, csv, json, upserts by city, manifests, stage reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_parquet(df: DataFrame, path: str, by: str | None = "city", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """Result tables with a header; part files stay parallel."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_rows(old: DataFrame, new: DataFrame, key: str = "city") -> DataFrame:
    """Rows of recomputed cities replace the old ones; the rest stay."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def stage_exists(spark: SparkSession, path: str) -> bool:
    """True when a stage has been written whole (its success marker is present)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cache_or_build(spark: SparkSession, path: str, build, by: str | None = None,
                   force: bool = False) -> DataFrame:
    """Reuse a written stage, or build and write it; partitions overwrite only themselves."""
    if force or not stage_exists(spark, path):
        w = build().write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
        (w.partitionBy(by) if by else w).parquet(path)
    return spark.read.parquet(path)


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe_signature(tables: DataFrame, name: str, sig: list[str]) -> DataFrame:
    """Tables with equal signatures are one; keep the first name."""
    return tables.groupBy(*sig).agg(F.min(name).alias(name))
