"""A corpus from ``documents``: clean, of known language, without near copies, mixed to weight, as pieces.

Each stage works on all that the stage before kept, which is written as Parquet and read
again in between.  All stages but the last return the columns they were given.

* toxicity: documents scored at 0.5 or more go.  The model learns from the labelled rows
  of the given documents; texts without words stay.
* language: documents go that have no letter or whose best language scores below 0.3.
* near_duplicates: of each group linked by five-word shingles (Jaccard similarity of 0.8 or more) the
  document of least id stays.
* mixing: documents are left out or repeated so that each source comes near its target.
* pieces: ids of the text's pieces; null and empty texts have none.

Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import language, mixing, pieces, queries, simhash, toxicity
from panelwright.session import scratch_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels")))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(queries.language_rows(docs)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def to_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.plan(mixing.sized(docs)))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, queries.tokenizer("piece_bpe_32k.model"))


STAGES = [("toxicity", clean), ("language", identified), ("near_duplicates", distinct), ("mixing", to_weight), ("pieces", as_pieces)]

#: No stage can be written in SQL: three need fitted models or hashes that SQL lacks, and pieces need a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
