"""A corpus pipeline of five stages over documents; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import decontaminate, mixing, ngram_join, quality, store
from verdigris.llm.shared import work_dir, written

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("token-ID / binary output", store.stage),
]

#: Ids of a public tokenizer cannot be had in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), work_dir(spark, "stage"))
    return STAGES[-1][1](spark, docs, sf_dir)
