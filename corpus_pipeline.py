"""The corpus pipeline: stages over documents, each an operator of linkloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.stages import STAGES
from linkloom.llm.store import Tables

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and reread."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    before = None
    for name, stage in STAGES[:-1]:
        after = tables.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            tables.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
