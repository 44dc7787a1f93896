"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmentry.llm.common import stored, table
from segmentry.llm.decontaminate import without_benchmark
from segmentry.llm.mixing import mixed
from segmentry.llm.quality import keep_good
from segmentry.llm.shingles import keep_one
from segmentry.llm.tokens import token_files

STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(spark, stage(spark, docs, sf_dir), name)
    return docs


#: SQL cannot express the classifier or the linked components; tests hold each stage against brute force.
ORACLE_SQL = None
