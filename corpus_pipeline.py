"""From documents to packed sequences: quality rules, near duplicates, repeated passages, source mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborframe.llm import host_quality, mixing, ngram_jaccard, packing, suffix_dedup
from arborframe.llm._store import only, removed, written

STAGES = [
    ("quality", host_quality.good_documents),
    ("near_duplicates", ngram_jaccard.first_of_group),
    ("repeated_passages", suffix_dedup.without_repeats),
    ("mixture", mixing.mixed),
    ("packing", packing.packed),
]
#: Repeated passages, raking and packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each but the last is written, and read again by the next. What a stage wrote besides is deleted when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with only(spark) as keep:
            after = written(stage(spark, docs, sf_dir))
            keep.append(after)
        removed(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
