"""A training corpus from raw documents: quality rules, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of `documents`. Every stage's rows are written as Parquet and read again.

quality_rules drops what the base rules or a proven cutoff reject: null and empty texts among them.
language drops texts without a letter and those that no language fits. near_duplicates keeps one row of
each group of texts with 0.8 or more of their five-word shingles in common: that of the smallest doc_id,
nulls last; rows repeated as a whole are one group. packing lays the ids of all that is left out in
batches. Null ids stay rows like any others, extra columns pass the first three stages, whatever their
names, and an empty table gives an empty result in each. Very long texts are kept whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, lang_ppm, near, packing, quality
from veilspark.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.admit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_ppm.admit(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.admit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.default_tokenizer())


STAGES = [("quality_rules", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]
#: No SQL can express the near duplicates' components, the language model or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
