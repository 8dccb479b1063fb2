"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hnsw, lang_ppm, lm_score, packing, quality, sharding, simhash, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.default_tokenizer())


def op2_lang_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_ppm.predict(table(spark, sf_dir, "documents"), "doc_id")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.render(chat.from_table(rows)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hnsw.usable(table(spark, sf_dir, "embeddings"))
    return hnsw.search(rows, rows.filter("vec_id % 100 = 0"), 10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_digest(table(spark, sf_dir, "documents"), bpe.default_tokenizer())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.default_tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_lang_ppm, op3_chat, op4_simhash, op5_sharding, op6_lm_score, op7_hnsw, op8_quality, op9_token_files, op10_packing, pipeline)}
ORACLES: dict[str, str] = {"op3_chat": chat.ORACLE, "op8_quality": quality.ORACLE}
