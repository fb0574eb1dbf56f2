"""The corpus pipeline: toxicity, line deduplication, near-duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm import decontaminate, line_dedup, near_dedup, piece_bpe, toxicity
from clinspark.llm.common import table, written
from clinspark.llm.queries import tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. The model is learned from the labelled documents of the tables."""
    model = toxicity.fit(toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return model.score_documents(docs, out="__toxicity").where(F.col("__toxicity") < 0.5).drop("__toxicity")


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sources go from the documents that carry them; n_chars follows the text."""
    out = line_dedup.remove_boilerplate(spark, docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.deduplicate(spark, docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids of what is left; the ids decode to the text again."""
    out = piece_bpe.encode_decode(docs, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull()).alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_boilerplate),
    ("simhash_near_dedup", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("sentencepiece", encode),
]

#: SQL can't express the learned grammar, the fingerprints' groups or the merge encoding; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
