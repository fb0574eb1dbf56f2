"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinspark.llm import ann, decontaminate, fill_middle, line_dedup, piece_bpe, quantised, sharding, simhash, spelling, token_count, token_output, toxicity, url_filter
from clinspark.llm.common import table


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.op1(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op2(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op3(spark, table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op4(spark, table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5(spark, table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6(spark, table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.op7(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.op8(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op10(spark, table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.op11(spark, table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12(spark, table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.op13(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_decontamination": op2_decontamination,
        "op3_line_dedup": op3_line_dedup,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_sharding": op5_sharding,
        "op6_simhash": op6_simhash,
        "op7_token_output": op7_token_output,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_url_filter": op10_url_filter,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_embedding_dedup": op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE, "op10_url_filter": url_filter.ORACLE}
