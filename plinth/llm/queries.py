"""The queries of this folder: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontam, linededup, merkle, neardup, pieces, quality, repeats, secrets, sharding, spelling, topk, toxicity, urlfilter
from plinth.llm.common import table
from plinth.llm.oracles import DECONTAMINATION, LINE_DEDUP, MERKLE, REPEATS, SPELLING, TOP_K, URL_FILTER


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.uniform_shards(table(spark, d, "documents"))


def op3_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.digests(table(spark, d, "documents"), piece_model())


def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return urlfilter.judge(pages, urlfilter.page_outcomes(pages, table(spark, d, "labels"))).drop("bad_rate", "bad_rate_low")


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("hits")


def op6_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, d, "documents"))


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"))


def op8_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.every_fiftieth(table(spark, d, "embeddings"))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return linededup.line_report(table(spark, d, "documents"))


def op11_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return repeats.report(table(spark, d, "documents"))


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


def op13_merkle(spark: SparkSession, d: str) -> DataFrame:
    return merkle.report(table(spark, d, "documents"), merkle.changed())


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_sharding, op3_sentencepiece, op4_url_filter, op5_decontamination, op6_secrets, op7_simhash, op8_topk, op9_toxicity, op10_line_dedup, op11_substring_dedup, op12_spelling, op13_merkle, pipeline)}


def oracle_sql() -> dict[str, str]:
    """Only for what SQL can say over whole tables: hashes by word, learnt models, random permutations and byte-pair merges are tested against
    brute force in tests/llm instead."""
    return {"op4_url_filter": URL_FILTER, "op5_decontamination": DECONTAMINATION, "op8_topk": TOP_K, "op10_line_dedup": LINE_DEDUP, "op11_substring_dedup": REPEATS, "op12_spelling": SPELLING, "op13_merkle": MERKLE}
