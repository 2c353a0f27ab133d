"""From documents to encoded, clean, distinct documents: five stages, each written as Parquet and read again.

All stages: a null doc_id is an id like any other that stands last; null and empty texts are documents; texts of any length count whole; repeated rows are
rows each until near_duplicates; an empty table gives no rows; all columns pass through the first four stages, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontam, linededup, pieces, quality, setdup
from plinth.llm.common import checkpoint_dir, table
from plinth.llm.queries import piece_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go. Null and empty texts get a score like any other; repeated rows share their fate."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or differ from one by a word, go; every document stays, null texts as null, emptied ones as empty. Of ties the line of
    the smallest doc_id, first row and first place stays; of repeated rows the first keeps its lines."""
    return linededup.dedup_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles from 0.8 on) the document with the smallest doc_id stays, of equal ids the first
    row. Null, empty and blank texts are copies of each other."""
    return setdup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages on a twentieth of their words or more go. Texts without words have none; repeated rows share their fate."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the digests and the number of ids of each document's encoding; null and empty texts have no ids. Repeated rows get a row each."""
    return pieces.digests(docs, piece_model())


STAGES = [("quality", good_quality), ("lines", distinct_lines), ("near_duplicates", distinct_documents), ("decontamination", without_benchmark), ("sentencepiece", encoded)]

#: The learnt model and the merges of the encoding can't be said in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between them is in the cluster's shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
