"""Cleaning a corpus: quality rules, language, exact copies, near copies, then packing into windows.

Each stage takes the documents that the one before kept and gives those that it keeps, with the same
columns; the last gives pieces of packed windows. ``run`` writes each stage's output to the shared folder
and reads it again. Rows of the last stage have the columns of the packing operator: doc_id, start,
length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts fail the quality rules; an empty
table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import exact_dedup, jaccard_join, language_id, packing, quality
from sievework.llm.common import cut, scratch
from sievework.llm.queries import table, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.in_known_language(docs, tokenizer("piece_bpe_32k.model"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, n=5, threshold=Fraction(4, 5))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", languages), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("packing", windows)]
#: No stage but the first could be written in SQL: the whole is tested against its operators one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as tmp:
        for name, stage in STAGES[:-1]:
            docs = tmp.table(stage(spark, docs, sf_dir), name)
        return cut(STAGES[-1][1](spark, docs, sf_dir))
