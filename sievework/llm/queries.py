"""The queries op1 to op10: each operator over its whole table, with production parameters."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.jaccard_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), n=3, threshold=Fraction(9, 10)).select("doc_id", "n_shingles", "component_id")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.context_mixing import scores

    return scores(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sievework.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.common import fold_of, text_bytes
    from sievework.llm.language_id import learn, predict

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold_of("doc_id", 3) != 1), tokenizer("piece_bpe_32k.model"))
    found = predict(docs.select("doc_id", text_bytes()), model)
    return found.select(F.col("row").alias("doc_id"), (fold_of("row", 3) == 1).alias("held_out"), "lang_pred", "score")


#: Rules of op3.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Hosts whose URLs are listed one by one.
SPAM_HOSTS = "spam|pills|casino"


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed one by one are the URLs that were found on hosts of spam: a list that grows with the pages."""
    from sievework.llm.url_filter import host_of, judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, pages.select("url").where(host_of(F.col("url")).rlike(SPAM_HOSTS)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.quality import judged

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"), 40)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_context_mixing, op2_byte_bpe, op4_language_id, op3_url_filter, op5_packing, op6_quality_rules, op7_sharding, op8_exact_dedup, op9_ngram_jaccard, op10_license_scan)}

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id, rid) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d"""

ORACLES = {"op8_exact_dedup": OP8_SQL}
