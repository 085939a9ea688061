"""Candidate spans: the width-limited grid, and the pool from start and end scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boundaries kept, pairs guaranteed to each query, candidates kept, lift of guaranteed pairs.
TOP, QUOTA, POOL, LIFT = 32, 8, 192, 5000.0
MASKED = -5000.0


def grid(n: Column, width: int) -> Column:
    """array<struct<start,end>> of all spans of up to ``width`` tokens, half-open."""
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(width), n - i)), lambda w: F.struct(i.alias("start"), (i + w).alias("end")))))


def top_boundaries(marginals: DataFrame, score: str, k: int = TOP) -> DataFrame:
    """(doc_id, pos, score, rank): the k places of each document with the highest score of any query."""
    best = marginals.groupBy("doc_id", "pos").agg(F.max(score).alias(score))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(score), "pos"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def pairs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """All (start, end) of a document with end after start, with the ranks of both."""
    s = starts.select("doc_id", F.col("pos").alias("start"), F.col("start_logit").alias("us"), F.col("rank").alias("s_rank"))
    e = ends.select(F.col("doc_id").alias("d"), F.col("pos").alias("end"), F.col("end_logit").alias("ue"), F.col("rank").alias("e_rank"))
    return s.join(e, (s["doc_id"] == e["d"]) & (e["end"] > s["start"])).drop("d")


def pool(marginals: DataFrame, k: int = TOP, quota: int = QUOTA, cap: int = POOL) -> DataFrame:
    """(doc_id, start, end, pool_score, slot) from (doc_id, query, pos, start_logit, end_logit).

    Each query is guaranteed its ``quota`` best pairs, above all others; then pairs by the sum of the
    best start and end scores of any query; the best entry of each pair counts; ``cap`` are kept.
    """
    both = pairs(top_boundaries(marginals, "start_logit", k), top_boundaries(marginals, "end_logit", k))
    s = marginals.select("doc_id", "query", F.col("pos").alias("start"), "start_logit")
    e = marginals.select("doc_id", "query", F.col("pos").alias("end"), "end_logit")
    of_query = both.join(s, ["doc_id", "start"]).join(e, ["doc_id", "query", "end"])
    own = F.row_number().over(Window.partitionBy("doc_id", "query").orderBy(F.desc(F.col("start_logit") + F.col("end_logit")), "s_rank", "e_rank"))
    wanted = of_query.withColumn("r", own - 1).where(F.col("r") < quota)
    entries = wanted.select("doc_id", "start", "end", (F.lit(LIFT) + quota - F.col("r")).alias("pool_score"), F.struct(F.lit(0).alias("a"), F.col("query").cast("int").alias("b"), F.col("r").alias("c")).alias("entry"))
    rest = both.select("doc_id", "start", "end", (F.col("us") + F.col("ue")).alias("pool_score"), F.struct(F.lit(1).alias("a"), F.col("s_rank").alias("b"), F.col("e_rank").alias("c")).alias("entry"))
    best = entries.unionByName(rest).groupBy("doc_id", "start", "end").agg(F.max("pool_score").alias("pool_score"), F.min_by("entry", F.struct(-F.col("pool_score"), "entry")).alias("entry"))
    slot = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("pool_score"), "entry")) - 1
    return best.withColumn("slot", slot).where(F.col("slot") < cap).drop("entry")


def interval_scores(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, query, start, end, inside): sum of token scores over each span by root of its length, from prefix sums.

    tokens: doc_id, query, pos, score. spans: doc_id, start, end.
    """
    w = Window.partitionBy("doc_id", "query").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = tokens.select("doc_id", "query", (F.col("pos") + 1).alias("pos"), F.sum("score").over(w).alias("sum"))
    ends = spans.join(sums.withColumnRenamed("pos", "end"), ["doc_id", "end"]).withColumnRenamed("sum", "upper")
    starts = sums.select(F.col("doc_id").alias("d"), F.col("query").alias("q"), F.col("pos").alias("p"), F.col("sum").alias("lower"))
    met = ends.join(starts, (F.col("doc_id") == F.col("d")) & (F.col("query") == F.col("q")) & (F.col("start") == F.col("p")), "left")
    return met.select("doc_id", "query", "start", "end", ((F.col("upper") - F.coalesce("lower", F.lit(0.0))) / F.sqrt(F.greatest(F.col("end") - F.col("start"), F.lit(1)))).alias("inside"))
