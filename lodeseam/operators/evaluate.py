"""NDCG@10 and reciprocal rank of ranked results against graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(results: DataFrame, judgements: DataFrame, cutoff: int = 10) -> DataFrame:
    """(query_id, ndcg, rr) for every query with a judgement.

    ``results`` are (query_id, rank, chunk_id), ``judgements`` (query_id, chunk_id, grade).
    Gains are 2**grade - 1, discounted by log2(rank + 1); the ideal order is by grade; a query
    whose grades are all 0 has NDCG 0.  The reciprocal rank looks at all ranks, NDCG at the
    first ``cutoff``.
    """
    gain = lambda grade, rank: (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id"))
    best = judgements.withColumn("place", place).where(F.col("place") <= cutoff)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    met = results.join(judgements, ["query_id", "chunk_id"]).groupBy("query_id")
    met = met.agg(F.sum(F.when(F.col("rank") <= cutoff, gain(F.col("grade"), F.col("rank")))).alias("dcg"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"))
    ratio = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return ideal.join(met, "query_id", "left").select("query_id", ratio.alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary(per_query: DataFrame) -> DataFrame:
    """One row: the number of queries and the means."""
    return per_query.agg(F.count("*").alias("cases"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"))
