"""Min-max normalisation and fusion of lexical and semantic results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.operators import lexical, semantic
from lodeseam.operators.lexical import ranked
from lodeseam.schema import not_negative


def minmax(score: Column, by="query_id") -> Column:
    """Scores of a list from 0 to 1; if all are equal, 1."""
    window = Window.partitionBy(*([by] if isinstance(by, str) else by))
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def dedupe(results: DataFrame, metadata: list[str] | None = None, by=("query_id", "chunk_id")) -> DataFrame:
    """One row per query and chunk, of the highest score; rows of one chunk that differ in ``metadata`` raise an error."""
    others = [c for c in results.columns if c not in by]
    best = F.max_by(F.struct(*others), F.struct("score", *[c for c in others if c == "rank"]))
    kinds = F.count_distinct(F.to_json(F.struct(*metadata))) if metadata else F.lit(1)
    out = results.groupBy(*by).agg(best.alias("best"), kinds.alias("kinds"))
    checked = F.when(F.col("kinds") > 1, F.raise_error(F.lit("rows of one chunk differ"))).otherwise(F.col("best"))
    return out.withColumn("best", checked).select(*by, "best.*")


def fuse(lexical_results: DataFrame, semantic_results: DataFrame, chunks: DataFrame, lexical_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """All candidates of both lists with raw and normalised scores, ranks and the fused score; ``chunks`` gives path and line.

    A channel that lacks a candidate counts 0, and so does a list's lowest score.
    """
    not_negative(lexical_weight=lexical_weight, semantic_weight=semantic_weight)
    total = lexical_weight + semantic_weight
    if total <= 0:
        raise ValueError("one of the weights must be positive")
    side = lambda r, name: r.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), minmax(F.col("score")).alias(f"normalized_{name}"))
    both = side(lexical_results, "lexical").join(side(semantic_results, "semantic"), ["query_id", "chunk_id"], "full_outer")
    both = both.na.fill(0.0, ["normalized_lexical", "normalized_semantic"])
    score = (lexical_weight * F.col("normalized_lexical") + semantic_weight * F.col("normalized_semantic")) / total
    return both.withColumn("score", score).join(chunks.select("chunk_id", "file_path", "start_line"), "chunk_id")


def hybrid(index, vectors: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = 10, candidate_k: int = 50, lexical_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """The best of both channels, ``candidate_k`` from each; queries are (query_id, query, vector)."""
    found = fuse(lexical.search(index, queries, candidate_k), semantic.search(vectors, queries, candidate_k), chunks, lexical_weight, semantic_weight)
    return ranked(found, top_k)
