"""Reranking of candidates by nine features of query and chunk."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.similarity import set_ratio
from lodeseam.functions.text import metadata_text, names_identifier, query_language, tokenize
from lodeseam.operators.lexical import ranked

# For each role, the words of a query that call for it, and the terms expected of a chunk.
ROLES = (
    (
        (
            "auth", "authentication", "authorize", "authorization", "token", "jwt", "protected", "validate",
            "validation", "verify", "verified", "permission",
        ),
        (
            "auth", "authentication", "authenticate", "authorization", "authorize", "middleware", "token", "jwt",
            "validate", "validation", "verify", "permission", "protected", "claims", "credential",
        ),
    ),
    (
        (
            "payment", "charge", "billing", "card", "transaction", "refund",
        ),
        (
            "payment", "payments", "charge", "card", "billing", "transaction", "refund", "invoice",
        ),
    ),
    (
        (
            "database", "db", "query", "sql", "connection", "pool",
        ),
        (
            "database", "db", "query", "sql", "connection", "pool", "execute", "cursor", "commit",
        ),
    ),
    (
        (
            "image", "resize", "upload", "storage", "file", "thumbnail",
        ),
        (
            "image", "resize", "upload", "storage", "file", "thumbnail", "bucket", "compress",
        ),
    ),
    (
        (
            "password", "hash", "hashed", "credential", "credentials",
        ),
        (
            "password", "hash", "hashed", "credential", "credentials", "salt", "digest", "encrypt",
        ),
    ),
    (
        (
            "normalize", "normalization", "sanitize", "parse", "transform", "convert",
        ),
        (
            "normalize", "normalization", "sanitize", "parse", "transform", "convert", "clean", "format",
        ),
    ),
)


# What each feature weighs.
@dataclass(frozen=True)
class Weights:
    semantic: float = 0.25
    lexical: float = 0.25
    exact_symbol: float = 0.10
    filename: float = 0.075
    language: float = 0.025
    intent: float = 0.10
    metadata: float = 0.15
    dependency: float = 0.05
    graph: float = 0.0

    def __post_init__(self):
        values = asdict(self).values()
        if min(values) < 0 or sum(values) <= 0:
            raise ValueError("weights must not be negative, nor all zero")


def expected_terms(query_tokens: Column) -> Column:
    """The terms expected by all roles that a query's words call for."""
    words = lambda terms: F.array(*map(F.lit, terms))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(F.arrays_overlap(query_tokens, words(calls)), words(terms)).otherwise(none) for calls, terms in ROLES)))


def features(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``candidates`` (query_id, chunk_id, normalized_lexical, normalized_semantic, graph_score if there) with a column per feature, and signals."""
    asked = queries.select("query_id", "query", F.array_distinct(tokenize(F.col("query"))).alias("q"), query_language(F.col("query")).alias("asked_language"))
    asked = asked.withColumn("expected", expected_terms(F.col("q")))
    about = ["chunk_id", "file_path", "language", "symbol_name", "symbol_type", "docstring", "class_name", "parent_symbol", "imports", "calls", "start_line"]
    known = chunks.select(*about).withColumnsRenamed({"language": "chunk_language"})
    rows = candidates.select("query_id", "chunk_id", "normalized_lexical", "normalized_semantic", F.coalesce(F.col("graph_score"), F.lit(0.0)).alias("graph_score") if "graph_score" in candidates.columns else F.lit(0.0).alias("graph_score"))
    rows = rows.join(asked, "query_id").join(known, "chunk_id")
    tokens = lambda text: F.array_distinct(tokenize(text))
    column = lambda n: F.col("chunk_language") if n == "language" else F.col(n)
    rows = rows.withColumns(
        {
            "m": tokens(metadata_text(column)),
            "file_terms": F.array_intersect("q", tokens(F.col("file_path"))),
            "dependency_terms": F.array_intersect("q", tokens(F.concat_ws(" ", "imports", "calls"))),
            "says_symbol": names_identifier(F.col("query"), F.col("symbol_name")),
            "speaks": F.coalesce(F.lower("chunk_language") == F.lower("asked_language"), F.lit(True)),
        }
    )
    rows = rows.withColumns({"metadata_terms": F.array_intersect("q", "m"), "role_terms": F.array_intersect("expected", "m")})
    said = lambda label, terms: F.when(F.size(terms) > 0, F.concat(F.lit(f"{label} terms matched: "), F.array_join(F.array_sort(terms), ", ")))
    language = F.when(F.col("asked_language").isNull(), "Query does not specify a programming language").when(F.col("speaks"), F.concat(F.lit("Requested language matches: "), "chunk_language"))
    language = language.otherwise(F.concat(F.lit("Requested language does not match: "), "chunk_language", F.lit(" (query asks for "), "asked_language", F.lit(")")))
    signals = F.array(
        F.when(F.col("says_symbol"), F.concat(F.lit("Exact symbol name appears in query: "), "symbol_name")), said("Filename", "file_terms"), language,
        said("Function-role", "role_terms"), said("Metadata", "metadata_terms"), said("Import/call", "dependency_terms"),
    )
    return rows.select(
        "query_id", "chunk_id", "file_path", "start_line",
        F.col("normalized_semantic").alias("semantic"), F.col("normalized_lexical").alias("lexical"), F.col("says_symbol").cast("double").alias("exact_symbol"),
        set_ratio(F.col("file_terms"), F.col("q")).alias("filename"), F.col("speaks").cast("double").alias("language"), set_ratio(F.col("role_terms"), F.col("expected")).alias("intent"),
        set_ratio(F.col("metadata_terms"), F.col("q")).alias("metadata"), set_ratio(F.col("dependency_terms"), F.col("q")).alias("dependency"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), "graph_score")).alias("graph"), F.array_compact(signals).alias("signals"),
    )


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 10, weights: Weights = Weights()) -> DataFrame:
    """The ``top_k`` candidates of each query by the weighted mean of their features."""
    rated = features(candidates, queries, chunks)
    parts = asdict(weights)
    score = sum((F.lit(w) * F.col(name) for name, w in parts.items()), F.lit(0.0)) / sum(parts.values())
    return ranked(rated.withColumn("score", score), top_k)
