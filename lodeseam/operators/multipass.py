"""Retrieval in passes: candidates, seeds, graph expansion, context, and a last reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators import fusion, graph, lexical, rerank, semantic
from lodeseam.sources.steps import snapshot

#: With a graph, the graph's feature counts as well.
WEIGHTS = rerank.Weights(graph=0.10)


def _merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each chunk's best raw score of two passes, ranked anew."""
    both = first.select("query_id", "chunk_id", "score").unionByName(second.select("query_id", "chunk_id", "score"))
    best = both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.lit(None).cast("int"))


def context(queries: DataFrame, expansions: DataFrame, chunks: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(query_id, query): the query followed by what its expansions say, in order, cut at ``max_chars``."""
    blank = lambda c: F.when(c != "", c)
    about = chunks.select("chunk_id", F.concat_ws(" ", blank(F.col("symbol_name")), blank(F.col("file_path")), blank(F.col("docstring")), "imports", "calls", blank(F.left("code", F.lit(1000)))).alias("says"))
    told = expansions.withColumn("chunk_id", F.regexp_replace("node_id", "^symbol::", "")).join(about, "chunk_id")
    told = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hops", "chunk_id", "seed", "says"))).alias("s"))
    text = F.concat_ws("\n", F.btrim("query"), F.transform("s", lambda x: x["says"]))
    return queries.join(told, "query_id").select("query_id", F.left(text, F.lit(max_chars)).alias("query"))


def search(index: lexical.LexicalIndex, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = 10, candidate_k: int = 50, seed_k: int = 10, context_candidate_k: int = 25, max_graph_hops: int = 3, max_graph_candidates: int = 100, max_context_chars: int = 4000, weights: rerank.Weights = WEIGHTS, embedder=semantic.embed) -> tuple[DataFrame, DataFrame]:
    """(results, report) for a batch of queries (query_id, query).

    1: both channels, fused.  2: reranked, the best are seeds.  3: the graph around them.
    4: both channels for the query with what the graph found; raw scores merge with those of
    pass 1 and are normalised anew; graph hits that no channel has come with zeros.  5: all
    reranked for the query itself.  The report counts candidates, seeds, expansions, chunks
    that context and graph added, and results, by query.
    """
    blocks = semantic.pack(vectors)  # for both passes
    channels = lambda q, k: (snapshot(lexical.search(index, q, k)), snapshot(semantic.search(blocks, snapshot(embedder(q, "query_id", F.col("query"))), k)))
    lex, sem = channels(queries, candidate_k)
    first = snapshot(fusion.fuse(lex, sem, chunks))
    seeds = snapshot(rerank.rerank(first, queries, chunks, seed_k, weights))
    near = graph.expand(nodes, edges, seeds.select("query_id", graph.symbol_node(F.col("chunk_id")).alias("node_id"), F.col("rank").alias("position")), max_graph_hops, max_graph_candidates) if max_graph_candidates else None
    if near is None:
        everything = first
        near = seeds.limit(0).select("query_id", F.lit("").alias("node_id"), F.lit(0.0).alias("graph_score"))
    else:
        near = snapshot(near)
        told = snapshot(context(queries, near, chunks, max_context_chars))
        lex2, sem2 = channels(told, context_candidate_k)
        everything = fusion.fuse(_merged(lex, lex2), _merged(sem, sem2), chunks)
    scores = near.select("query_id", F.regexp_replace("node_id", "^symbol::", "").alias("chunk_id"), "graph_score").groupBy("query_id", "chunk_id").agg(F.max("graph_score").alias("graph_score"))
    full = everything.select("query_id", "chunk_id", "normalized_lexical", "normalized_semantic").join(scores, ["query_id", "chunk_id"], "full_outer").na.fill(0.0)
    full = snapshot(full)
    results = rerank.rerank(full, queries, chunks, top_k, weights)
    tally = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    added = full.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    report = queries.select("query_id")
    for df, name in ((first, "pass1"), (seeds, "seeds"), (near, "expansions"), (added, "added"), (full, "pass5")):
        report = report.join(tally(df, name), "query_id", "left")
    return results, report.na.fill(0)
