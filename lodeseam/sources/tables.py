"""Stored tables: chunks as JSON lines, and indexes as Parquet with a checked meta row."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.operators.lexical import LexicalIndex
from lodeseam.schema import CHUNK


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines: blank lines are ignored, missing fields are null, and a malformed line raises ValueError with its file and text.

    The files are scanned for malformed lines once, before the DataFrame is returned.
    """
    lines = spark.read.schema(T.StructType([*CHUNK, T.StructField("malformed", T.StringType())])).option("columnNameOfCorruptRecord", "malformed").json(path)
    bad = lines.select("malformed", "chunk_id", F.input_file_name().alias("file")).where("malformed is not null").first()
    if bad is not None:
        name = unquote(bad.file.removeprefix("file://"))
        place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("place")
        said = spark.read.text(bad.file).select(place, "value")
        first = said.where(F.col("value") == bad.malformed).agg(F.min("place").alias("first"))
        at = said.join(F.broadcast(first), F.col("place") <= F.col("first")).count()
        raise ValueError(f"{name}:{at}: malformed line: {bad.malformed[:200]}")
    return spark.read.schema(CHUNK).json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, warnings: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("warnings", warnings)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, warnings); nodes that repeat and edges that end at none raise ValueError."""
    nodes, edges, warnings = (spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "warnings"))
    if not nodes.groupBy("node_id").count().where("count > 1").isEmpty():
        raise ValueError("the graph has nodes that repeat")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    if not ends.join(nodes.select("node_id"), "node_id", "left_anti").isEmpty():
        raise ValueError("the graph has edges that end at no node")
    return nodes, edges, warnings


def save_lexical(index: LexicalIndex, path: str) -> None:
    """The index's four tables; postings lie sorted by term, so that a query's terms prune row groups."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    index.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    meta = index.corpus_stats.withColumns({"k1": F.lit(index.k1), "b": F.lit(index.b), "format_version": F.lit(2)})
    meta.write.mode("overwrite").parquet(f"{path}/corpus_stats")


def load_lexical(spark: SparkSession, path: str) -> LexicalIndex:
    """The stored index; an unknown format, bad parameters or a wrong count of documents raise ValueError."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("postings", "doc_stats", "term_stats", "corpus_stats")}
    meta = tables["corpus_stats"].first()
    if meta.format_version != 2 or tables["doc_stats"].count() != meta.n:
        raise ValueError("not a lexical index of format 2, or incomplete")
    return LexicalIndex(tables["postings"], tables["doc_stats"], tables["term_stats"], tables["corpus_stats"].select("n", "avgdl"), meta.k1, meta.b)


def save_vectors(vectors: DataFrame, path: str, model: str) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    meta = stored.agg(F.count("*").alias("count"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"))
    meta.withColumns({"model": F.lit(model), "metric": F.lit("cosine")}).write.mode("overwrite").parquet(f"{path}/meta")


def load_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The stored vectors; another model, count or dimension raises ValueError."""
    meta, vectors = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/vectors")
    if meta.model != model or meta.metric != "cosine":
        raise ValueError(f"vectors of model {meta.model}, not {model}")
    if vectors.count() != meta["count"] or not vectors.where(F.size("vector") != meta.dimension).isEmpty():
        raise ValueError("vectors are incomplete or differ in dimension")
    return vectors
