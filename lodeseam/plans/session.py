"""The facade: repositories indexed as tables below one folder, searched, explored, compared and evaluated."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseam.operators import evaluate, fusion, graph, lexical, multipass, rerank, semantic, versions
from lodeseam.schema import CHUNK, checked
from lodeseam.sources import git, log, tables, tree
from lodeseam.sources.steps import snapshot


class NotFound(KeyError):
    """No such repository, version or chunk."""


#: Calls whose catalog rows lie in folders of their own before they are written together.
FOLDERS = 32

METHODS = ("auto", "bm25", "semantic", "hybrid", "reranked", "multi_pass")
MODEL = "feature-hash-256"


class Engine:
    """Tables of each repository lie in ``home/repository_id``; ``home`` is a path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, home: str, read_only: bool = False):
        self.spark, self.home, self.read_only = spark, home.rstrip("/"), read_only

    # -- catalog -------------------------------------------------------------------------
    _RECORD = "repository_id string, name string, path string, chunks long, semantic boolean, graph boolean, versions boolean"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def repositories(self) -> DataFrame:
        """All repositories with the methods that their tables allow, by name."""
        catalog = f"{self.home}/repositories"
        saved = self.spark.read.schema(f"{self._RECORD}, saved long").json(catalog) if self._exists(catalog) else self.spark.createDataFrame([], f"{self._RECORD}, saved long")
        names = [c for c in saved.columns if c not in ("repository_id", "saved")]
        rows = saved.groupBy("repository_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("saved"))).alias(c) for c in names)).na.fill(0, ["chunks"]).na.fill(False, ["semantic", "graph", "versions"])
        has = lambda flag, *names: F.when(flag, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
        methods = F.concat(F.array(F.lit("bm25")), has(F.col("semantic"), "semantic", "hybrid", "reranked"), has(F.col("semantic") & F.col("graph"), "multi_pass"), has(F.col("versions"), "version_search"))
        return rows.withColumn("available_methods", methods).orderBy(F.lower("name"))

    def _record(self, selector: str | None):
        rows = self.repositories()
        if selector is not None:
            s = F.lit(selector)
            rows = rows.where((F.col("repository_id") == s) | (F.lower("name") == F.lower(s)) | F.col("path").isin(selector, str(Path(selector).resolve())))
        found = rows.limit(2).collect()
        if not found:
            raise NotFound(f"no repository {selector}")
        if len(found) > 1:
            raise ValueError("several repositories: name one")
        return found[0]

    def _save_record(self, record: dict) -> None:
        """Append what is new of a repository; of each field the last value counts, so writers of different fields lose nothing of each other's."""
        row = self.spark.createDataFrame([json.dumps(record | {"saved": time.time_ns()})], "string")
        row.coalesce(1).write.mode("append").text(f"{self.home}/repositories")

    def _known(self, key: str) -> bool:
        return not self.repositories().where(F.col("repository_id") == key).isEmpty()

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("this engine only reads")

    # -- indexing ------------------------------------------------------------------------
    def index_repository(self, path: str, name: str | None = None, with_semantic: bool = True, with_graph: bool = True) -> list[str]:
        """Index the source tree at ``path``; the warnings.

        A graph or vectors that can't be made cost a warning, not the index.
        """
        self._writable()
        path = str(Path(path).resolve())
        chunks, warnings = tree.index_tree(self.spark, path)
        key = tree.repository_id(path)
        base = f"{self.home}/{key}"
        chunks.write.mode("overwrite").parquet(f"{base}/chunks")
        rows = self.spark.read.schema(CHUNK).parquet(f"{base}/chunks")
        tables.save_lexical(lexical.build(rows), f"{base}/lexical")
        count = rows.count()
        if with_semantic and count:
            tables.save_vectors(semantic.build(rows), f"{base}/semantic", MODEL)
        if with_graph:
            tables.save_graph(*graph.build(rows), graph.unresolved(rows), f"{base}/graph")
        self._save_record({"repository_id": key, "name": name or path.rstrip("/").rsplit("/", 1)[-1], "path": path, "chunks": count, "semantic": bool(with_semantic and count), "graph": with_graph})
        return [r.warning for r in warnings.collect()]

    def index_versions(self, path: str, revisions: dict[str, str | None], with_semantic: bool = True) -> DataFrame:
        """Index Git revisions by label (without a revision, the label is one), each a version of its own, beside those that are there; all versions.

        A commit that is indexed stays as it is; a label of another commit raises ValueError.
        Chunks and vectors are written by version before the catalog names them, so what a
        failed call leaves is overwritten by the next.
        """
        self._writable()
        path = git.root_of(path)
        key = tree.repository_id(path)
        base = f"{self.home}/{key}/versions"
        known = self._labels(base)
        found, files, chunks = git.index_versions(self.spark, path, revisions, known)
        chunks = snapshot(chunks)
        by_version = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(f"{base}/{name}")
        by_version(chunks, "chunks")
        if with_semantic:
            by_version(semantic.build(chunks).join(chunks.select("version_id", "chunk_id"), "chunk_id"), "vectors")
        counted = found.join(files, "version_id", "left").join(chunks.groupBy("version_id").agg(F.count("*").alias("number_of_chunks")), "version_id", "left")
        catalog = counted.na.fill(0, ["number_of_files", "number_of_chunks"]).withColumn("model_name", F.when((F.col("number_of_chunks") > 0) & F.lit(with_semantic), MODEL))
        self._commit_versions(base, snapshot(catalog))
        self._save_record({"repository_id": key, "versions": True} | ({} if self._known(key) else {"name": path.rsplit("/", 1)[-1], "path": path}))
        return self.versions(key)

    def _labels(self, base: str) -> dict[str, str]:
        """Labels of the indexed commits; a log entry holds one a version."""
        return (log.last(self.spark, f"{base}/log")[1] or {"labels": {}})["labels"]

    def _commit_versions(self, base: str, rows: DataFrame) -> None:
        """Add versions to the catalog: a log entry names all labels and the folders of all rows, and is written only if its number is free.

        If another writer was faster, its versions are read, labels are checked against them, and the next number is tried. Rows of
        over FOLDERS calls are written together.
        """
        mine = {r.version_id: r.version_label for r in rows.select("version_id", "version_label").collect()}  # named by the call
        while True:
            number, state = log.last(self.spark, f"{base}/log")
            state = state or {"labels": {}, "rows": []}
            fresh = {v: label for v, label in mine.items() if v not in state["labels"]}
            if taken := set(fresh.values()) & set(state["labels"].values()):
                raise ValueError(f"labels of another version: {', '.join(sorted(taken))}")
            if not fresh and number:
                return
            named = rows.join(self.spark.createDataFrame([(v,) for v in fresh], "version_id string"), "version_id", "left_semi").select(rows.columns)
            added = named.withColumn("position", (F.row_number().over(Window.orderBy("position")) + len(state["labels"]) - 1).cast("int"))  # a row a version of this call
            folders = state["rows"]
            if len(folders) >= FOLDERS:
                added, folders = added.unionByName(self.spark.read.parquet(*(f"{base}/catalog/{f}" for f in folders))), []
            folder = uuid.uuid4().hex
            added.coalesce(1).write.parquet(f"{base}/catalog/{folder}")
            if log.append(self.spark, f"{base}/log", number + 1, {"labels": state["labels"] | fresh, "rows": [*folders, folder]}):
                return

    def _catalog(self, base: str) -> DataFrame:
        _, state = log.last(self.spark, f"{base}/log")
        if state is None:
            raise NotFound("no versions are indexed")
        return self.spark.read.parquet(*(f"{base}/catalog/{f}" for f in state["rows"]))

    def versions(self, repository: str | None = None) -> DataFrame:
        return self._catalog(f"{self.home}/{self._record(repository).repository_id}/versions")

    def _version_chunks(self, base: str, chosen: DataFrame) -> DataFrame:
        """Chunks of the chosen versions; the filter prunes partitions."""
        ids = [r.version_id for r in chosen.select("version_id").collect()]
        return self.spark.read.schema(CHUNK).parquet(f"{base}/chunks").where(F.col("version_id").isin(ids))

    def _version_vectors(self, base: str, chosen: DataFrame, mode: str) -> DataFrame | None:
        """The vectors of the chosen versions, or None if the mode, or for "auto" the lack of a common model, says lexical."""
        if mode not in ("auto", "bm25", "lexical", "hybrid"):
            raise ValueError(f"versions are searched by auto, bm25 or hybrid, not {mode}")
        models = {r.model_name for r in chosen.select("model_name").collect()}
        able = models == {MODEL}
        if mode == "hybrid" and not able:
            raise ValueError("hybrid search needs vectors of one model in every version")
        return self.spark.read.parquet(f"{base}/vectors").join(chosen.select("version_id"), "version_id", "left_semi") if able and mode in ("auto", "hybrid") else None

    # -- search --------------------------------------------------------------------------
    def _queries(self, queries: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(k, checked("query", q)) for k, q in enumerate(queries)], "query_id int, query string")

    @staticmethod
    def _embedded(asked: DataFrame) -> DataFrame:
        return asked.join(semantic.embed(asked, "query_id", F.col("query")), "query_id")

    def _base(self, record) -> str:
        return f"{self.home}/{record.repository_id}"

    def search(self, queries: list[str], repository: str | None = None, method: str = "auto", top_k: int = 10, candidate_k: int = 50, seed_k: int = 10, context_candidate_k: int = 25, max_graph_hops: int = 3, version: str = "working-tree") -> DataFrame:
        """(query_id, rank, chunk_id, score, ... and the chunk) of a batch of queries.

        ``version`` is the work tree, a version by label, id or beginning of its commit, or "all".
        """
        return self.search_report(queries, repository, method, top_k, candidate_k, seed_k, context_candidate_k, max_graph_hops, version)[0]

    def search_report(self, queries: list[str], repository: str | None = None, method: str = "auto", top_k: int = 10, candidate_k: int = 50, seed_k: int = 10, context_candidate_k: int = 25, max_graph_hops: int = 3, version: str = "working-tree") -> tuple[DataFrame, DataFrame]:
        """search() with a report (query_id, method, total_candidates, latency_ms): one row a query, with the counts of each pass for multi_pass.

        All queries run as one batch, so the latency is the batch's.
        """
        began = time.perf_counter()
        for name, value in (("top_k", top_k), ("candidate_k", candidate_k), ("seed_k", seed_k), ("context_candidate_k", context_candidate_k), ("max_graph_hops", max_graph_hops)):
            checked(name, value)
        if method not in METHODS:
            raise ValueError(f"unknown method {method}")
        asked, report = self._queries(queries), None
        if version != "working-tree":
            found = self.search_versions(queries, repository, None if version == "all" else version, top_k, candidate_k, method)
            found = snapshot(found)
        else:
            record = self._record(repository)
            if method == "auto":
                method = "multi_pass" if record.semantic and record.graph else "reranked" if record.semantic else "bm25"
            if method not in record.available_methods:
                raise ValueError(f"{method} needs tables that this repository lacks")
            found, report = self._found(self._base(record), asked, method, top_k, candidate_k, seed_k, context_candidate_k, max_graph_hops)
            kept = [c for c in found.columns if c in ("query_id", "chunk_id") or c not in CHUNK.names]
            rows = self.spark.read.schema(CHUNK).parquet(f"{self._base(record)}/chunks")
            found = snapshot(found.select(*kept).withColumn("method", F.lit(method)).join(rows, "chunk_id"))
        if report is None:
            counts = found.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
            report = asked.select("query_id").join(counts, "query_id", "left").na.fill(0)
        else:
            report = report.withColumn("total_candidates", F.col("pass5"))
        latency = round(1000 * (time.perf_counter() - began), 3)
        return found.orderBy("query_id", "rank"), report.withColumns({"method": F.lit(method), "latency_ms": F.lit(latency)})

    def _found(self, base: str, asked: DataFrame, method: str, top_k: int, candidate_k: int, seed_k: int, context_candidate_k: int, max_graph_hops: int) -> tuple[DataFrame, DataFrame | None]:
        rows, index = self.spark.read.schema(CHUNK).parquet(f"{base}/chunks"), tables.load_lexical(self.spark, f"{base}/lexical")
        if method == "bm25":
            return lexical.search(index, asked, top_k), None
        vectors, embedded = tables.load_vectors(self.spark, f"{base}/semantic", MODEL), self._embedded(asked)
        if method == "semantic":
            return semantic.search(vectors, embedded, top_k), None
        if method == "hybrid":
            return fusion.hybrid(index, vectors, rows, embedded, top_k, candidate_k), None
        if method == "reranked":
            return rerank.rerank(fusion.hybrid(index, vectors, rows, embedded, candidate_k, candidate_k), asked, rows, top_k), None
        nodes, edges, _ = tables.load_graph(self.spark, f"{base}/graph")
        return multipass.search(index, vectors, nodes, edges, rows, asked, top_k, candidate_k, seed_k, context_candidate_k, max_graph_hops)

    def search_versions(self, queries: list[str], repository: str | None = None, version: str | None = None, top_k: int = 10, candidate_k: int = 50, mode: str = "auto") -> DataFrame:
        """Search within one version, or across all; ``auto`` is hybrid if all of them have vectors of one model, else lexical."""
        base = f"{self._base(self._record(repository))}/versions"
        chosen = versions.select(self._catalog(base), version)
        vectors, rows, asked = self._version_vectors(base, chosen, mode), self._version_chunks(base, chosen), self._queries(queries)
        top_k, candidate_k = checked("top_k", top_k), checked("candidate_k", candidate_k)
        found = versions.search(rows, asked, candidate_k, top_k) if vectors is None else versions.hybrid(rows, vectors, self._embedded(asked), candidate_k, top_k)
        about = rows.select("version_id", "chunk_id", *(c for c in CHUNK.names if c not in found.columns))
        return found.withColumn("retrieval_mode", F.lit("lexical" if vectors is None else "hybrid")).join(about, ["version_id", "chunk_id"]).orderBy("query_id", "rank")

    def compare_versions(self, source: str, target: str, repository: str | None = None, matches_per_chunk: int = 3, min_similarity: float = 0.35, candidate_pool_size: int = 50) -> DataFrame:
        """The most alike chunks of two versions, by label, id or beginning of the commit; without common vectors, names and structure decide."""
        checked("min_similarity", min_similarity), checked("candidate_pool_size", candidate_pool_size)
        base = f"{self._base(self._record(repository))}/versions"
        catalog = self._catalog(base)
        ends = [versions.select(catalog, s) for s in (source, target)]
        if ends[0].first().version_id == ends[1].first().version_id:
            raise ValueError("compare two different versions")
        both = ends[0].unionByName(ends[1])
        vectors = self._version_vectors(base, both, "auto")
        sides = [snapshot(versions.signed(self._version_chunks(base, e)).withColumn("pair_id", F.lit(0))) for e in ends]
        weights = versions.MatchWeights() if vectors is not None else versions.EVOLUTION_WEIGHTS
        found = versions.compare(*sides, both, weights, matches_per_chunk, min_similarity, candidate_pool_size, vectors)
        return found.drop("pair_id").orderBy("s_file_path", "s_chunk_id", F.desc("similarity"), "t_chunk_id")

    def evolve(self, query: str, repository: str | None = None, per_version_top_k: int = 10, candidate_pool_size: int = 50, min_similarity: float = 0.45, max_tracks: int = 50, mode: str = "auto") -> DataFrame:
        """Tracks of what a query finds, through the indexed versions."""
        for name, value in (("per_version_top_k", per_version_top_k), ("candidate_pool_size", candidate_pool_size), ("min_similarity", min_similarity), ("max_tracks", max_tracks)):
            checked(name, value)
        base = f"{self._base(self._record(repository))}/versions"
        catalog = self._catalog(base)
        vectors, asked = self._version_vectors(base, catalog, mode), self._queries([query])
        rows = self._version_chunks(base, catalog)
        found = versions.evolution(rows, catalog, asked if vectors is None else self._embedded(asked), per_version_top_k, candidate_pool_size, min_similarity, max_tracks, vectors=vectors)
        return found.drop("query_id").orderBy("track")

    def _graph(self, base: str) -> tuple[DataFrame, DataFrame]:
        """The stored graph, or else one that is derived from the chunks."""
        if self._exists(f"{base}/graph/nodes"):
            return tables.load_graph(self.spark, f"{base}/graph")[:2]
        nodes, edges = graph.build(self.spark.read.schema(CHUNK).parquet(f"{base}/chunks"))
        return snapshot(nodes), snapshot(edges)

    def graph(self, chunk_id: str, repository: str | None = None) -> DataFrame:
        """The direct relationships of a chunk, incoming first, with the chunks at their other ends (none for files)."""
        base = self._base(self._record(repository))
        nodes, edges = self._graph(base)
        wanted = nodes.where(F.col("chunk_id") == chunk_id).select("node_id")
        if wanted.isEmpty():
            raise NotFound(f"no chunk {chunk_id}")
        near = graph.neighbors(nodes, edges, wanted)
        chunk = self.spark.read.schema(CHUNK).parquet(f"{base}/chunks")
        about = chunk.select(graph.symbol_node(F.col("chunk_id")).alias("other"), F.struct(*CHUNK.names).alias("chunk"))
        return near.join(about, "other", "left").orderBy("direction", "relation", "file_path", "symbol_name")

    def graph_summary(self, repository: str | None = None) -> DataFrame:
        """(what, name, total): counts of nodes and edges, and the warnings of a stored graph as (warning, text, 1)."""
        base = self._base(self._record(repository))
        counts = graph.summary(*self._graph(base))
        if not self._exists(f"{base}/graph/warnings"):
            return counts
        said = tables.load_graph(self.spark, f"{base}/graph")[2]
        return counts.unionByName(said.select(F.lit("warning").alias("what"), F.col("warning").alias("name"), F.lit(1).cast("long").alias("total")))

    def evaluate(self, cases: list[tuple[str, dict[str, int]]], repository: str | None = None, method: str | list[str] = "auto", top_k: int = 10) -> DataFrame:
        """(query_id, method, ndcg, rr) of cases (query, grades from 0 to 3 by chunk); queries of one method run as one batch.

        ``method`` may name one for each case.
        """
        if not 1 <= len(cases) <= 100 or top_k < 10:
            raise ValueError("1 to 100 cases, and top_k of 10 or more")
        if any(not 0 <= g <= 3 for _, grades in cases for g in grades.values()) or any(not 1 <= len(g) <= 5000 for _, g in cases):
            raise ValueError("1 to 5000 judgements a case, grades from 0 to 3")
        methods = [method] * len(cases) if isinstance(method, str) else method
        if len(methods) != len(cases):
            raise ValueError("one method, or one for each case")
        parts = []
        for one in dict.fromkeys(methods):
            at = [k for k, m in enumerate(methods) if m == one]
            number = F.element_at(F.array(*map(F.lit, at)), F.col("query_id") + 1)
            found, report = self.search_report([cases[k][0] for k in at], repository, one, top_k)
            name = report.first().method
            judged = self.spark.createDataFrame([(k, c, g) for k in at for c, g in cases[k][1].items()], "query_id int, chunk_id string, grade int")
            parts.append(evaluate.evaluate(found.withColumn("query_id", number), judged).withColumn("method", F.lit(name)))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def evaluation_summary(per_query: DataFrame) -> DataFrame:
        """One row: the number of cases, the means, and the method, "mixed" if there are several."""
        name = F.when(F.min("method") == F.max("method"), F.min("method")).otherwise("mixed")
        return per_query.agg(F.count("*").alias("cases"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), name.alias("method"))
