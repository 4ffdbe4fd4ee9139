"""A graph of files and symbols: nodes, edges by unique resolution of names, neighbours and bounded expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.schema import not_negative
from lodeseam.sources.steps import snapshot
from lodeseam.sources.tree import signature

# Relations in the order in which an edge lists them, and what they are called backwards.
RELATIONS = ("CONTAINS", "CALLS", "REFERENCES", "IMPORTS", "INHERITS")
INVERSE = {"CALLS": "CALLED_BY", "CONTAINS": "CONTAINED_BY", "IMPORTS": "IMPORTED_BY", "INHERITS": "SUBCLASS_OF", "REFERENCES": "REFERENCED_BY"}


def file_node(path):
    return F.concat(F.lit("file::"), path)


def symbol_node(chunk_id):
    return F.concat(F.lit("symbol::"), chunk_id)


def nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, kind, chunk_id, symbol_name, file_path, language, start_line, end_line): a node per file and per chunk.

    A chunk_id that repeats raises an error.
    """
    files = chunks.groupBy("file_path").agg(F.min("language").alias("language"))
    files = files.select(file_node(F.col("file_path")).alias("node_id"), F.lit("file").alias("kind"), "file_path", "language")
    once = chunks.groupBy("chunk_id").agg(F.count("*").alias("times"), F.first(F.struct("symbol_name", "file_path", "language", "start_line", "end_line")).alias("x"))
    name = F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("repeated chunk_id "), "chunk_id"))).otherwise(F.col("chunk_id"))
    symbols = once.select(symbol_node(name).alias("node_id"), F.lit("symbol").alias("kind"), "chunk_id", "x.*")
    return symbols.unionByName(files, allowMissingColumns=True)


def _last(name):
    return F.substring_index(name, ".", -1)


def resolve(wanted: DataFrame, chunks: DataFrame, class_only: bool = False) -> DataFrame:
    """``wanted`` (file_path, name, ...) with ``target``, the chunk that the name means, or null.

    In turn, each only if exactly one chunk fits: in the same file by the name or its last
    part; anywhere by the name, as a whole or as a last part; anywhere by its last part.
    Several matches in the file do not end the search.
    """
    known = chunks.where("symbol_type = 'class'") if class_only else chunks
    named = known.select("chunk_id", F.col("file_path").alias("path"), F.explode(F.array_distinct(F.array("symbol_name", _last(F.col("symbol_name"))))).alias("key"), (F.col("symbol_name")).alias("full"))
    single = lambda rows, *by: rows.groupBy(*by).agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high")).select(*by, F.when(F.col("low") == F.col("high"), F.col("low")).alias("hit"))
    # in a file: by the whole name, or by equal last parts
    local = single(known.select("chunk_id", F.col("file_path").alias("path"), _last(F.col("symbol_name")).alias("key")), "path", "key").withColumnRenamed("hit", "in_file")
    anywhere = single(named, "key")
    rows = wanted.withColumn("short", _last(F.col("name")))
    rows = rows.join(local, (F.col("file_path") == F.col("path")) & (F.col("short") == F.col("key")), "left").drop("path", "key")
    rows = rows.join(anywhere.select(F.col("key").alias("k1"), F.col("hit").alias("exact")), F.col("name") == F.col("k1"), "left").drop("k1")
    rows = rows.join(anywhere.select(F.col("key").alias("k2"), F.col("hit").alias("final")), F.col("short") == F.col("k2"), "left").drop("k2")
    return rows.withColumn("target", F.coalesce("in_file", "exact", "final")).drop("short", "in_file", "exact", "final")


def contains(chunks: DataFrame) -> DataFrame:
    """(source, target): the parent symbol where it can be resolved, else the file."""
    inner = resolve(chunks.select("chunk_id", "file_path", F.col("parent_symbol").alias("name")), chunks)
    source = F.when(F.col("target").isNotNull() & (F.col("target") != F.col("chunk_id")), symbol_node(F.col("target"))).otherwise(file_node(F.col("file_path")))
    return inner.select(source.alias("source"), symbol_node(F.col("chunk_id")).alias("target"))


def unresolved(chunks: DataFrame) -> DataFrame:
    """(warning): the chunks whose parent symbol names nothing, or more than one thing."""
    inner = resolve(chunks.where("parent_symbol is not null").select("chunk_id", "file_path", "symbol_name", F.col("parent_symbol").alias("name")), chunks)
    return inner.where("target is null").select(F.concat("file_path", F.lit(": parent "), "name", F.lit(" of "), "symbol_name", F.lit(" can't be resolved")).alias("warning"))


def _links(named: DataFrame, chunks: DataFrame, class_only: bool = False) -> DataFrame:
    found = resolve(named.distinct(), chunks, class_only).where("target is not null")
    return found.select(symbol_node(F.col("chunk_id")).alias("source"), symbol_node(F.col("target")).alias("target")).distinct()


def calls(chunks: DataFrame) -> DataFrame:
    """(source, target) of calls whose name resolves; a chunk may call itself."""
    return _links(chunks.select("chunk_id", "file_path", F.explode("calls").alias("name")), chunks)


def references(signed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, target) of names in code that parses by itself; ``signed`` are chunks with their signature."""
    found = _links(signed.select("chunk_id", "file_path", F.explode("signature.names").alias("name")), chunks)
    return found.where("source <> target")


def inherits(signed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, target) of classes and their bases."""
    return _links(signed.select("chunk_id", "file_path", F.explode("signature.bases").alias("name")), chunks, class_only=True)


def imports(chunks: DataFrame) -> DataFrame:
    """(source, target) between files: module names as files or packages among those known, from the root or relative."""
    rows = chunks.select("file_path", F.explode("imports").alias("module")).distinct()
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    folders = F.slice(F.split("file_path", "/"), F.lit(1), F.greatest(F.size(F.split("file_path", "/")) - dots, F.lit(0)))
    tail = F.filter(F.split(F.regexp_replace("module", r"^\.+", ""), r"\."), lambda p: p != "")
    parts = F.concat(F.when(dots > 0, folders).otherwise(F.array().cast("array<string>")), tail)
    rows = rows.withColumn("stem", F.array_join(parts, "/"))
    files = chunks.select(F.col("file_path").alias("known")).distinct()
    plain = files.withColumnRenamed("known", "module_file")
    package = files.withColumnRenamed("known", "package_file")
    init = F.concat_ws("/", F.when(F.col("stem") != "", F.col("stem")), F.lit("__init__.py"))
    found = rows.join(plain, F.concat("stem", F.lit(".py")) == F.col("module_file"), "left").join(package, init == F.col("package_file"), "left")
    target = F.coalesce("module_file", "package_file")
    return found.where(target.isNotNull()).select(file_node(F.col("file_path")).alias("source"), file_node(target).alias("target")).distinct()


def merge_edges(by_relation: dict[str, DataFrame]) -> DataFrame:
    """(source, target, relations): one edge for each pair, its relations in the fixed order."""
    parts = [e.select("source", "target", F.lit(RELATIONS.index(r)).alias("at"), F.lit(r).alias("relation")) for r, e in by_relation.items()]
    together = reduce(DataFrame.unionByName, parts).groupBy("source", "target").agg(F.array_sort(F.collect_set(F.struct("at", "relation"))).alias("r"))
    return together.select("source", "target", F.transform("r", lambda x: x["relation"]).alias("relations"))


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the chunks of one repository."""
    signed = snapshot(chunks.withColumn("signature", signature("code", "calls", "symbol_type")))
    plain = signed.drop("signature")
    found = {"CONTAINS": contains(plain), "CALLS": calls(plain), "REFERENCES": references(signed, plain), "IMPORTS": imports(plain), "INHERITS": inherits(signed, plain)}
    return nodes(plain), merge_edges(found)


def summary(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(what, name, total): counts of nodes, edges, nodes by kind and edges by relation."""
    count = lambda df, what, name: df.groupBy(F.lit(what).alias("what"), name.alias("name")).agg(F.count("*").alias("total"))
    return reduce(DataFrame.unionByName, [
        count(node_rows, "nodes", F.lit("all")), count(edge_rows, "edges", F.lit("all")), count(node_rows, "kind", F.col("kind")),
        count(edge_rows.select(F.explode("relations").alias("relation")), "relation", F.col("relation")),
    ])


def neighbors(node_rows: DataFrame, edge_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Direct relationships of ``wanted`` (node_id): (node_id, direction, relation, other, file_path, symbol_name)."""
    ends = lambda mine, other, direction: edge_rows.select(F.col(mine).alias("node_id"), F.lit(direction).alias("direction"), F.array_join("relations", ",").alias("relation"), F.col(other).alias("other"))
    both = ends("target", "source", "incoming").unionByName(ends("source", "target", "outgoing"))
    about = node_rows.select(F.col("node_id").alias("other"), "file_path", "symbol_name")
    return both.join(wanted.select("node_id").distinct(), "node_id").join(about, "other")


#: Edges of one node that are read under one key: a node with more is split into so many slices.
SLICE = 1_000
#: Keys that the edges of a split node are spread over while they learn into how many slices.
_SPREAD = 64


def adjacency(edge_rows: DataFrame, slice_edges: int = SLICE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, moves, heavy): edges as numbered steps, ways from node to node, and the nodes whose ways are in slices.

    ``steps`` (step, relation, source, target) are numbered in that order, so that paths
    compare as arrays of numbers.  ``moves`` (at, slice, to, step) go both ways.  A node of
    more than ``slice_edges`` ways is in ``heavy`` (at, slices): its ways lie under as many
    keys, so that no task reads all of a hub; any other node has the slice 0 alone.
    """
    each = edge_rows.select(F.explode("relations").alias("relation"), "source", "target")
    steps = snapshot(each.orderBy("relation", "source", "target").select(F.monotonically_increasing_id().alias("step"), "relation", "source", "target"))
    back = steps.where("source <> target").select(F.col("target").alias("at"), F.col("source").alias("to"), "step")
    moves = steps.select(F.col("source").alias("at"), F.col("target").alias("to"), "step").unionByName(back)
    degrees = moves.groupBy("at").count().where(F.col("count") > slice_edges)
    heavy = snapshot(degrees.select("at", F.ceil(F.col("count") / slice_edges).cast("int").alias("slices")))
    if heavy.isEmpty():
        return steps, moves.withColumn("slice", F.lit(0)), heavy
    spread_out = heavy.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))))
    place = F.xxhash64("at", "to", "step")
    parted = moves.withColumn("part", F.pmod(place, F.lit(_SPREAD)).cast("int")).join(spread_out, ["at", "part"], "left")
    slice_of = F.coalesce(F.pmod(F.shiftright(place, 8), F.col("slices")), F.lit(0)).cast("int")
    return steps, snapshot(parted.select("at", slice_of.alias("slice"), "to", "step")), heavy


def follow(frontier: DataFrame, moves: DataFrame, heavy: DataFrame) -> DataFrame:
    """(query_id, seed, at, position, path): one step on from ``frontier``, each node by its least path.

    Those at a hub ask all of its slices; those that meet at a node are reduced before they
    are shuffled.
    """
    asked = frontier.join(heavy, "at", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    met = asked.join(moves, ["at", "slice"]).select("query_id", "seed", F.col("to").alias("at"), "position", F.concat("path", F.array("step")).alias("path"))
    return met.groupBy("query_id", "seed", "at").agg(F.min("position").alias("position"), F.min("path").alias("path"))


def expand(node_rows: DataFrame, edge_rows: DataFrame, seeds: DataFrame, max_hops: int = 3, max_candidates: int = 100, slice_edges: int = SLICE) -> DataFrame:
    """(query_id, seed, node_id, hops, relation_path, graph_score): symbols near ``seeds`` (query_id, node_id, position).

    Edges are followed both ways, files cost a hop and are not results.  Each symbol has the
    least hops, from the first seed in order that gives them, by the path of the lexically
    least steps (relation, source, target).  Seeds are searched one after another until
    ``max_candidates`` symbols are met; what can't come before that is not walked further.  A breadth-first search gives that: one join a hop, of
    which only the least path to each new node stays; each hop's lineage is cut.
    """
    not_negative(max_candidates=max_candidates)
    if max_hops < 1 or slice_edges < 1:
        raise ValueError("max_hops and slice_edges must be at least one")
    steps, moves, heavy = adjacency(edge_rows, slice_edges)
    first = seeds.groupBy("query_id", "node_id").agg(F.min("position").alias("position"))
    reached = first.select("query_id", "position", F.col("node_id").alias("seed"), F.col("node_id").alias("at"), F.lit(0).alias("hops"), F.array().cast("array<long>").alias("path"))
    frontier, found = reached, [reached]
    symbols = node_rows.where("kind <> 'file'").select(F.col("node_id").alias("at"))
    for hop in range(1, max_hops + 1):
        seen = reduce(DataFrame.unionByName, found).select("query_id", "seed", "at")
        new = follow(frontier, moves, heavy).join(seen, ["query_id", "seed", "at"], "left_anti")
        frontier = snapshot(new.withColumn("hops", F.lit(hop)).select(*reached.columns))
        found.append(frontier)
        if frontier.isEmpty():
            break
        if hop < max_hops:
            # seeds at which a query has met enough symbols, in this or an earlier place, have nothing to add
            met_at = reduce(DataFrame.unionByName, found[1:]).where("at <> seed").join(symbols, "at").groupBy("query_id", "at").agg(F.min("position").alias("position"))
            so_far = F.sum("n").over(Window.partitionBy("query_id").orderBy("position"))
            enough = met_at.groupBy("query_id", "position").agg(F.count("*").alias("n")).withColumn("so_far", so_far).where(F.col("so_far") >= max_candidates)
            frontier = frontier.join(enough.groupBy("query_id").agg(F.min("position").alias("stop")), "query_id", "left").where("stop is null or position < stop").drop("stop")
    hits = reduce(DataFrame.unionByName, found[1:]).where("at <> seed").join(symbols, "at")
    # the order of discovery is (position, hops, path); the search ends when the last wanted symbol is first met
    key = F.struct("position", "hops", "path")
    order = Window.partitionBy("query_id").orderBy("met")
    discovered = hits.groupBy("query_id", "at").agg(F.min(key).alias("met")).withColumn("nth", F.row_number().over(order))
    ends = discovered.where(F.col("nth") == max_candidates).select("query_id", F.col("met").alias("stop"))
    inside = discovered.where(F.col("nth") <= max_candidates).select("query_id", "at")
    kept = hits.join(inside, ["query_id", "at"]).join(ends, "query_id", "left").where(F.col("stop").isNull() | (key <= F.col("stop")))
    best = kept.groupBy("query_id", "at").agg(F.min_by(F.struct("seed", "hops", "path"), F.struct("hops", "position", "path")).alias("b"))
    labels = node_rows.select("node_id", F.coalesce("symbol_name", "file_path", "node_id").alias("label"))
    walked = best.select("query_id", F.col("at").alias("node_id"), "b.*")
    # the node that each step leads to: the end of it at which the walk was not
    taken = walked.select("query_id", "node_id", "seed", F.posexplode("path").alias("i", "step")).join(steps, "step")
    spelled = taken.groupBy("query_id", "node_id", "seed").agg(F.array_sort(F.collect_list(F.struct("i", "relation", "source", "target"))).alias("path"))
    spelled = spelled.select("query_id", "node_id", "seed", F.posexplode("path").alias("i", "step"), "path")
    arrive = F.aggregate(F.slice("path", F.lit(1), F.col("i") + 1), F.col("seed"), lambda at, s: F.when(s["source"] == at, s["target"]).otherwise(s["source"]))
    backwards = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in INVERSE.items() for x in p)), F.col("step.relation")), F.col("step.relation"))
    spelled = spelled.withColumn("to", arrive).join(labels.withColumnRenamed("node_id", "to"), "to")
    says = F.when(F.col("step.target") == F.col("to"), F.concat("step.relation", F.lit(" -> "), "label")).otherwise(F.concat(backwards, F.lit(" <- "), "label"))
    paths = spelled.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("i", says.alias("says")))).alias("s"))
    paths = paths.select("query_id", "node_id", F.transform("s", lambda x: x["says"]).alias("relation_path"))
    return walked.join(paths, ["query_id", "node_id"]).select("query_id", "seed", "node_id", "hops", "relation_path", (1.0 / F.col("hops")).alias("graph_score"))
