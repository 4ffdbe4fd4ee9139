"""Exact cosine search over stored vectors, in blocks; and an embedder that needs no model."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lodeseam.functions.text import bag, searchable_text
from lodeseam.schema import not_negative
from lodeseam.sources.arrow import in_arrow
from lodeseam.sources.steps import snapshot, spread

#: Queries, and vectors, that lie in one row and are multiplied at a time.
BLOCK = 1_000


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def normalize(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """``vectors`` at unit length, as doubles; an empty vector, one of length 0, or one that isn't finite raises an error."""
    size = norm(F.col(column))
    bad = (F.size(column) < 1) | F.col(column).isNull() | F.exists(column, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))) | (size == 0)
    unit = F.transform(column, lambda x: x.cast("double") / size)
    return vectors.withColumn(column, F.when(bad, F.raise_error(F.lit("vectors must be finite and not zero"))).otherwise(unit))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def _in_order(ids) -> np.ndarray:
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), int)


#: Vectors around which blocks are formed, at most.
CENTERS = 256
#: Up to so many full blocks of vectors are all visited by every query.
FEW = 8


def _packed(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """Up to ``size`` rows of one part in one: their ids, dimension, vectors at unit length as the bytes of doubles, and part.

    ``rows`` are (``id_col``, vector, part, near), those of a part, and in it of one ``near``, side by side.  ``middle`` is the block's
    direction, and ``reach`` the largest angle of a row to it.
    """
    arrow = to_arrow_type(rows.schema[id_col].dataType)

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for low, high in _stretches(keys, size):
                ids, block = batch.column(0).slice(low, high - low).to_pylist(), np.array(batch.column(1).slice(low, high - low).to_pylist(), float)
                order = _in_order(ids)
                block = block[order] / np.maximum(np.linalg.norm(block[order], axis=1, keepdims=True), 1e-300)
                middle = block.sum(axis=0)
                middle /= max(np.linalg.norm(middle), 1e-300)
                reach = float(np.arccos(np.clip(block @ middle, -1, 1)).max())
                yield pa.record_batch([pa.array([[ids[i] for i in order]], pa.list_(arrow)), pa.array([block.shape[1]], pa.int32()), pa.array([block.tobytes()], pa.binary()), batch.column(2).slice(low, 1), pa.array([middle.tobytes()], pa.binary()), pa.array([reach], pa.float64())], names=[f"{id_col}s", f"{id_col}_dimension", f"{id_col}_block", f"{id_col}_part", f"{id_col}_middle", f"{id_col}_reach"])

    kind = dict(rows.dtypes)[id_col]
    return in_arrow(rows.select(id_col, "vector", "part", "near"), run, f"{id_col}s array<{kind}>, {id_col}_dimension int, {id_col}_block binary, {id_col}_part string, {id_col}_middle binary, {id_col}_reach double")


def _by_center(rows: DataFrame, block: int, count: int) -> DataFrame:
    """``rows`` (chunk_id, vector, part) with ``near``, the number of the nearest of some sampled vectors, sorted by part and near within partitions.

    As many vectors are sampled as there are blocks in a partition, ``CENTERS`` at most.
    """
    wanted = min(CENTERS, -(-count // (block * max(1, rows.rdd.getNumPartitions()))))
    sample = [r.vector for r in rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).collect()]
    centers = np.array([v for v in sample if len(v) == len(sample[0])], float)

    def run(batches):
        for batch in batches:
            near = [int((centers @ np.array(v)).argmax()) if len(v) == centers.shape[1] else 0 for v in batch.column(1).to_pylist()] if len(centers) > 1 else [0] * len(batch)
            yield pa.record_batch([*batch.columns, pa.array(near, pa.int32())], names=["chunk_id", "vector", "part", "near"])

    if len(centers):
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    kind = dict(rows.dtypes)["chunk_id"]
    return in_arrow(rows, run, f"chunk_id {kind}, vector array<double>, part string, near int").sortWithinPartitions("part", "near")


def _stretches(keys: list, size: int):
    """(low, high) of equal keys side by side, ``size`` at most."""
    low = 0
    for at in range(1, len(keys) + 1):
        if at == len(keys) or at - low == size or keys[at] != keys[low]:
            yield low, at
            low = at


def _bounds(asks: np.ndarray, middle: np.ndarray, reach: float) -> np.ndarray:
    """The largest cosine that each query can have with a vector within ``reach`` of ``middle``."""
    apart = np.arccos(np.clip(asks @ middle, -1, 1)) - reach
    return np.cos(np.maximum(apart, 0)) + 1e-7


class _Best:
    """The best ``k`` vectors of each query of a block, of those seen so far; ties go by id."""

    def __init__(self, names: list, k: int):
        self.names, self.k = names, k
        self.least = np.full(len(names), -np.inf)
        self.q, self.score, self.ids = np.zeros(0, int), np.zeros(0), np.zeros(0, object)

    def add(self, scores: np.ndarray, ids: list) -> None:
        k = min(self.k, len(ids))
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        q, c = np.nonzero(scores >= np.maximum(edge, self.least[:, None]))
        if not len(q):
            return
        there = np.zeros(len(ids), object)
        there[:] = ids
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, scores[q, c]]), np.concatenate([self.ids, there[c]])
        place = np.empty(len(ids), int)
        place[_in_order(ids)] = np.arange(len(ids))
        order = np.lexsort((place, -score, q))
        sorted_q = q[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        keep = order[nth < self.k]
        self.q, self.score, self.ids = q[keep], score[keep], ids[keep]
        full = keep[nth[nth < self.k] == self.k - 1]
        self.least[q[full]] = score[full]


@dataclass(frozen=True)
class Blocks:
    """Vectors packed for search(): the stored blocks, whether every query visits all of them, and the chunk_id's type."""

    known: DataFrame
    few: bool
    chunk_id: DataType
    block: int
    within: str | None


def pack(vectors: DataFrame, block: int = BLOCK, within: str | None = None) -> Blocks:
    """``vectors`` (chunk_id, vector) in stored blocks, for several searches; a stored table of vectors is read twice."""
    parted = vectors.where("vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), (F.lit(None) if within is None else F.col(within)).cast("string").alias("part"))
    held = parted.count()
    few = held <= FEW * block
    lined = (parted if within is None else parted.sortWithinPartitions("part")).withColumn("near", F.lit(0)) if few else _by_center(parted, block, held)
    return Blocks(snapshot(_packed(lined, "chunk_id", block).withColumn("bid", F.monotonically_increasing_id())), few, vectors.schema["chunk_id"].dataType, block, within)


def search(vectors: DataFrame | Blocks, queries: DataFrame, top_k: int = 10, block: int = BLOCK, within: str | None = None, report=None) -> DataFrame:
    """(query_id, rank, chunk_id, score) for queries (query_id, vector) against vectors (chunk_id, vector): the cosine, exact.

    ``vectors`` that are searched more than once are better packed once; ``block`` and ``within`` are then those of pack().

    Both are packed into rows of up to ``block``, vectors around sampled centers, and stored.  A block's middle and reach bound the
    cosine of a query with all its vectors.  1: each query visits the blocks of the highest bounds that hold ``top_k``
    vectors; its last score there is a threshold.  2: it visits all blocks whose bound reaches that.  So blocks that are too far off
    are neither read for it nor multiplied.  Tasks keep the best ``top_k`` a query of what
    they see, and a window ranks what the tasks keep.  Ties go by chunk_id.  What is collected is a
    sample of ``CENTERS`` vectors at most.  With ``within``, a
    column of strings of ``vectors``, each of its values has a ranking of its own, and the result that column.
    A query without a vector finds nothing.  ``report`` is called with the block pairs visited and all there are, by query.
    """
    not_negative(top_k=top_k)
    held = vectors if isinstance(vectors, Blocks) else pack(vectors, block, within)
    known, few, block, within = held.known, held.few, held.block, held.within
    queries = queries.where("vector is not null")
    count = queries.count()
    plain = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("part"), F.lit(0).alias("near"))
    asked = _packed(plain.repartition(max(1, -(-count // block))), "query_id", block)
    asked = snapshot(asked.select("query_ids", "query_id_dimension", "query_id_block").withColumn("number", F.monotonically_increasing_id()))
    q_kind, c_kind = dict(queries.dtypes)["query_id"], held.chunk_id.simpleString()
    q_arrow, c_arrow = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(held.chunk_id)
    about = known.select("bid", F.size("chunk_ids").alias("size"), "chunk_id_dimension", "chunk_id_part", "chunk_id_middle", "chunk_id_reach")

    def same(wide: int, wide_c: int) -> None:
        if wide != wide_c:
            raise ValueError(f"vectors of {wide_c} dimensions, queries of {wide}")

    def nearest(batches):
        """Of the blocks that a task sees, those of the highest bounds that hold top_k vectors, for each query and part."""
        seen: dict[tuple, list] = {}
        for batch in batches:
            for wide, asks, number, bid, size, wide_c, part, middle, reach in zip(*(c.to_pylist() for c in batch.columns)):
                same(wide, wide_c)
                for i, bound in enumerate(_bounds(np.frombuffer(asks).reshape(-1, wide), np.frombuffer(middle), reach).tolist()):
                    mine = seen.setdefault((number, i, part), [])
                    mine.append((-bound, bid, size))
                    if len(mine) > 64:
                        seen[number, i, part] = _enough(mine, top_k)
        rows = [(*key, *x) for key, mine in seen.items() for x in _enough(mine, top_k)]
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int32()))], names=["number", "i", "part", "less", "bid", "size"])

    def reaching(batches):
        """The blocks whose bound reaches a query's threshold: (number, bid, which queries)."""
        for batch in batches:
            out = []
            for wide, asks, number, needed, bid, _, wide_c, part, middle, reach in zip(*(c.to_pylist() for c in batch.columns)):
                same(wide, wide_c)
                least = np.full(len(asks) // 8 // wide, -np.inf)
                for n in needed or []:
                    if n["part"] == part:
                        least[n["i"]] = n["score"]
                goes = np.flatnonzero(_bounds(np.frombuffer(asks).reshape(-1, wide), np.frombuffer(middle), reach) >= least)
                if len(goes):
                    out.append((number, bid, goes.tolist()))
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["number", "bid", "goes"])

    def run(batches):
        found: dict[tuple, _Best] = {}
        for batch in batches:
            for i in range(len(batch) if top_k else 0):
                names, wide, asks, number, goes, ids, wide_c, holds, part = (batch.column(c)[i].as_py() for c in range(9))
                same(wide, wide_c)
                best = found.setdefault((number, part), _Best(names, top_k))
                a, b = np.frombuffer(asks).reshape(len(names), wide), np.frombuffer(holds).reshape(len(ids), wide)
                if goes is None:
                    best.add(np.round(a @ b.T, 9), ids)
                else:
                    scores = np.full((len(names), len(ids)), -np.inf)
                    scores[goes] = np.round(a[goes] @ b.T, 9)
                    best.add(scores, ids)
        for (number, part), best in found.items():
            real = np.isfinite(best.score)
            yield pa.record_batch([pa.array([number] * int(real.sum()), pa.int64()), pa.array(best.q[real], pa.int32()), pa.array([best.names[i] for i in best.q[real]], q_arrow), pa.array(best.ids[real].tolist(), c_arrow), pa.array(best.score[real], pa.float64()), pa.array([part] * int(real.sum()), pa.string())], names=["number", "i", "query_id", "chunk_id", "score", "part"])

    schema = f"number long, i int, query_id {q_kind}, chunk_id {c_kind}, score double, part string"
    asks, holds = ["query_ids", "query_id_dimension", "query_id_block", "number"], ["chunk_ids", "chunk_id_dimension", "chunk_id_block", "chunk_id_part"]
    look, meet = ["query_id_dimension", "query_id_block", "number"], ["bid", "size", "chunk_id_dimension", "chunk_id_part", "chunk_id_middle", "chunk_id_reach"]
    visited = lambda visits: in_arrow(asked.join(visits, "number").join(known, "bid").select(*asks, "goes", *holds), run, schema)
    paired = lambda left: left.crossJoin(about.hint("shuffle_replicate_nl"))
    if few:
        best = in_arrow(asked.crossJoin(known.hint("shuffle_replicate_nl")).select(*asks, F.lit(None).cast("array<int>").alias("goes"), *holds), run, schema)
    else:
        about = snapshot(about)
        first = in_arrow(paired(asked).select(*look, *meet), nearest, "number long, i int, part string, less double, bid long, size int")
        before = Window.partitionBy("number", "i", "part").orderBy("less", "bid").rowsBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("held", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("held") < top_k).groupBy("number", "bid").agg(F.collect_list("i").alias("goes"))
        last = F.row_number().over(Window.partitionBy("number", "i", "part").orderBy(F.desc("score"), "chunk_id"))
        needed = visited(first).withColumn("nth", last).where(F.col("nth") == top_k).groupBy("number").agg(F.collect_list(F.struct("part", "i", "score")).alias("needed"))
        needed = asked.join(snapshot(needed), "number", "left").select(*look, "needed")
        visits = snapshot(in_arrow(paired(needed).select(*look, "needed", *meet), reaching, "number long, bid long, goes array<int>"))
        if report:
            report(visits.agg(F.sum(F.size("goes"))).first()[0], count * about.count())
        best = visited(visits)
    order = Window.partitionBy("query_id", *([] if within is None else ["part"])).orderBy(F.desc("score"), "chunk_id")
    ranks = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranks.select("query_id", "rank", "chunk_id", "score", *([] if within is None else [F.col("part").alias(within)]))


def _enough(blocks: list, k: int) -> list:
    """Of (-bound, block, size), the first by bound that hold ``k`` together."""
    blocks, held = sorted(blocks), 0
    for n, (_, _, size) in enumerate(blocks, 1):
        held += size
        if held >= k:
            return blocks[:n]
    return blocks


def embed(texts: DataFrame, id_col: str, text: Column, dimension: int = 256) -> DataFrame:
    """(id, vector): signed feature hashing of the tokens, at unit length.  Any function with this signature can stand in."""

    def run(batches):
        memo: dict[str, tuple[int, int]] = {}
        for batch in batches:
            out = np.zeros((len(batch), dimension))
            for v, row in zip(out, batch.column(1).to_pylist()):
                for t in row:
                    if t not in memo:
                        d = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                        memo[t] = (d % dimension, 1 if d >> 63 else -1)
                    v[memo[t][0]] += memo[t][1]
                if not v.any():
                    v[0] = 1.0
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            offsets = np.arange(0, out.size + 1, dimension, dtype=np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, out.reshape(-1))], names=[id_col, "vector"])
            if len(memo) > 500_000:
                memo.clear()

    kind = dict(texts.dtypes)[id_col]
    return in_arrow(texts.select(id_col, bag(text).alias("tokens")), run, f"{id_col} {kind}, vector array<double>")


def build(chunks: DataFrame, embedder=embed) -> DataFrame:
    """(chunk_id, vector) of every chunk's searchable text."""
    return embedder(spread(chunks), "chunk_id", searchable_text())
