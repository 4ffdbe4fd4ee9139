"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

A signature has ``m`` values.  Each shingle deals the ranks 0..m-1 to the positions by a
permutation of its own and adds a fraction below 1; a position keeps its least value.  A
rank is only as large as the number of values already dealt, so a document stops as soon as
every position has a value: later ranks are larger than all of them.  All shingles of a
document take the same step at once, which leaves the same minima.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, words
from lodeseam.llm.components import components

_EMPTY = np.uint64(2**64 - 1)
_REPLAYED = 8  # steps whose permutation is traced back rather than stored
_SLICE = 1 << 15  # elements whose permutations are stored at a time


def band_settings(threshold: float, miss: float = 1e-6, values: int = 280) -> tuple[int, int]:
    """(bands, rows): the most selective bands that miss a pair at the threshold with at most that probability."""
    for rows in range(12, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-p)))
        if bands * rows <= values or rows == 1:
            return bands, rows
    raise AssertionError


def super_minhash(elements: np.ndarray, first: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """The signatures (a row of m values each) of the sets elements[first[d]:first[d + 1]].

    Elements go in slices, however long a set is: each position keeps the least value of all.
    """
    n = len(first) - 1
    out = np.full((n, m), _EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    for low in range(0, len(elements), _SLICE):
        part = owner[low : low + _SLICE]
        a, b = part[0], part[-1] + 1
        np.minimum(out[a:b], _signatures(elements[low : low + _SLICE], part - a, b - a, m, seed), out=out[a:b])
    return out


def _signatures(elements: np.ndarray, owner: np.ndarray, n: int, m: int, seed: int) -> np.ndarray:
    out = np.full((n, m), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    picks: list[np.ndarray] = []
    deal = None
    for step in range(m):
        random = words.mix(elements + np.uint64((0x9E3779B97F4A7C15 * (step + 1) + seed) % 2**64))
        pick = step + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
        if step < _REPLAYED:
            place = pick.copy()
            for k in range(step - 1, -1, -1):  # where did what is now at ``pick`` lie before the earlier swaps?
                place[place == picks[k]] = k
            picks.append(pick)
        else:
            if deal is None:
                deal = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                each = np.arange(len(elements))
                for k, p in enumerate(picks):
                    deal[each, p], deal[:, k] = deal[:, k].copy(), deal[each, p]
            each = np.arange(len(elements))
            place = deal[each, pick].astype(np.int64)
            deal[each, pick] = deal[:, step]
        value = np.uint64(step << 32) | random >> np.uint64(32)
        np.minimum.at(flat, owner * m + place, value)
        keep = (out == _EMPTY).any(axis=1)[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            picks = [p[keep] for p in picks]
            deal = deal[keep] if deal is not None else None
    return out


def _features(width: int, table: np.ndarray, bands: int, rows: int, with_bands: bool = True):
    """Batches of (doc_id, text) to the size of each set, a digest of it, and its band keys."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for low, sets, first in words.shingles(batch.column(1), width, table, 1 << 19):
                n = len(first) - 1
                signature = super_minhash(sets, first, bands * rows).reshape(n, bands, rows)
                keys = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    keys = words.mix(keys * np.uint64(0xA24BAED4963EE407) + signature[:, :, k])
                keys = words.mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9FB21C651E98DF25))
                sizes = np.diff(first)
                raw = sets.tobytes()
                digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                counts = np.where(sizes > 0, bands, 0)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), keys[sizes > 0].view(np.int64).reshape(-1))
                yield pa.record_batch([ids.slice(low, n), pa.array(sizes), pa.array(digests, pa.binary()), lists], names=["doc_id", "n", "digest", "bands"])

    return run


def _verify(width: int, table: np.ndarray, percent: int):
    """Rows (pivot, part, is_member, doc_id, text), a part's pivot first: the pairs that are alike.

    Only the pivot's own set stays in memory; members pass one by one.
    """

    def run(batches):
        pivot = part = None
        own: list[np.ndarray] = []
        for batch in (whole.slice(low, 1000) for whole in batches for low in range(0, len(whole), 1000)):
            columns = [batch.column(i).to_pylist() for i in range(5)]
            a, b, alike = [], [], []
            for p, s, member, doc, raw in zip(*columns):
                if (p, s) != (pivot, part):
                    pivot, part, own = p, s, []
                have = np.frombuffer(raw, np.uint64)
                if not member:
                    own.append(have)
                    continue
                best = 0.0
                linked = False
                for other in own:
                    both = np.concatenate([other, have])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    union = len(both) - common
                    linked |= 100 * common >= percent * union
                    best = max(best, common / union)
                a.append(p)
                b.append(doc)
                alike.append(best if not linked else max(best, percent / 100))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64())], names=["a", "b", "alike"])

    return run


def _sets(width: int, table: np.ndarray):
    """Batches of (pivot, part, is_member, doc_id, text) with the set's hashes for the text."""

    def run(batches):
        for batch in batches:
            for low, sets, first in words.shingles(batch.column(4), width, table):
                n, raw = len(first) - 1, sets.tobytes()
                blobs = [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([*(batch.column(i).slice(low, n) for i in range(4)), pa.array(blobs, pa.binary())], names=["pivot", "part", "is_member", "doc_id", "elements"])

    return run


#: A pivot's members are verified in parts of about this many.
PART = 2000
#: Pairs to verify are broadcast up to this many (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_PAIRS = 400_000


def _check_pairs(rows: DataFrame, pairs: DataFrame, width: int, table: np.ndarray, percent: int) -> DataFrame:
    """Stored (a, b, alike) for stored ``pairs`` (pivot, doc_id), on full sets of both texts."""
    hot = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(hot, "pivot").select("pivot", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), F.lit(True).alias("is_member"), "doc_id")
    heads = dealt.select("pivot", "part").distinct().select("pivot", "part", F.lit(False).alias("is_member"), F.col("pivot").alias("doc_id"))
    wanted = frames.stored(dealt.union(heads), "wanted")
    few = wanted.count() <= BROADCAST_PAIRS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id").select("pivot", "part", "is_member", "doc_id", "text")
    sets = frames.in_arrow(texts, _sets(width, table), "pivot long, part int, is_member boolean, doc_id long, elements binary")
    grouped = sets.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "is_member")
    return frames.stored(frames.in_arrow(grouped, _verify(width, table, percent), "a long, b long, alike double"), "verified")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True, pivots: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: components of the links between near copies.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct
    ``width``-word shingles (A-Z in lower case if ``lower``).  A text of fewer words has its
    whole sequence as its one shingle; a null text, an empty one and one without words have
    an empty set and are linked with nothing.  component_id is the smallest doc_id that is
    reached by links, and the row with it is kept.  Rows of one doc_id are one node: each of
    their sets links it.  A row without a doc_id is linked with nothing and kept.

    Rows of equal sets are one class from the start, and only its smallest doc_id goes on.
    Classes that share a band are candidates.  All pairs within a band would be the square of
    a group, so rounds of pivots come first: in each band that still holds two components,
    all members are compared with one pivot.  What the pivots leave apart is compared pair by
    pair, except for pairs that the sizes of the sets and bitmaps of them rule out: so no link
    between two candidates is lost that changes a component.
    """
    table = words.BYTES_LOWER if lower else words.BYTES
    bands, depth = band_settings(percent / 100)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = frames.stored(frames.in_arrow(rows, _features(width, table, bands, depth), "doc_id long, n long, digest binary, bands array<long>"), "features")

    known = features.where("doc_id is not null and digest is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("head"))
    heads = known.select("doc_id", "digest", "n", "bands").join(classes, "digest").where("doc_id = head").dropDuplicates(["doc_id", "digest"])
    keyed = heads.select("doc_id", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
    members = frames.stored(keyed.join(shared, "key").select("key", "doc_id", "n", "size"), "members")

    degrees = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    labels = frames.stored(degrees.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"), "degree"), "labels")
    links = distances = None
    bound = F.lit(percent / 100)
    for turn in range(pivots + 1):
        current = members.join(labels, members.doc_id == labels.node).select("key", "doc_id", "n", F.col("root").alias("component"), "degree")
        # the first pivot is the member with most companions: the original, if the others are copies of it
        choice = F.xxhash64("component", "doc_id", F.lit(turn)) if turn else -F.col("degree")
        live = current.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min_by(F.struct("doc_id", "n", "component"), F.struct(choice, "doc_id")).alias("p")).where("c0 <> c1")
        if turn < pivots:
            pairs = current.join(live, "key").where("component <> p.component").select(F.col("p.doc_id").alias("pivot"), "doc_id", "n", F.col("p.n").alias("pn"))
            pairs = pairs.where(F.least("n", "pn") >= bound * F.greatest("n", "pn") - 1e-9).select("pivot", "doc_id").where("pivot <> doc_id").distinct()
        else:
            current = frames.stored(current.join(live, "key", "left_semi").drop("degree"), "live")
            pairs = _remaining(current, _bitmaps(rows, current.select("doc_id").distinct(), width, table), percent)
        if distances is not None:
            for a, b in (("a", "b"), ("b", "a")):
                pairs = pairs.join(distances.select(F.col(a).alias("pivot"), F.col(b).alias("doc_id")), ["pivot", "doc_id"], "left_anti")
        pairs = frames.stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        checked = _check_pairs(rows, pairs, width, table, percent)
        distances = checked if distances is None else frames.stored(distances.union(checked), "distances")
        links = distances.where(F.col("alike") >= bound).select("a", "b")
        if not links.isEmpty():
            found = components(links)
            labels = frames.stored(labels.drop("root").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "degree"), "labels")

    # a doc_id of several rows may be in several classes: their heads are linked through it
    several = known.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("doc_id")
    bridges = known.join(several, "doc_id").join(classes, "digest").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    bridges = frames.stored(bridges, "bridges")
    if not bridges.isEmpty():
        found = components(bridges if links is None else links.union(bridges))
        labels = found
    placed = features.select("doc_id", "n", "digest").join(classes, "digest", "left").join(labels.withColumnRenamed("node", "head"), "head", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "head")), "doc_id")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: Bits of the bitmaps that rule pairs out, in 64-bit words.
BITMAP = 32


def _bitmaps(rows: DataFrame, ids: DataFrame, width: int, table: np.ndarray) -> DataFrame:
    """(doc_id, bits): a bit for each shingle by its hash; null for a doc_id of several rows."""

    def run(batches):
        for batch in batches:
            for low, sets, first in words.shingles(batch.column(1), width, table):
                n = len(first) - 1
                flags = np.zeros((n, 64 * BITMAP), np.uint8)
                flags[np.repeat(np.arange(n), np.diff(first)), (sets % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
                packed = np.packbits(flags, axis=1).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(np.arange(0, len(packed) + 1, BITMAP, dtype=np.int32), packed)
                yield pa.record_batch([batch.column(0).slice(low, n), lists], names=["doc_id", "bits"])

    few = ids.count() <= BROADCAST_PAIRS
    texts = rows.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "text")
    maps = frames.in_arrow(texts, run, "doc_id long, bits array<long>")
    return maps.groupBy("doc_id").agg(F.when(F.count("*") == 1, F.first("bits")).alias("bits"))


def _remaining(current: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (pivot, doc_id) that share a band, lie in different components, and may be alike by their bitmaps.

    A bit that one set has and the other lacks is at least one shingle that they don't
    share, which bounds what they can have in common.  A pair comes from the first band
    that it shares.  Documents of a band's largest component are not paired with each other.
    """
    enough = lambda most, n, m: most * 100 >= percent * (n + m - most)
    bands = current.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    main = current.groupBy("key").agg(F.mode("component", True).alias("main"))
    able = current.join(bands, "doc_id").join(bitmaps, "doc_id").join(main, "key").withColumn("in_main", F.col("component") == F.col("main"))
    left = able.where("not in_main").select(F.col("key").alias("k"), F.col("doc_id").alias("pivot"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("keys").alias("p_keys"), F.col("bits").alias("p_bits"))
    lacking = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda total, x: total + x)
    common = F.least(F.col("n") - lacking("bits", "p_bits"), F.col("m") - lacking("p_bits", "bits"))
    may = (F.col("k") == F.col("key")) & (F.col("c") != F.col("component")) & (F.col("in_main") | (F.col("pivot") < F.col("doc_id")))
    may = may & enough(F.least("n", "m"), F.col("n"), F.col("m")) & (F.array_min(F.array_intersect("keys", "p_keys")) == F.col("k"))
    return left.join(able, may & F.coalesce(enough(common, F.col("n"), F.col("m")), F.lit(True))).select("pivot", "doc_id").distinct()


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's links: distinct 3-word shingles in lower case, 85 %."""
    return near_duplicates(frames.documents(spark, sf_dir), width=3, percent=85)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM d),
one AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
