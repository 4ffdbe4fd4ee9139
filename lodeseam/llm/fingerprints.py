"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, words

#: Five-word shingles in 512 bins, of which the four low-order bits are kept: 256 bytes a document.
WIDTH, BINS, BITS = 5, 512, 4
_EMPTY = np.uint64(2**64 - 1)
_TRIES = 4096


@cache
def _sources(bins: int) -> np.ndarray:
    """Where an empty bin looks at each try, for all documents alike."""
    at = np.arange(_TRIES * bins, dtype=np.uint64) + np.uint64(0x51ED270B)
    return (words.mix(at * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64).reshape(_TRIES, bins)


def _salts(bins: int) -> np.ndarray:
    return np.arange(bins, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)


def _densify(table: np.ndarray) -> None:
    """Fill each empty bin from the first bin of its own sequence that is not empty; rows without any stay."""
    full = table != _EMPTY
    count = full.sum(axis=1)
    one = np.flatnonzero(count == 1)
    table[one] = table[one].min(axis=1, keepdims=True)
    rows = np.flatnonzero((count > 1) & (count < table.shape[1]))
    had, own = full[rows], table[rows]
    out, empty, live = own.copy(), ~full[rows], np.arange(len(rows))
    for source in _sources(table.shape[1]):
        take = empty[live] & had[live][:, source]
        r, c = np.nonzero(take)
        r = live[r]
        out[r, c] = own[r, source[c]]
        empty[r, c] = False
        live = live[empty[live].any(axis=1)]
        if not len(live):
            break
    for r in live:  # as good as never: the next full bin
        places = np.flatnonzero(had[r])
        gaps = np.flatnonzero(empty[r])
        out[r, gaps] = own[r, places[np.searchsorted(places, gaps) % len(places)]]
    table[rows] = out


def codes(texts, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """A row of ``bins`` codes of ``bits`` bits for each text of an Arrow column; zeros for a text without words."""
    out = []
    for _, sets, first in words.shingles(texts, width):
        n = len(first) - 1
        spread = words.mix(sets ^ np.uint64(0x2545F4914F6CDD1D))
        where = np.repeat(np.arange(n) * bins, np.diff(first)) + (spread >> np.uint64(32)).astype(np.int64) * bins // 2**32
        table = np.full(n * bins, _EMPTY, np.uint64)
        np.minimum.at(table, where, spread)
        table = table.reshape(n, bins)
        _densify(table)
        # hashed with the bin, so that a value that fills several bins agrees by chance in each by itself
        coded = (words.mix(table + _salts(bins)) & np.uint64(2**bits - 1)).astype(np.uint8)
        coded[table[:, 0] == _EMPTY] = 0
        out.append(coded)
    return np.concatenate(out) if out else np.zeros((0, bins), np.uint8)


def pack(rows: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Each row's codes, ``bits`` bits each, end to end."""
    flat = np.unpackbits(rows[:, :, None], axis=2)[:, :, 8 - bits :]
    return [r.tobytes() for r in np.packbits(flat.reshape(len(rows), -1), axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated similarity of rows of codes: equal codes, less those that are equal by chance (1 in 2**bits)."""
    chance = 2.0**-bits
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, as binary.

    Equal texts have equal fingerprints.  A text of fewer than five words counts as one
    shingle; null, empty and blank texts have the fingerprint of zeros, which is like itself
    and about as unlike any other as chance.  Repeated rows repeat; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(pack(codes(batch.column(1))), pa.binary())], names=["doc_id", "fingerprint"])

    return frames.in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, fingerprint binary")


_CHAIN = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMELESS = -(2**63)


def _chain(key, table):
    """The documents of a bucket in descending order; the guest, if there is one, follows the last."""
    table = table.sort_by([("guest", "ascending"), ("doc_id", "descending"), ("text", "descending")])
    guests = np.array(table["guest"].to_pylist())
    n = int((~guests).sum())
    if not n:
        return pa.table([pa.array([], f.type) for f in _CHAIN_ARROW], schema=_CHAIN_ARROW)
    texts = table["text"].to_pylist()[: n + 1]
    texts += texts[:1] if len(texts) == n else []
    edited = []
    for text, after in zip(texts, texts[1:]):
        k = len(text) // 3
        edited.append(text[: len(text) - k] + after[:k])
    own, changed = codes(pa.array(texts)), codes(pa.array(edited, pa.string()))
    return pa.table(
        [
            pa.array([None if i == _NAMELESS else i for i in table["doc_id"].to_pylist()[:n]], pa.int64()),
            pa.array(list(map(len, texts[:n])), pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([x.hex() for x in pack(own[:n])]),
            pa.array([x.hex() for x in pack(changed)]),
            pa.array(likeness(own[:n], changed)),
            pa.array(likeness(own[:n], own[1:])),
        ],
        schema=_CHAIN_ARROW,
    )


_CHAIN_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def chained(docs: DataFrame, bucket_mb: float = 4) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    Next is by descending doc_id, then descending text; rows without a doc_id come last, and
    after the last comes the first.  The edited text has its last third replaced by as many
    of the first characters of the next.  Documents lie in buckets by ranges of doc_id; each
    bucket gets the first document of the next one as a guest, so texts are shuffled once.

    A null text counts as empty; an only document is its own next.  Repeated rows follow one
    another and each have a row of the result.  Other columns are ignored, whatever they are
    called; an empty table gives an empty result.
    """
    size = frames.text_bytes(docs)
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = frames.range_buckets(named, max(1, round(size / (bucket_mb * 1e6))))
    # one row a bucket: the largest id of each goes to the next bucket above, the very largest to the lowest bucket
    tops = [(r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("doc_id")).orderBy("bucket").collect()]
    hosts = [(b, top, tops[(k + 1) % len(tops)][0]) for k, (b, top) in enumerate(tops)] if len(tops) > 1 else []
    columns = list(zip(*hosts)) or [[], [], []]
    host = frames.local(docs.sparkSession, bucket=pa.array(columns[0], pa.int32()), doc_id=pa.array(columns[1], pa.int64()), host=pa.array(columns[2], pa.int32()))
    guests = rows.join(F.broadcast(host), ["bucket", "doc_id"]).select(F.col("host").alias("bucket"), "doc_id", "text", F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests).groupBy("bucket").applyInArrow(_chain, _CHAIN)


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from chained() over all documents."""
    out = chained(frames.documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
