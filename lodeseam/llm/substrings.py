"""Repeated passages: fixed-block anchors.

Every document is cut into blocks of ``block`` words that do not overlap.  A window of
``window >= 2 * block - 1`` words holds one whole block wherever it starts, so two equal
windows always share an anchor: a block of the one and a rolling window of the other.

1. Anchors.  Documents lie in buckets by ranges of doc_id.  Each bucket sends the hashes of
   its distinct rolling block-wide windows, with a flag for those that are blocks, to shards
   of the hash space; a shard answers with a bit for each hash that is a block somewhere
   and occurs more than once.
2. Extension.  A hit is extended to all windows of ``window`` words around it.  Their
   fingerprints (96 bits, and the shard) go to shards too; the answer is a bit for each that
   an earlier bucket also has: so far an earlier text goes on alike, whichever text that is.  Within a bucket the first occurrence is known, and only that
   one is sent, so a passage in a third of all documents costs one entry a bucket.
3. Consecutive repeated windows join to maximal repeats, which are cut.

Both exchanges carry sorted hashes and answer with bits; texts are shuffled once (the three
steps read the same exchange).  Hashes stand for words, which are not compared themselves: the
two parts of a fingerprint come from two word hashes of their own (64 bits each), so two
different windows count as equal with a probability of about 2**-96 for a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, words

_MESSAGE = "bucket int, shard int, hashes binary, flags binary"
_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept_text string"
_U32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def _message(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "shard", "hashes", "flags"])


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance: the high ones of sorted values repeat, which the shuffle's compression uses."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(blob, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class _Bucket:
    """The documents of a bucket in order, with their words' hashes (``second``: of both kinds)."""

    def __init__(self, table: pa.Table, second: bool = True):
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_ids = table["doc_id"]
        self.data, self.offsets = words.utf8(table["text"])
        starts, ends, hashes, others, first = [], [], [], [], [np.zeros(1, np.int64)]
        for low, high in words.pieces(self.offsets, 1 << 20):
            base = self.offsets[low]
            part = self.data[base : self.offsets[high]]
            s, e, f = words.find_words(part, self.offsets[low : high + 1] - base)
            hashes.append(words.hash_words(part, s, e))
            if second:
                others.append(words.hash_words(part, s, e, words.BYTES_OTHER))
            starts.append(s + base)
            ends.append(e + base)
            first.append(f[1:] + first[-1][-1])
        self.starts, self.ends, self.hashes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, hashes))
        self.first = np.concatenate(first)
        self.hashes = self.hashes.astype(np.uint64)
        self.others = np.concatenate(others) if others else np.zeros(0, np.uint64)

    def anchors(self, block: int, shards: int):
        """Sorted distinct keys (shard, 32 bits) of the rolling windows; each window's index there; its place in the words."""
        at = np.flatnonzero(words.inside(self.first, block))
        rolled = words.roll(self.hashes, block)[at]
        keys = ((rolled >> _U32) % np.uint64(shards)) << _U32 | rolled & _LOW
        keys, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return keys, index, counts, at

    def places(self) -> np.ndarray:
        """Each word's place in its document."""
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))

    def fingerprints(self, at: np.ndarray, window: int, shards: int):
        """Of the windows at ``at``: sorted distinct (shard, 64 bits, 32 bits), each window's index there, first occurrences."""
        a = words.roll(self.hashes, window)[at]
        b = words.roll(self.others, window, 0xD1342543DE82EF95)[at] & _LOW
        shard = (a >> _U32) % np.uint64(shards)
        order = np.lexsort((b, a, shard))
        a, b, shard = a[order], b[order], shard[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        keep = np.flatnonzero(new)
        return a[keep], b[keep].astype(np.uint32), shard[keep].astype(np.int64), index


def _runs(shard_of: np.ndarray):
    """(shard, low, high) of each run of equal values."""
    if not len(shard_of):
        return
    cuts = np.flatnonzero(np.diff(shard_of)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(shard_of)]):
        yield int(shard_of[low]), int(low), int(high)


def _send_anchors(block: int, shards: int):
    def send(key, table):
        bucket = _Bucket(table, second=False)
        keys, index, counts, at = bucket.anchors(block, shards)
        aligned = np.zeros(len(keys), bool)
        aligned[index[bucket.places()[at] % block == 0]] = True
        low, out = (keys & _LOW).astype(np.uint32), []
        for s, i, j in _runs((keys >> _U32).astype(np.int64)):
            out.append((key[0].as_py(), s, _planes(low[i:j]), _bits(np.concatenate([aligned[i:j], counts[i:j] > 1]))))
        return _message(out)

    return send


def _match_anchors(key, table):
    blobs = [_values(x, np.uint32) for x in table["hashes"].to_pylist()]
    ends = np.cumsum([0, *map(len, blobs)])
    flags = [_flags(x, 2 * len(b)) for x, b in zip(table["flags"].to_pylist(), blobs)]
    is_block = np.concatenate([f[: len(b)] for f, b in zip(flags, blobs)])
    many = np.concatenate([f[len(b) :] for f, b in zip(flags, blobs)])
    distinct, index = np.unique(np.concatenate(blobs), return_inverse=True)
    hit = (np.bincount(index, is_block, len(distinct)) > 0) & (np.bincount(index, 1 + many, len(distinct)) > 1)
    hit = hit[index]
    out = [(b, key[0].as_py(), None, _bits(hit[i:j])) for b, i, j in zip(table["bucket"].to_pylist(), ends[:-1], ends[1:]) if hit[i:j].any()]
    return _message(out)


def _send_candidates(block: int, window: int, shards: int):
    def send(key, table, answers):
        bucket = _Bucket(table)
        keys, index, _, at = bucket.anchors(block, shards)
        hit = np.zeros(len(keys), bool)
        said = dict(zip(answers["shard"].to_pylist(), answers["flags"].to_pylist()))
        for s, i, j in _runs((keys >> _U32).astype(np.int64)):
            if s in said:
                hit[i:j] = _flags(said[s], j - i)
        anchored = np.zeros(len(bucket.hashes) + 1, np.int64)
        anchored[at[hit[index]] + 1] = 1
        anchored = np.cumsum(anchored)
        whole = np.flatnonzero(words.inside(bucket.first, window))
        candidate = anchored[whole + window - block + 1] > anchored[whole]
        a, b, shard, _ = bucket.fingerprints(whole[candidate], window, shards)
        name = key[0].as_py()
        # the candidates come back to this bucket with the answers
        out = [(name, name % shards, None, _bits(candidate))] if candidate.any() else []
        for s, i, j in _runs(shard):
            out.append((name, s, _planes(a[i:j]) + _planes(b[i:j]), b""))
        return _message(out)

    return send


def _match_candidates(key, table):
    out, names, firsts, seconds = [], [], [], []
    for name, hashes, flags in zip(table["bucket"].to_pylist(), table["hashes"].to_pylist(), table["flags"].to_pylist()):
        if hashes is None:
            out.append((name, -1, None, flags))
        else:
            n = len(hashes) // 12
            names.append(name)
            firsts.append(_values(hashes[: 8 * n], np.uint64))
            seconds.append(_values(hashes[8 * n :], np.uint32))
    if names:
        ends = np.cumsum([0, *map(len, firsts)])
        owner = np.repeat(names, np.diff(ends))
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        order = np.lexsort((owner, b, a))
        later = np.zeros(len(order), bool)
        later[1:] = (np.diff(a[order]) == 0) & (np.diff(b[order]) == 0)
        earlier_elsewhere = np.empty(len(order), bool)
        earlier_elsewhere[order] = later
        out += [(x, key[0].as_py(), None, _bits(earlier_elsewhere[i:j])) for x, i, j in zip(names, ends[:-1], ends[1:])]
    return _message(out)


def _cut(window: int, shards: int):
    def cut(key, table, answers):
        bucket = _Bucket(table)
        n = len(bucket.hashes)
        said = dict(zip(answers["shard"].to_pylist(), answers["flags"].to_pylist()))
        delta = np.zeros(n + 1, np.int64)
        if -1 in said:
            whole = np.flatnonzero(words.inside(bucket.first, window))
            at = whole[_flags(said[-1], len(whole))]
            a, _, shard, index = bucket.fingerprints(at, window, shards)
            repeated = np.zeros(len(a), bool)
            for s, i, j in _runs(shard):
                repeated[i:j] = _flags(said[s], j - i)
            opening = np.ones(len(at), bool)  # the first in this bucket: ``at`` ascends
            opening[np.unique(index, return_index=True)[1]] = False
            at = at[repeated[index] | opening]
            delta[at] += 1
            delta[at + window] -= 1  # windows are distinct places, so no index repeats in one statement
        covered = np.cumsum(delta[:-1]) > 0
        return _cut_rows(bucket, covered)

    return cut


def _cut_rows(bucket: _Bucket, covered: np.ndarray) -> pa.Table:
    first, n_docs = bucket.first, len(bucket.doc_ids)
    total = np.concatenate([[0], np.cumsum(covered)])
    removed = total[first[1:]] - total[first[:-1]]
    # spans: maximal runs of covered words within a document
    edge = np.zeros(len(covered) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]])))
    end = np.flatnonzero(covered & (edge[1:] | ~np.concatenate([covered[1:], [False]]))) + 1
    owner = np.searchsorted(first, begin, "right") - 1
    span_at = np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(span_at, pa.StructArray.from_arrays([pa.array(begin - first[owner]), pa.array(end - first[owner])], names=["first", "last"]))
    texts = []
    for d in range(n_docs):
        keep = np.flatnonzero(~covered[first[d] : first[d + 1]]) + first[d]
        base = bucket.offsets[d]
        raw = bucket.data[base : bucket.offsets[d + 1]].tobytes()
        if len(keep) == first[d + 1] - first[d]:
            texts.append(b" ".join(raw.split()))
        else:
            texts.append(b" ".join([raw[i:j] for i, j in zip((bucket.starts[keep] - base).tolist(), (bucket.ends[keep] - base).tolist())]))
    return pa.table([bucket.doc_ids, pa.array(np.diff(first)), pa.array(removed.astype(np.int64)), spans, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 20, block: int | None = None, bucket_mb: float = 4, shard_mb: float = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without the passages of ``window`` or more words that already start earlier.

    Earlier means in a document of smaller id, or before in the same one.  Rows of the same
    id are ordered by text, and rows without an id come last.  Windows are judged on the
    input.  A null or empty text has no words; other columns are ignored; an empty table
    gives an empty result; a repeated row loses all its windows.  Returns (doc_id, n_words,
    n_removed, spans, kept_text): spans are the maximal repeats in words, last exclusive,
    and kept_text the words left, joined by one space.

    ``bucket_mb`` and ``shard_mb`` bound what one task holds (of text, and of the text that
    an average shard stands for).  Raise both on executors with more memory: the messages
    are as many as buckets times shards.
    """
    block = block or (window + 1) // 2
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts: window >= 2 * block - 1")
    size = frames.text_bytes(docs, text_col)
    shards = max(1, round(size / (shard_mb * 1e6)))
    rows = frames.range_buckets(docs, max(1, round(size / (bucket_mb * 1e6))), id_col, text_col)
    by_bucket = rows.groupBy("bucket")
    anchors = by_bucket.applyInArrow(_send_anchors(block, shards), _MESSAGE)
    hits = anchors.groupBy("shard").applyInArrow(_match_anchors, _MESSAGE)
    candidates = by_bucket.cogroup(hits.groupBy("bucket")).applyInArrow(_send_candidates(block, window, shards), _MESSAGE)
    repeats = candidates.groupBy("shard").applyInArrow(_match_candidates, _MESSAGE)
    return by_bucket.cogroup(repeats.groupBy("bucket")).applyInArrow(_cut(window, shards), _OUT)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of remove_repeats() over all documents."""
    out = remove_repeats(frames.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
marked AS (SELECT word.doc_id, word.word, word.p, covered.p IS NOT NULL AS gone FROM word LEFT JOIN covered USING (doc_id, p)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS opens FROM marked),
said AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept, CAST(count(*) FILTER (opens) AS BIGINT) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN said USING (doc_id)
"""
