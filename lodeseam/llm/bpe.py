"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Two facts carry the method.  The encoding of a prefix of an encoding's bytes, cut at a token
border, is the prefix of its tokens; and a sequence of tokens is the encoding of its bytes
if and only if that holds for every two neighbours.  So each byte prefix has exactly one
valid last token: the one that ends there and fits the last token of the prefix before it.
A table of last tokens holds the encodings of all prefixes.  Appending extends it; after an
edit it is computed anew only until it agrees with the old table for as many positions in a
row as the longest token has bytes.
"""

from __future__ import annotations

import base64
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, words


class _Lookup:
    """Integers by integer keys, for arrays of keys at a time: open addressing."""

    def __init__(self, found: dict[int, int]):
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        self._bits = max(4, (2 * len(keys)).bit_length())
        self._keys, self._values = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[at[left]] < 0]
            self._keys[at[free]] = keys[free]  # of those that want one slot, one is in
            placed = self._keys[at[left]] == keys[left]
            self._values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = self._slot(keys)
        there = self._keys[at]
        out = np.where(there == keys, self._values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self._bits) - 1)
            there, want = self._keys[at[left]], keys[left]
            hit = there == want
            out[left[hit]] = self._values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Vocabulary:
    """Tokens by bytes, their order of merging (the rank is the id), and which neighbours fit.

    A merged token must rank after the two tokens that it is merged from, as it does in every
    vocabulary that was trained by merging.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._size = size
        #: The rank at which a token is merged (-1 for a byte), and the two tokens that it is merged from.
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        #: The tokens that are the encoding of their own bytes; no other is ever the last of a prefix.
        self.whole: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self.merged(token, 2)
                if len(halves) > 2:
                    continue
                a, b = halves
                if max(self.made[a], self.made[b]) > rank:
                    raise ValueError(f"token {rank} ranks before a token that it is merged from")
                self.made[rank], self.left[rank], self.right[rank] = rank, a, b
            self.whole[token] = rank
        #: Finds all of them that end at a byte, in text that has a character for each byte.
        self.ending = ahocorasick.Automaton()
        for token, rank in self.whole.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), rank))
        self.ending.make_automaton()

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The encoding by its definition: merge the neighbours of least rank, the leftmost first, while there are any (and more than ``least`` parts)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self._size), i) for i in range(len(parts) - 1))
            if rank == self._size:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Is [a, b] the encoding of its bytes?

        If not, some merge reaches over the border between the two.  Undoing the merges of both
        from the last to the first gives each pair that ever meets there; such a pair merges if
        its own rank is less than that of the merge that was undone last (the same rank goes
        to the leftmost).
        """
        ranks, tokens, made, limit = self.ranks, self.tokens, self.made, self._size
        while True:
            if ranks.get(tokens[a] + tokens[b], self._size) < limit:
                return False
            if made[a] > made[b]:
                limit, a = made[a], self.right[a]
            elif made[b] >= 0:
                limit, b = made[b] + 1, self.left[b]
            else:
                return True

    @cached_property
    def arrays(self) -> _Arrays:
        return _Arrays(self)


class _Arrays:
    """The vocabulary as arrays, to fill the prefix tables of many pieces at a time."""

    def __init__(self, v: Vocabulary):
        self._size = v._size
        self.made, self.left, self.right = (np.array(x, np.int32) for x in (v.made, v.left, v.right))
        self.lengths = np.array([len(t) for t in v.tokens], np.int32)
        steps: dict[int, int] = {}
        ends = [-1]
        merges: dict[int, int] = {}
        for token, rank in v.whole.items():
            node = 0
            for byte in token:
                node = steps.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = rank
        for token, rank in v.ranks.items():  # any two neighbours merge that make a token end to end
            for k in range(1, len(token)):
                a, b = v.whole.get(token[:k]), v.whole.get(token[k:])
                if a is not None and b is not None:
                    merges[a * v._size + b] = rank
        self.steps, self.ends, self.merges = _Lookup(steps), np.array(ends, np.int32), _Lookup(merges)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.fits() of each pair."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), self._size, np.int32)
        while len(live):
            rank = self.merges(a.astype(np.int64) * self._size + b)
            merged = (rank >= 0) & (rank < limit)
            out[live[merged]] = False
            made_a, made_b = self.made[a], self.made[b]
            undo_a = made_a > made_b
            limit = np.where(undo_a, made_a, made_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            more = ~merged & (np.maximum(made_a, made_b) >= 0)
            live, limit, a, b = live[more], limit[more], a[more], b[more]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and where each piece's begin (one more)."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        borders = np.cumsum([0, *map(len, pieces)])
        begin = np.repeat(borders[:-1], np.diff(borders))
        # the tokens at each byte, of all lengths at a time
        starts, node, last_start, found = np.arange(len(data)), np.zeros(len(data), np.int64), np.repeat(borders[1:], np.diff(borders)), []
        for step in range(len(data)):
            node = self.steps(node << 8 | data[starts + step]).astype(np.int64)
            going = node >= 0
            starts, node, last_start = starts[going], node[going], last_start[going]
            token = self.ends[node]
            hit = token >= 0
            found.append((starts[hit], starts[hit] + step, token[hit]))
            going = starts + step + 1 < last_start
            starts, node, last_start = starts[going], node[going], last_start[going]
            if not len(starts):
                break
        start, end, token = (np.concatenate(x) for x in zip(*found))
        # the one valid last token of each prefix, of all pieces at a time
        within = (end - begin[end]).astype(np.int32)
        order = np.argsort(within, kind="stable")
        start, end, token = start[order], end[order], token[order]
        last = np.full(len(data), -1, np.int32)
        counts = np.cumsum([0, *np.bincount(within)])
        for low, high in zip(counts[:-1].tolist(), counts[1:].tolist()):
            s, e, t = start[low:high], end[low:high], token[low:high]
            inner = np.flatnonzero(s > begin[e])
            good = np.ones(high - low, bool)
            good[inner] = self.fits(last[s[inner] - 1], t[inner])
            last[e[good]] = t[good]
        if (last < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        # from the end backwards
        at, piece, out = borders[1:].copy(), np.arange(len(pieces)), []
        at, piece = at[at > borders[:-1]], piece[at > borders[:-1]]
        while len(at):
            t = last[at - 1]
            out.append((piece, t))
            at = at - self.lengths[t]
            going = at > borders[piece]
            at, piece = at[going], piece[going]
        owner, ids = (np.concatenate([x[i] for x in out[::-1]]) if out else np.zeros(0, np.int32) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(pieces)))])


class PrefixTable:
    """The encodings of all prefixes of some bytes: last[i] is the last token of the first i + 1 of them."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, high: int, agree=None) -> int:
        """Fill the table up to ``high`` positions, or until agree() of a new position says so; where it ends."""
        last, v, done = self.last, self.vocabulary, len(self.last)
        base = max(0, len(self.last) - v.longest)
        for end, (length, token) in v.ending.iter(self.data[base:high].decode("latin-1")):
            end += base
            if end < done:
                continue
            if length <= end and not v.fits(last[end - length], token):
                continue
            last.append(token)
            done += 1
            if agree is not None and agree(end):
                return done
        if done < high:
            raise ValueError("the vocabulary lacks a byte of the text")
        return high

    def append(self, more: bytes) -> None:
        """Extend the table by ``more``: exact, and what is there stays."""
        self.data += more
        self._extend(len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start..end; the number of positions that were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old[:start], 0

        def agree(i: int) -> bool:
            nonlocal same
            same = same + 1 if i >= start + len(new) and self.last[i] == old[i - shift] else 0
            return same >= self.vocabulary.longest

        stop = self._extend(len(self.data), agree)
        self.last += old[stop - shift :]
        return stop - start

    def ids(self, size: int | None = None) -> list[int]:
        """The encoding of the first ``size`` bytes (all of them): from the end backwards."""
        at, out = len(self.data) if size is None else size, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """Encodings (32-bit ids as bytes) of the pieces met most recently."""

    LIMIT = 40_000
    #: Longer pieces have a table each; of shorter ones, so many bytes are encoded at a time.
    SHORT, AT_ONCE = 64, 1 << 16

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        self.learn({piece})
        return self[piece]

    def learn(self, pieces: set[str]) -> None:
        """Encode those of the pieces that are not known."""
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        ranks, some, size = self.vocabulary.ranks, [], 0
        for piece in sorted(pieces.difference(self), key=len):  # alike lengths together
            if (known := self.older.get(piece)) is not None:
                self[piece] = known
            elif (rank := ranks.get(piece.encode())) is not None:  # a piece that is a token is not merged
                self[piece] = np.int32(rank).tobytes()
            elif len(piece) > self.SHORT:
                self[piece] = np.array(PrefixTable(self.vocabulary, piece.encode()).ids(), np.int32).tobytes()
            else:
                some.append(piece)
                size += len(piece)
                if size > self.AT_ONCE:
                    self._together(some)
                    some, size = [], 0
        if some:
            self._together(some)

    def _together(self, pieces: list[str]) -> None:
        ids, at = self.vocabulary.arrays.encode([p.encode() for p in pieces])
        raw, at = ids.tobytes(), (4 * at).tolist()
        self.update((p, raw[i:j]) for p, i, j in zip(pieces, at, at[1:]))


@cache
def load(path: str) -> Vocabulary:
    """The vocabulary of a file of lines ``base64-of-token rank``."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


@cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(load(path))


def _encode(path: str, pattern: str):
    def run(batches):
        split, cached = regex.compile(pattern).findall, _pieces(path)
        for batch in batches:
            _, offsets = words.utf8(batch.column(1))
            for low, high in words.pieces(offsets, 1 << 19):
                rows = batch.slice(low, high - low)
                parts = [split(text) if text else [] for text in rows.column(1).to_pylist()]
                cached.learn(set().union(*parts))
                found = [b"".join(map(cached.__getitem__, p)) for p in parts]
                at = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(at.astype(np.int32), np.frombuffer(b"".join(found), np.int32))
                yield pa.record_batch([rows.column(0), ids], names=["doc_id", "ids"])
        # a worker outlives its task: what later stages need is memory
        cached.clear()
        cached.older = {}

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text.

    Each match of ``pattern`` is encoded by itself, without special tokens.  A null or empty
    text has no ids; repeated rows and rows without a doc_id are encoded like any other;
    other columns are ignored.  ``path`` is read by the tasks, so it has to be there on the
    executors.
    """
    return frames.in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), _encode(path, pattern), f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def _decode(path: str):
    def run(batches):
        tokens = load(path).tokens
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([0, *map(len, tokens)])
        for batch in batches:
            for low in range(0, len(batch), 250):
                rows = batch.slice(low, 250)
                lists = rows.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = ends[ids + 1] - ends[ids]
                at = np.concatenate([[0], np.cumsum(sizes)])
                source = np.repeat(ends[ids] - at[:-1], sizes) + np.arange(at[-1])
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                borders = at[np.concatenate([[0], np.cumsum(counts)])]
                text = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data[source])])
                yield pa.record_batch([*rows.columns, text.cast(pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids): the bytes of each row's tokens, end to end; none for null."""
    return frames.in_arrow(encoded.select("doc_id", "ids"), _decode(path), f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass of one Python worker a task: (doc_id, ids, decoded)."""
    encoder, decoder = _encode(path, pattern), _decode(path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frames.in_arrow(rows, lambda batches: decoder(encoder(batches)), f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, decoded binary")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's digests: encode all documents, then decode the ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = round_trip(frames.documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
