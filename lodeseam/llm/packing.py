"""Packing documents into windows of tokens: deficit round-robin over queues of sources.

Every window is a round: each queue is granted its share of the window's tokens on top of what it
is still owed, sends whole tokens, cutting documents where its grant ends, and carries the rest, a
fraction of a token, into the next round.  As a queue has sent the whole part of all grants so far, its
deficit at any window follows from the window's number alone, so every task starts its
documents' rounds where the tasks before it have left off, once it knows how many tokens of
the source come before them.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from lodeseam.llm import frames, words

# Kinds of bytes, the pairs of kinds between which a text may be cut without changing its tokens, and the pattern for which that holds.
LETTER, SIGN, HIGH, QUOTE, SPACE, CAPITAL = range(6)
CUTS = ((LETTER, SIGN), (LETTER, QUOTE), (SIGN, LETTER), (CAPITAL, SIGN), (CAPITAL, QUOTE), (SIGN, CAPITAL))
SPACES = b" \t\n\v\f\r"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def _kind(byte: int) -> int:
    text = bytes([byte])
    return HIGH if byte > 127 else SPACE if text in SPACES else QUOTE if text == b"'" else CAPITAL if text.isupper() else LETTER if text.islower() else SIGN


#: Translations of bytes: to kinds, and of two kinds (eight times the first and the second) to whether a piece begins at the second.
_KINDS = bytes(map(_kind, range(256)))
_BEGINS = bytes((x >> 3, x & 7) in CUTS or x >> 3 == SPACE != x & 7 for x in range(256))
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

#: Pieces of text whose ids a worker keeps; then it starts anew.
KEPT_PIECES = 1_000_000


class Encoder:
    """Token ids of texts, each followed by ``end_id``, without special tokens: their strings in a text are ordinary text.

    Texts are cut into pieces where neither the normalizer nor the pattern looks across, each
    different piece is encoded once, and the ids of a text are gathered from those of its
    pieces.  A tokenizer with another normalizer or pattern encodes whole texts.
    """

    def __init__(self, path: str, end_id: int):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.width = np.uint16 if self.full.get_vocab_size() <= 65536 and end_id <= 65535 else np.uint32
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        splits = [p.get("pattern", {}).get("Regex") for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_pieces = [s["type"] for s in steps] == NORMALIZERS and splits == [PATTERN, None] and said["model"].get("end_of_word_suffix") == "</w>"
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        for token, number in self.full.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, self.width), 1
        self.ids[0] = self.end_id
        self.starts, self.sizes, self.count = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int32), 1

    def _keep(self, pieces: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Give ``pieces`` the next slots; ``flat`` are their ids end to end, ``sizes`` how many each has."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(pieces) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[self.count : self.count + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : self.count + len(pieces)] = sizes
        self.slots.update(zip(pieces, range(self.count, self.count + len(pieces))))
        self.used, self.count = self.used + len(flat), self.count + len(pieces)

    def _learn(self, pieces: list[bytes]) -> None:
        plain, latin, other = [], [], []
        for piece in pieces:
            (plain if piece.isalpha() and piece.islower() else latin if _LATIN.fullmatch(piece.decode()) else other).append(piece)
        for some, tokenizer in ((plain, self.bare), (latin, self.full)):  # each is one word: its last token says so
            if some:
                flat = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
                at = np.flatnonzero(self.ends[flat]) + 1
                if len(at) != len(some):
                    raise AssertionError("a word is not one token run")
                self._keep(some, flat, np.diff(at, prepend=0))
        if other:
            found = [e.ids for e in self.full.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)]
            self._keep(other, np.array([i for ids in found for i in ids], np.int64), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, column):
        """For each range of rows of a string column: the ids of its texts end to end, and how many each text has."""
        data, offsets = words.utf8(column)
        for low, high in words.pieces(offsets, 1 << 22):
            part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            if self.by_pieces:
                yield self._by_pieces(part, at)
            else:
                texts = [part[a:b].tobytes().decode() for a, b in zip(at, at[1:])]
                found = [[*e.ids, self.end_id] for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
                yield np.array([i for ids in found for i in ids], self.width), np.fromiter(map(len, found), np.int64, len(found))

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(data), len(offsets) - 1
        if not n:
            return np.full(rows, self.end_id, self.width), np.ones(rows, np.int64)
        kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        begin = np.zeros(n, bool)
        begin[1:] = np.frombuffer(((kind[:-1] << np.uint8(3)) | kind[1:]).tobytes().translate(_BEGINS), bool)
        solid = kind != SPACE
        heads = offsets[:-1][np.diff(offsets) > 0]
        begin[heads] = solid[heads]
        lower = kind == CAPITAL
        safe = np.ones(n, bool)
        np.less(data[1:], 128, out=safe[:-1])  # a mark after a letter may go with the capital alone
        safe[heads[1:] - 1] = True  # what follows a text's last byte is another text
        lower &= safe
        kept = (data | (lower.view(np.uint8) << np.uint8(5))).tobytes().translate(None, SPACES)
        first = np.flatnonzero(begin)
        if not len(first):
            return np.full(rows, self.end_id, self.width), np.ones(rows, np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(solid, first, dtype=np.int64))])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
        pieces = found.dictionary.to_pylist()
        if self.count + len(pieces) > KEPT_PIECES:
            self._clear()
        new = [p for p in pieces if p not in self.slots]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))[found.indices.to_numpy()]
        of_row = np.searchsorted(first, offsets)
        slot = np.insert(slot, of_row[1:], 0)  # slot 0 is the end
        sizes = self.sizes[slot].astype(np.int64)
        total = np.cumsum(sizes)
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.starts[slot] - total + sizes, sizes)]
        return flat, np.diff(total[of_row[1:] + np.arange(rows)], prepend=0)


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


@dataclass(frozen=True)
class Layout:
    """Where the tokens of each queue lie in the stream of all.

    A stretch lasts until a queue runs dry: (its first place in the stream, its tokens, and how many each
    queue sends before and in it).  Within a stretch, each queue has sent the whole part of its grants
    at the end of every window.
    """

    length: int
    total: int
    stretches: tuple[tuple[int, int, tuple[int, ...], tuple[int, ...]], ...]

    @staticmethod
    def of(tokens: list[int], weights: list[float] | None, length: int) -> Layout:
        """The layout of queues of so many ``tokens``, by ``weights`` as long as all last; without weights all last to the end."""
        left, at, sent, found = list(tokens), 0, [0] * len(tokens), []
        while any(left):
            if weights is None:
                now = list(left)
            else:
                rate = [w if n else 0.0 for w, n in zip(weights, left)]
                if not any(rate):
                    rate = [float(n) for n in left]
                rounds = min(n / r for n, r in zip(left, rate) if r > 0)
                now = [n if r > 0 and n / r <= rounds else min(n, int(r * rounds)) for n, r in zip(left, rate)]
            found.append((at, sum(now), tuple(sent), tuple(now)))
            at += sum(now)
            sent = [a + b for a, b in zip(sent, now)]
            left = [a - b for a, b in zip(left, now)]
        return Layout(length, at, tuple(found))

    def sequence(self, place: int) -> tuple[int, int, int]:
        """(sequence, offset in it, place where it ends): whole windows, then the last tokens in powers of two, so that nothing is padded."""
        number, offset = divmod(place, self.length)
        start, rest = self.total - self.total % self.length, self.total % self.length
        if place < start:
            return number, offset, (number + 1) * self.length
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                if place < start + (1 << bit):
                    return number, place - start, start + (1 << bit)
                start, number = start + (1 << bit), number + 1
        raise IndexError(place)

    def pieces(self, queue: int, before: int, n: int):
        """(start, length, sequence, offset) of the pieces of a document of ``n`` tokens, ``before`` tokens after the start of its queue."""
        done = 0
        for first, size, sent, now in self.stretches:
            low, grant = sum(now[:queue]), now[queue]
            at = before + done - sent[queue]
            if not n - done:
                return
            if not grant or at >= grant:
                continue
            lead = lambda x: low * x // size  # noqa: E731, B023  what the queues before this one have sent
            mine = lambda x: (low + grant) * x // size - low * x // size  # noqa: E731, B023
            edge = lambda w: min(max(w * self.length - first, 0), size)  # noqa: E731, B023
            window = (first + at * size // grant) // self.length
            while mine(edge(window)) > at:
                window -= 1
            while at < grant and done < n:
                x0, x1 = edge(window), edge(window + 1)
                window += 1
                if (there := min(mine(x1) - at, n - done)) <= 0:
                    continue
                place = first + x0 + lead(x1) - lead(x0) + at - mine(x0)
                at += there
                while there:
                    number, offset, end = self.sequence(place)
                    length = min(there, end - place)
                    yield done, length, number, offset
                    done, place, there = done + length, place + length, there - length


def _tokens(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(part, row, doc_id, source, n, within, ids): each row's ids, and the tokens of its source before it in its part; stored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))

    def run(batches):
        encoder, part, row, seen = _encoder(path, end_id), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            at = 0
            for flat, counts in encoder.encode(batch.column(1)):
                sources = batch.column(2).slice(at, len(counts))
                within = []
                for source, n in zip(sources.to_pylist(), counts.tolist()):
                    within.append(seen.get(source, 0))
                    seen[source] = within[-1] + n
                bounds = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
                numbers = pa.array(np.arange(row, row + len(counts)))
                yield pa.record_batch([pa.array(np.full(len(counts), part, np.int32)), numbers, batch.column(0).slice(at, len(counts)), sources, pa.array(counts), pa.array(within, pa.int64()), ids.cast(pa.binary())], names=["part", "row", "doc_id", "source", "n", "within", "ids"])
                at, row = at + len(counts), row + len(counts)

    return frames.stored(frames.in_arrow(rows, run, "part int, row long, doc_id long, source string, n long, within long, ids binary"), "tokens")


def _in_turn(rows: DataFrame) -> DataFrame:
    """(part, row, before) of ``rows`` (part, row, source, n, due): the tokens before each in order of due, source, part and row."""

    def run(batches):
        slot, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = total + np.cumsum(n)
            total = int(ends[-1]) if len(n) else total
            yield pa.record_batch([pa.array(np.full(len(n), slot, np.int32)), batch.column(0), batch.column(1), pa.array(ends - n), batch.column(2)], names=["slot", "part", "row", "ahead", "n"])

    order = ("due", "source", "part", "row")
    lined = frames.stored(frames.in_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "row", "n"), run, "slot int, part int, row long, ahead long, n long"), "lined")
    slots = lined.groupBy("slot").agg(F.sum("n").alias("tokens"))  # as many as there are partitions
    slots = slots.select("slot", (F.sum("tokens").over(Window.orderBy("slot")) - F.col("tokens")).alias("first"))
    return lined.join(F.broadcast(slots), "slot").select("part", "row", (F.col("first") + F.col("ahead")).alias("before"))


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2, weights: dict[str, float] | None = None, least: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, in sequences of up to ``length`` tokens.

    A document is its ids and ``end_id``; ``ids`` are a piece's, as little-endian unsigned 32-bit numbers.
    Every full window holds each queue's share within one token, and the last tokens make
    sequences of powers of two, so that none is padded.  ``weights`` are the shares of sources
    in a window; what they leave of 1 goes to all other sources together.  A source that
    runs dry leaves its share to the others.  Without weights every source's share is that of all tokens
    that it has, so that all last to the end.  A source's queue is in the order in which its rows are read.

    Sources that are due fewer than ``least`` tokens a window share one queue, in which the
    documents line up by the part of their source that comes before them; so there are at most
    ``length / least`` queues and one more, and no piece is cut for a few tokens.

    A null or empty text is the end id alone, a null source the source "".  Repeated rows and
    rows without a doc_id are packed each for itself; other columns are ignored; an empty
    table gives an empty result.  A text lies in one task, however long.  Ids are stored once (two bytes each) and are not
    shuffled, unless sources times parts are more than ``frames.BROADCAST_KEYS``.
    """
    if length < 1 or least < 1 or any(w < 0 for w in (weights or {}).values()) or sum((weights or {}).values()) > 1 + 1e-9:
        raise ValueError("length and least must be positive, weights not negative and 1 in total at most")
    tokens = _tokens(docs, path, end_id, id_col, text_col, source_col)
    parts = frames.stored(tokens.groupBy("source", "part").agg(F.sum("n").alias("tokens")), "parts")
    sources = parts.groupBy("source").agg(F.sum("tokens").alias("all"))
    total = sources.agg(F.sum("all")).first()[0] or 0
    if weights is None:
        own = {r.source: r.all for r in sources.where(F.col("all") >= F.lit(-(-least * total // length)).cast("long")).collect()}
        shares = None
    else:
        named = [s for s, w in weights.items() if w * length >= least]
        own = {r.source: r.all for r in sources.where(F.col("source").isin(named)).collect()}
    names = sorted(own)
    counts = [own[s] for s in names] + [total - sum(own.values())]
    if weights is not None:
        shares = [weights[s] for s in names] + [max(0.0, 1.0 - sum(weights[s] for s in names))]
    layout = Layout.of(counts, shares, length)

    queues = frames.local(docs.sparkSession, name=pa.array(names, pa.string()), queue=pa.array(range(len(names)), pa.int32()))
    by_part = Window.partitionBy("source").orderBy("part")
    bases = parts.join(F.broadcast(queues), F.col("source") == F.col("name"), "left").select("source", "part", F.coalesce("queue", F.lit(len(names))).alias("queue"), (F.sum("tokens").over(by_part) - F.col("tokens")).alias("base"))
    bases = frames.stored(bases, "bases")
    placed = tokens.join(F.broadcast(bases) if bases.count() <= frames.BROADCAST_KEYS else bases, ["source", "part"]).withColumn("before", F.col("base") + F.col("within"))
    if counts[-1]:
        small = placed.where(F.col("queue") == len(names)).join(sources, "source")
        turns = _in_turn(small.select("part", "row", "source", "n", (F.col("before") / F.col("all")).alias("due")))
        few = frames.stored(turns, "turns")
        mine = placed.where(F.col("queue") == len(names)).drop("before").join(F.broadcast(few) if few.count() <= frames.BROADCAST_KEYS else few, ["part", "row"])
        placed = placed.where(F.col("queue") < len(names)).unionByName(mine) if names else mine

    def cut(batches):
        width = _encoder(path, end_id).width
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, source, n, ids, queue, before in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, width).astype("<u4")
                for start, size, number, offset in layout.pieces(queue, before, n):
                    for column, value in zip(out, (doc, source, start, size, ids[start : start + size].tobytes(), n, number, offset)):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=_PIECES)

    schema = ", ".join(f"{n} {k}" for n, k in zip(_PIECES, ("long", "string", "long", "long", "binary", "long", "long", "long")))
    return frames.in_arrow(placed.select("doc_id", "source", "n", "ids", "queue", "before"), cut, schema)


_PIECES = ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, ids): the pieces of pack() put together; a sequence is as long as its window at most."""
    lined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("lined"))
    return lined.select("sequence_id", "n_tokens", "n_pieces", F.unhex(F.concat_ws("", F.transform("lined", lambda p: p["ids"]))).alias("ids"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, every source at its share of all tokens in every window."""
    pieces = pack(frames.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
