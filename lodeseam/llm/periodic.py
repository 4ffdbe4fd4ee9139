"""Runs: stretches of words that repeat with a period, found on a grammar of the texts.

The word ids of a slice of texts are compressed by Re-Pair.  Whatever is left of a text is then
paired up, neighbour with neighbour, so that each text is the root of a binary tree of
nonterminals.  A maximal run crosses the boundary between the two halves of exactly one
occurrence of a nonterminal that holds it whole; so each nonterminal's boundary is looked at
once, at its first occurrence, and what is found there is translated to all its occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, words

WORD = r"[^\x20\x09-\x0D]+"


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    joined = data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64)


def _disjoint(at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the pairs that start at ``at`` (ascending) are replaced: those of lower ``order`` first, equal ones from the left, none overlapping."""
    chosen = []
    while len(at):
        joins = np.diff(at) == 1
        head = np.ones(len(at), bool)
        head[1:] = ~joins | (order[1:] != order[:-1])  # first of a stretch of the same pair
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(at)) - 1
        touches = joins[heads[1:] - 1]  # does a stretch touch the one before it?
        less = touches & (order[heads[1:]] < order[heads[:-1]])
        more = touches & (order[heads[1:]] > order[heads[:-1]])
        best = np.ones(len(heads), bool)
        best[1:] &= ~more
        best[:-1] &= ~less
        stretch = np.cumsum(head) - 1
        pick = best[stretch] & ((np.arange(len(at)) - heads[stretch]) % 2 == 0)
        chosen.append(at[pick])
        gone = best[stretch]
        # a neighbour of a chosen pair overlaps it
        before = heads[best] - 1
        after = tails[best] + 1
        before = before[(before >= 0) & head[heads[best]]]
        before = before[joins[before]] if len(joins) else before[:0]
        last_even = (tails[best] - heads[best]) % 2 == 0
        after = after[(after < len(at)) & last_even]
        after = after[joins[after - 1]] if len(joins) else after[:0]
        gone[before] = True
        gone[after] = True
        at, order = at[~gone], order[~gone]
    return np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def nonterminals(ids: np.ndarray, first: np.ndarray):
    """Round by round: (low, middle, high, of, at): the words that each new nonterminal's first occurrence spans and where its halves
    meet, and for every occurrence of one of them its number and its first word.

    ``ids`` are the words of texts end to end, ``first`` where each text starts (n + 1 values).  A round
    replaces all pairs that occur at least twice, the most frequent first; when no pair does, neighbours pair up.
    """
    symbol, start = ids.copy(), np.arange(len(ids))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fresh, names, repeats = np.ones(len(ids), bool), int(ids.max()) + 1 if len(ids) else 0, True
    while len(symbol) > 1:
        same = text[1:] == text[:-1]
        if not same.any():
            return
        if repeats:
            at = np.flatnonzero(same & (fresh[1:] | fresh[:-1]))
            _, kind, count = np.unique(symbol[at] * names + symbol[at + 1], return_inverse=True, return_counts=True)
            often = count[kind] > 1
            at, kind = at[often], kind[often]
            rank = np.empty(len(count), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
            taken = _disjoint(at, rank[kind])
            repeats = len(taken) > 0
            if not repeats:
                continue
            kind = kind[np.searchsorted(at, taken)]
        else:
            place = np.arange(len(symbol)) - np.searchsorted(text, text)
            taken = np.flatnonzero(same & (place[:-1] % 2 == 0))
            kind = np.arange(len(taken))
        stop = np.append(start[1:], first[-1])  # symbols lie side by side
        _, one, number = np.unique(kind, return_index=True, return_inverse=True)
        low, middle, high = start[taken[one]], start[taken[one] + 1], stop[taken[one] + 1]
        yield low, middle, high, number, start[taken]
        symbol[taken] = names + number
        names += len(one)
        fresh = np.zeros(len(symbol), bool)
        fresh[taken] = True
        stays = np.ones(len(symbol), bool)
        stays[taken + 1] = False
        symbol, start, text, fresh = symbol[stays], start[stays], text[stays], fresh[stays]


class _Words:
    """The words of texts end to end: how far they agree with themselves some way on, and where pairs of them occur again."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.ids, self.first = ids, first
        words._grow(len(ids) + 1)
        self.power = words._powers
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(words.mix(ids.astype(np.uint64) + np.uint64(1)) * self.power[: len(ids)], out=self.sums[1:])
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inner = np.flatnonzero(self.text[1:] == self.text[:-1])
        most = int(ids.max()) + 1
        _, pair = np.unique(ids[inner] * most + ids[inner + 1], return_inverse=True)
        key = self.text[inner] * (int(pair.max()) + 1 if len(pair) else 1) + pair
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.cumsum(head) - 1
        self.seen = inner[order]  # pairs by text and words, then by place
        self.line = group * (len(ids) + 1) + self.seen  # ascending
        self.group, self.nth = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        self.group[self.seen], self.nth[self.seen] = group, np.arange(len(key))
        self.often = np.zeros(len(ids), bool)
        self.often[self.seen] = np.bincount(group, minlength=1)[group] >= 3 if len(key) else False

    def agree(self, at: np.ndarray, size: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Are the ``size`` words from ``at`` those from ``at + period``?  By hash: never false if they are."""
        here = (self.sums[at + size] - self.sums[at]) * self.power[period]
        return here == self.sums[at + period + size] - self.sums[at + period]

    def reach(self, at: np.ndarray, most: np.ndarray, period: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it), ``most`` at most, are those ``period`` words later."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.agree(at - middle if back else at, middle, period)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def _repeat(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as ``counts`` says, and how many of the same come before."""
    total = np.cumsum(counts)
    return np.repeat(np.arange(len(counts)), counts), np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def crossing(known: _Words, low: np.ndarray, middle: np.ndarray, high: np.ndarray, least: int, times: int):
    """(node, start, end, period) of the runs within [low, high) that cross ``middle``, of ``least`` words and ``times`` periods at least.

    One of the halves holds two periods of such a run, next to the boundary.  The two words at the
    boundary occur again one period later, or earlier: only those distances are tried.
    """
    node = np.flatnonzero((high - low >= least) & known.often[middle - 1])
    low, middle, high = low[node], middle[node], high[node]
    at, size = middle - 1, len(known.ids) + 1
    nth, group = known.nth[at], known.group[at]
    found = []
    for back in (False, True):
        room = (middle - low if back else high - middle) // 2
        edge = np.searchsorted(known.line, group * size + (at - room if back else at + room), "left" if back else "right")
        k, step = _repeat(np.maximum(nth - edge if back else edge - nth - 1, 0))
        other = known.seen[nth[k] - 1 - step if back else nth[k] + 1 + step]
        period = np.abs(other - at[k])
        fits = known.agree(middle[k] - 2 * period if back else middle[k], period, period)
        k, period = k[fits], period[fits]
        base = middle[k] - period if back else middle[k]
        before = known.reach(base, base - low[k], period, True)
        after = known.reach(base, high[k] - period - base, period, False)
        start, end = base - before, base + period + after
        long = end - start >= np.maximum(least, times * period)
        found.append([a[long] for a in (k, start, end, period)])
    k, start, end, period = (np.concatenate(a) for a in zip(*found))
    order = np.lexsort((period, end, start, k))
    k, start, end, period = k[order], start[order], end[order], period[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # of the same stretch, the smallest period
    return node[k[new]], start[new], end[new], period[new]


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of at least ``least`` words and ``times`` periods, times at least 4, by start and period."""
    if times < 4:
        raise ValueError("a run needs four periods, of which one half holds two")
    none = np.zeros(0, np.int64)
    if len(ids) < least:
        return none, none, none
    known, found = _Words(ids, first), [(none, none, none)]
    for low, middle, high, of, at in nonterminals(ids, first):
        node, start, end, period = crossing(known, low, middle, high, least, times)
        if not len(node):
            continue
        order = np.argsort(of, kind="stable")
        heads = np.searchsorted(of[order], np.arange(len(low) + 1))
        k, nth = _repeat((heads[1:] - heads[:-1])[node])
        move = at[order[heads[node[k]] + nth]] - low[node[k]]
        start, end, period = start[k] + move, end[k] + move, period[k]
        text = known.text[start]
        left, right = start == first[text], end == first[text + 1]
        left |= ids[start - 1] != ids[np.minimum(start - 1 + period, len(ids) - 1)]
        right |= ids[np.minimum(end, len(ids) - 1)] != ids[end - period]
        whole = left & right  # else part of a longer run, which another nonterminal holds
        found.append((start[whole], end[whole], period[whole]))
    start, end, period = (np.concatenate(a) for a in zip(*found))
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    k, step = _repeat(end - start - period)
    if len(k) and (ids[start[k] + step] != ids[start[k] + step + period[k]]).any():  # two hashes of unlike words were equal
        return _by_scan(ids, first, least, times)
    return start, end, period


def _by_scan(ids: np.ndarray, first: np.ndarray, least: int, times: int):
    """find_runs() by comparing every word with that each period later."""
    found = {}
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        for period in range(1, (high - low) // times + 1):
            same = np.concatenate([[False], ids[low : high - period] == ids[low + period : high], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a + period >= max(least, times * period):
                    found.setdefault((low + a, low + b + period), period)
    out = sorted((a, p, b) for (a, b), p in found.items())
    return tuple(np.array([x[k] for x in out], np.int64) for k in (0, 2, 1))


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each document's runs (start, length, period: word numbers from 0), and its text without their repeats.

    A run is a maximal stretch of words with smallest period ``period``, of at least ``least`` words and ``times`` (four
    or more) periods; runs are by start, then period.  ``collapsed`` are the words that no run holds after its first
    period, joined by one space.  A null or empty text, or one without words, has no runs and an empty text.  Rows are judged each by
    itself, repeated ones and those without a doc_id as well; other columns are ignored; an empty table gives an empty
    result.  A text lies in one task, however long: it takes some hundred bytes for each of its words.  Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            for low, high in words.pieces(offsets, 1 << 21):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                starts, ends, first = words.find_words(part, at)
                begin, end, period = find_runs(word_ids(part, starts, ends), first, least, times)
                text = np.searchsorted(first, begin, "right") - 1
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                each = pa.StructArray.from_arrays([pa.array(begin - first[text]), pa.array(end - begin), pa.array(period)], fields=list(kind))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(high - low + 1)), pa.int32()), each)
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(np.diff(first)), runs, _collapsed(part, starts, ends, first, begin + period, end)], names=["doc_id", "n_words", "runs", "collapsed"])

    return frames.in_arrow(rows, run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _collapsed(data, starts, ends, first, low, high) -> pa.Array:
    """The words of each text that lie in none of [low, high), joined by one space."""
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    kept = np.cumsum(change[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(kept)])[first]  # kept words before each text
    starts, sizes = starts[kept], (ends - starts)[kept] + 1
    sizes[before[1:][np.diff(before) > 0] - 1] -= 1  # no space after a text's last word
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    out = data[np.minimum(places, max(len(data) - 1, 0))] if len(places) else np.zeros(0, np.uint8)
    spaced = np.ones(len(sizes), bool)
    spaced[before[1:][np.diff(before) > 0] - 1] = False
    out[bounds[1:][spaced] - 1] = 32
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds[before].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` in which the words of every tenth document, by a checksum of its doc_id, repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tenth = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    tenth = tenth.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("w")})
    tenth = tenth.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.when(F.col("n") > 0, F.col("n")))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    picked = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    return tenth.select("doc_id", F.when(F.col("n") > 0, picked).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods at least in all documents, the longest of each, and digests of all runs and of what is left without repeats."""
    found = periodic_runs(repeated(frames.documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("first"), (-r["period"]).alias("least"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.least")
    return out.select("doc_id", "n_runs", (-F.col("best.first")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
