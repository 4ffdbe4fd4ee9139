"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

One-line wordings, too short for shingles, are looked up word by word; see scan().
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, notices, words

#: The standard notices of common licenses, by SPDX identifier (":" tells notices of one license apart).
TEMPLATES = {
    "Apache-2.0:short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT:short": "Released under the MIT License.",
    "MIT:header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0:short": "licensed under the GNU General Public License, version 3.",
    "GPL-3.0:header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause:header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-4.0:short": "licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0:short": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0:header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

WIDTH = 5
#: Bands of one value each: the chance to miss a window with similarity J is (1 - J) ** BANDS.
BANDS = 56
_FACTORS = np.random.default_rng(23).integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(2**64 - 1)
#: Words here are runs of letters, digits and bytes beyond ASCII, in lower case.
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def split_words(column, size: int = 1 << 20):
    """For each range of rows: its first row, the words' hashes, and each row's first word."""
    data, offsets = words.utf8(column)
    for low, high in words.pieces(offsets, size):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = words.find_words(part, at, _BREAKS)
        yield low, words.hash_words(part, starts, ends, words.BYTES_LOWER), first


def window_similarity(n_shingles: int, half: int, containment: float) -> float:
    """The least similarity of a template to the window that holds it, if ``containment`` of its shingles are there."""
    common = math.ceil(containment * n_shingles)
    return common / (3 * half + n_shingles - common)


class Templates:
    """Templates by the size of window that they are looked for in: three steps of ``half`` shingles, of which two hold a template."""

    def __init__(self, texts: dict[str, str], containment: float, bands: int = BANDS, miss: float = 1e-5):
        self.containment = containment
        self.names = sorted(texts)
        self.sets, self.by_half, self.places = {}, {}, {}
        for name in self.names:
            ((_, hashes, _),) = split_words(pa.array([texts[name]]))
            rolled, place = np.unique(words.roll(hashes, min(WIDTH, len(hashes))), return_index=True)
            if len(hashes) < WIDTH:
                raise ValueError(f"{name}: a template has at least {WIDTH} words")
            half = 2 ** math.ceil(math.log2(max(1, math.ceil((len(hashes) - WIDTH + 1) / 2))))
            if (1 - window_similarity(len(rolled), half, containment)) ** bands > miss:
                raise ValueError(f"{name}: {bands} bands may miss it with more than {miss}")
            self.sets[name], self.places[name] = rolled, (place, len(hashes) - WIDTH + 1)
            signature = (rolled[None, :] * _FACTORS[:bands, None]).min(axis=1)
            self.by_half.setdefault(half, []).append((name, signature))


@lru_cache(4)
def _compiled(items: tuple, containment: float) -> Templates:
    return Templates(dict(items), containment)


def _grams(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` words from each of the places ``at``, which must lie inside."""
    if not len(at):
        return np.zeros(0, np.uint64)
    return words.roll(hashes[at[:, None] + np.arange(width)].reshape(-1), width)[::width]


def _phrases(spoken) -> dict[int, dict[int, str]]:
    """{number of words: {hash: phrase}}"""
    spoken, out = list(spoken), {}
    at = 0
    for _, hashes, first in split_words(pa.array(spoken)):
        for low, high in zip(first[:-1], first[1:]):
            out.setdefault(int(high - low), {})[int(words.roll(hashes[low:high], int(high - low))[0])] = spoken[at]
            at += 1
    return out


class Wordings:
    """One-line grants, a lead and a license's name word by word, and the words that decide between sibling templates."""

    def __init__(self, leads, articles, names: dict[str, str], deciding: dict[str, tuple[str, ...]]):
        self.leads, self.articles, self.names, self.spdx = _phrases(leads), _phrases(articles), _phrases(names), names
        self.versioned = {n for n in names if n[-1].isdigit()}
        self.numbers = set(_phrases(str(n) for n in range(100))[1])
        self.deciding = {name: [(w, h) for phrase in phrases for w, hs in _phrases([phrase]).items() for h in hs] for name, phrases in deciding.items()}
        # a lead is looked for where its first word is
        self.begins = np.unique(np.concatenate([hashes[first[:-1]] for _, hashes, first in split_words(pa.array(list(leads)))]))

    def decided(self, name: str, span: np.ndarray) -> bool:
        """Do the words of ``span`` hold all that tells ``name`` from its siblings?"""
        return all(h in words.roll(span, w) for w, h in self.deciding.get(name, ()))

    def find(self, hashes: np.ndarray, first: np.ndarray) -> list[list[tuple]]:
        """For each row (identifier, number of words, first, last) of the longest wordings from each place."""
        out: list[list[tuple]] = [[] for _ in range(len(first) - 1)]
        begins = np.flatnonzero(np.isin(hashes, self.begins))
        if not len(begins):
            return out
        row = np.searchsorted(first, begins, "right") - 1
        end = first[1:][row]
        after: set[tuple[int, int, int]] = set()
        for width, known in self.leads.items():
            there = np.flatnonzero(begins + width <= end)
            led = there[np.isin(_grams(hashes, begins[there], width), np.array(list(known), np.uint64))]
            after.update(zip(begins[led].tolist(), (begins[led] + width).tolist(), row[led].tolist()))
        if not after:
            return out
        starts, at, row = (np.array(x) for x in zip(*sorted(after)))
        # with and without an article
        end = first[1:][row]
        article = np.flatnonzero((at < end) & np.isin(_grams(hashes, np.minimum(at, len(hashes) - 1), 1), np.array(list(self.articles[1]), np.uint64)))
        starts, at, row, end = (np.concatenate([x, x[article] + add]) for x, add in ((starts, 0), (at, 1), (row, 0), (end, 0)))
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for width, known in self.names.items():
            there = np.flatnonzero(at + width <= end)
            grams = _grams(hashes, at[there], width)
            named = np.flatnonzero(np.isin(grams, np.array(list(known), np.uint64)))
            for k, gram in zip(there[named].tolist(), grams[named].tolist()):
                name, last = known[gram], int(at[k]) + width
                if name in self.versioned and last < end[k] and int(_grams(hashes, np.array([last]), 1)[0]) in self.numbers:
                    continue  # the version goes on: another one
                place = (int(row[k]), int(starts[k]))
                best[place] = max(best.get(place, (0, "")), (last, name))
        for (d, low), (last, name) in best.items():
            out[d].append((self.spdx[name], last - low, low - int(first[d]), last - int(first[d])))
        return out


@lru_cache(1)
def covered() -> tuple[dict[str, str], Wordings]:
    """What op1_license_scan looks for."""
    texts, deciding = notices.notices()
    return texts, Wordings(notices.LEADS, notices.ARTICLES, notices.names(), deciding)


def _one(inside: np.ndarray, there: np.ndarray, wanted: np.ndarray, place: np.ndarray, length: int, least: float) -> np.ndarray:
    """Of the places of a template's shingles those of one copy, by how far each is from its place in the template, if the copy holds enough."""
    ahead = inside - place[np.searchsorted(wanted, there[inside])]
    order = np.sort(ahead)
    counts = np.searchsorted(order, order + length // 2, "right") - np.arange(len(order))
    low = order[int(np.argmax(counts))]
    one = inside[(ahead >= low) & (ahead <= low + length // 2)]
    return one if len(np.unique(there[one])) >= least * len(wanted) else inside


def _resolved(found: list[tuple], lines: list[tuple]) -> list[tuple]:
    """Of matches (name, share, first, last, number of shingles) and wordings that overlap the one that most words speak for."""
    ranked = [(n + WIDTH - 1, share, name, low, high) for name, share, low, high, n in set(found)] + [(n, 1.0, name, low, high) for name, n, low, high in lines]
    out: list[tuple] = []
    for _, share, name, low, high in sorted(ranked, key=lambda m: (-m[0], -m[1], m[3], m[2])):
        if all(high <= m[2] or low >= m[3] for m in out):
            out.append((name, share, low, high))
    return sorted(out, key=lambda m: (m[2], m[0]))


def scan_batch(column, templates: Templates, wordings: Wordings | None = None) -> list[list[tuple]]:
    """For each row (name, containment, first, last) of the matches, in words; see scan()."""
    out: list[list[tuple]] = []
    for _, hashes, first in split_words(column):
        n = len(first) - 1
        found: list[list[tuple]] = [[] for _ in range(n)]
        shingle = words.roll(hashes, WIDTH)
        good = words.inside(first, WIDTH)
        shingle[~good] = _LAST  # a shingle over a border of documents
        at_most = first[1:] - WIDTH + 1
        grids, before = [], None
        for half, wanted in sorted(templates.by_half.items()):
            # steps of ``half`` shingles that do not cross documents; a window is three in a row
            counts = np.maximum(0, -(-(at_most - first[:-1]) // half))
            owner = np.repeat(np.arange(n), counts)
            if len(owner):
                offset = np.cumsum(counts) - counts
                step = np.arange(len(owner)) - offset[owner]
                apart = [np.flatnonzero(owner[k:] != owner[: len(owner) - k]) for k in (1, 2)]
                begin = first[:-1][owner] + step * half
                # the least of a step is that of the smaller steps in it
                source = begin if before is None else before[1][owner] + step * (half // before[0])
                grids.append((wanted, owner, begin, source, apart, half, np.zeros((len(wanted), len(owner)), bool)))
                before = (half, offset)
        for b, factor in enumerate(_FACTORS):
            values = shingle * factor
            values[~good] = _LAST
            least = values
            for wanted, owner, _, source, apart, _, hits in grids:
                least = np.minimum.reduceat(least, source)
                window = least.copy()
                for k in (1, 2):
                    after = least[k:].copy()
                    after[apart[k - 1]] = _LAST
                    np.minimum(window[: len(owner) - k], after, out=window[: len(owner) - k])
                for t, (_, signature) in enumerate(wanted):
                    hits[t] |= window == signature[b]
        for wanted, owner, begin, _, _, half, hits in grids:
            for t, w in zip(*np.nonzero(hits)):
                name, d, low = wanted[t][0], int(owner[w]), int(begin[w])
                there = shingle[low : min(low + 3 * half, int(at_most[d]))]
                inside = np.flatnonzero(np.isin(there, templates.sets[name]))
                share = len(np.unique(there[inside])) / len(templates.sets[name])
                if share >= templates.containment:
                    if wordings:
                        inside = _one(inside, there, templates.sets[name], *templates.places[name], templates.containment)
                        n_held = len(np.unique(there[inside]))
                        share = n_held / len(templates.sets[name])
                    a, z = low + int(inside[0]), low + int(inside[-1]) + WIDTH
                    if not wordings:
                        found[d].append((name, share, a - int(first[d]), z - int(first[d])))
                    elif wordings.decided(name, hashes[a:z]):
                        found[d].append((name, share, a - int(first[d]), z - int(first[d]), n_held))
        out += map(_resolved, found, wordings.find(hashes, first)) if wordings else map(_merged, found)
    return out


def _merged(found: list[tuple]) -> list[tuple]:
    """Matches of one template that overlap as one: the best containment, the hull of the spans."""
    out: list[tuple] = []
    for name, share, low, high in sorted(set(found), key=lambda m: (m[0], m[2], m[3])):
        if out and out[-1][0] == name and low < out[-1][3]:
            out[-1] = (name, max(share, out[-1][1]), out[-1][2], max(high, out[-1][3]))
        else:
            out.append((name, share, low, high))
    return sorted(out, key=lambda m: (m[2], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", resolve: bool = False) -> DataFrame:
    """(doc_id, matches) of every row: array<struct<name, containment, first, last>> in words, last exclusive.

    A window matches if it holds ``containment`` of a template's distinct five-word shingles;
    windows overlap so that any stretch as long as the template lies in one.  Words are runs
    of letters and digits, A-Z in lower case.  Null, empty and short texts have no matches;
    repeated rows and rows without a doc_id are scanned alike; other columns are ignored.
    The templates go to every task: they are the caller's, and do not grow with the data.

    With ``resolve`` the templates are those of covered(), of matches that overlap only the
    one with most words stays, a template's deciding words (its version, say) must be there
    as they are, and one-line wordings are matches too, named by license alone.
    """
    if resolve:
        templates = covered()[0]
    items = tuple(sorted(templates.items()))
    _compiled(items, containment)  # complains here, not in tasks
    kinds = pa.list_(pa.struct([("name", pa.string()), ("containment", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        compiled, wordings = _compiled(items, containment), covered()[1] if resolve else None
        for batch in batches:
            found = [[dict(zip(("name", "containment", "first", "last"), m)) for m in ms] for ms in scan_batch(batch.column(1), compiled, wordings)]
            yield pa.record_batch([batch.column(0), pa.array(found, kinds)], names=["doc_id", "matches"])

    return frames.in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, matches array<struct<name:string,containment:double,first:long,last:long>>")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents with the licenses whose notices they hold."""
    out = scan(frames.documents(spark, sf_dir), resolve=True)
    said = lambda m: F.concat_ws(":", m["name"], m["first"].cast("string"), m["last"].cast("string"))
    licenses = F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.substring_index(m["name"], ":", 1))))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(licenses, ",").alias("licenses"), F.array_join(F.transform("matches", said), ",").alias("spans"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), 6).alias("containment"))
