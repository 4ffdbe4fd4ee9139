"""Spelling variants: words one edit apart, found by composing the vocabulary's minimal acceptor with a one-edit transducer and itself.

Two words of at least ``least`` characters that are one edit apart share their first ``(least - 1) // 2``
characters or, if the edit lies among those, the rest of ``least`` at their end.  So words are dealt by their
beginning, and once more, reversed, by their end: what a task holds are the words of some
states that the vocabulary's acceptor can be in after so many characters, and each of these is an initial state of a composition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, words
from lodeseam.llm.periodic import _repeat

# Bytes of ASCII letters, and the first byte of U+00C0 to U+00FF.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3

#: What a zero byte does to the low byte of a checksum.
_CRC = np.array([zlib.crc32(b"\0", b ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)

#: Words of one initial state that a task holds at most; beyond it the state is left for those one character on.
LIMIT = 30_000


def _crc_after(prefix: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two strings one after the other, from the crc32 of each and the bytes of the second."""
    out = prefix.astype(np.uint32)
    for step in range(int(size.max(initial=0))):
        more = size > step
        now = out if more.all() else out[more]
        now = (now >> np.uint32(8)) ^ _CRC[now & np.uint32(255)]
        if more.all():
            out = now
        else:
            out[more] = now
    return out ^ word.astype(np.uint32)


def word_counts(docs: DataFrame, least: int = 7, lose: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at least ``least`` characters occurs; A-Z count as a-z.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF.  With ``lose``, words are misspelt on
    purpose: of a word in a document, h is the crc32 of "doc_id:word", and if ``lose`` divides it, each
    occurrence there loses the character h % length; in rows without a doc_id none does.  A null or empty
    text has no words; repeated rows count as often; other columns are ignored; an empty table
    gives an empty result.  Words are counted in slices of texts before they shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            for low, high in words.pieces(offsets, 1 << 21):
                ids = batch.column(0).slice(low, high - low).to_pylist()
                yield _counted(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], ids, least, lose)

    return frames.in_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(data: np.ndarray, offsets: np.ndarray, ids: list, least: int, lose: int | None) -> pa.RecordBatch:
    lead = data == _LEAD
    solid = _LETTER[data] | lead
    solid[1:] |= lead[:-1]
    plain = np.where(solid, words.LOWER[data], np.uint8(32))
    starts, ends, first = words.find_words(plain, offsets)
    leads = np.concatenate([[0], np.cumsum(lead)])
    length = ends - starts - (leads[ends] - leads[starts])
    long = length >= least
    row = np.repeat(np.arange(len(ids)), np.diff(first))[long]
    starts, sizes = starts[long], (ends - starts)[long]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    joined = plain[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
    kinds = found.dictionary.to_pylist()
    kind = found.indices.to_numpy().astype(np.int64)
    counts = np.bincount(kind, minlength=len(kinds))
    lost: list[str] = []
    lost_n: list[int] = []
    if lose and len(kinds):
        both, n = np.unique(row * len(kinds) + kind, return_counts=True)
        row, kind = both // len(kinds), both % len(kinds)
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        own = np.fromiter(map(zlib.crc32, kinds), np.uint32, len(kinds))
        size = np.fromiter(map(len, kinds), np.int64, len(kinds))
        h = np.empty(len(both), np.uint32)
        brief = size[kind] <= 64
        h[brief] = _crc_after(prefix[row[brief]], own[kind[brief]], size[kind[brief]])
        for k in np.flatnonzero(~brief):
            h[k] = zlib.crc32(kinds[kind[k]], int(prefix[row[k]]))
        named = np.array([i is not None for i in ids], bool)
        for k in np.flatnonzero((h % np.uint32(lose) == 0) & named[row]):
            word = kinds[kind[k]].decode()
            at = int(h[k]) % len(word)
            counts[kind[k]] -= n[k]
            if len(word) > least:
                lost.append(word[:at] + word[at + 1 :])
                lost_n.append(int(n[k]))
    left = np.flatnonzero(counts)
    told = found.dictionary.take(pa.array(left)).cast(pa.large_string()).cast(pa.string())
    return pa.record_batch([pa.concat_arrays([told, pa.array(lost, pa.string())]), pa.array(np.concatenate([counts[left], np.array(lost_n, np.int64)]))], names=["word", "n"])


class Acceptor:
    """The minimal acceptor of some words, one initial state for each group of them.

    ``groups`` are numbers and ``rests`` words, in order of group and word, all different.  A state is
    reached from the root by a group's number, then by characters.  In the trie from which states are
    merged, a node owns the words from ``word[node]`` on, so a word is found by how many words of a state's language come before it.
    """

    def __init__(self, groups: np.ndarray, rests: list[str]):
        text = np.frombuffer("".join(rests).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, rests), np.int64, len(rests))
        _, text = np.unique(text, return_inverse=True)
        n, begin = len(rests), np.cumsum(size) - size
        # shared characters with the word before, a group's number being the first
        k, step = _repeat(np.minimum(size[1:], size[:-1]))
        differs = text[begin[1:][k] + step] != text[begin[:-1][k] + step] if len(k) else np.zeros(0, bool)
        common = np.minimum(size[1:], size[:-1])
        np.minimum.at(common, k[differs], step[differs])
        common = np.concatenate([[0], np.where(groups[1:] == groups[:-1], common + 1, 0)]).astype(np.int64)
        depth_of = size + 1
        own = depth_of - common
        self.word, nth = _repeat(own)
        self.depth = common[self.word] + nth + 1
        base = np.cumsum(own) - own
        at = begin[self.word] + self.depth - 2
        label = np.where(self.depth == 1, -1, text[np.clip(at, 0, max(len(text) - 1, 0))] if len(text) else -1) + 1
        self.parent = np.arange(len(self.word)) - 1
        for depth in np.unique(common[common > 0]).tolist():
            owners = np.flatnonzero((common < depth) & (depth_of >= depth))
            here = np.flatnonzero(common == depth)
            owner = owners[np.searchsorted(owners, here) - 1]
            self.parent[base[here]] = base[owner] + depth - common[owner] - 1
        self.parent[base[common == 0]] = -1
        final = np.zeros(len(self.word), np.int64)
        final[base + own - 1] = 1
        self._minimise(label, final)

    def _minimise(self, label: np.ndarray, final: np.ndarray) -> None:
        nodes = len(label)
        by_depth = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[by_depth], np.arange(1, self.depth.max(initial=0) + 2))
        height = np.zeros(nodes, np.int64)
        for a, b in zip(cuts[-2:0:-1].tolist(), cuts[:0:-1].tolist()):  # from the deepest to those below an initial state
            these = by_depth[a:b]
            np.maximum.at(height, self.parent[these], height[these] + 1)
        child = np.argsort(self.parent, kind="stable")  # by label within a parent, as words are in order
        child = child[self.parent[child] >= 0]
        degree = np.bincount(self.parent[child], minlength=nodes)
        head = np.cumsum(degree) - degree
        sign, names = final.copy(), 2
        letters = int(label.max(initial=0)) + 1
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(height.max(initial=0) + 2))
        for a, b in zip(cuts[1:-1].tolist(), cuts[2:].tolist()):
            these, k = by_height[a:b], 0
            while len(these):
                next_child = child[head[these] + k]
                _, known = np.unique(sign[these] * letters + label[next_child], return_inverse=True)
                _, known = np.unique(known * names + sign[next_child], return_inverse=True)
                sign[these] = names + known
                names += int(known.max()) + 1
                k += 1
                these = these[degree[these] > k]
        _, some, self.state = np.unique(sign, return_index=True, return_inverse=True)
        # transitions of each state, by label; ``ahead``: the words of the state's language before those through it
        source, nth = _repeat(degree[some])
        target = child[head[some[source]] + nth]
        self.final = final[some] == 1
        self.degree = degree[some]
        self.head = np.cumsum(self.degree) - self.degree
        self.source, self.label, self.target, self.ahead = source, label[target], self.state[target], self.word[target] - self.word[some[source]]
        self.letters, self.key = letters, source * letters + label[target]

    def _walk(self, of, a, b, i, j, barred=None):
        """(of, i, j) of all words that states ``a`` and ``b`` both accept; the first character is not ``barred``."""
        found = []
        while len(of):
            both = self.final[a] & self.final[b]
            found.append((of[both], i[both], j[both]))
            k, step = _repeat(self.degree[a])
            edge = self.head[a[k]] + step
            other = np.searchsorted(self.key, want := b[k] * self.letters + self.label[edge])
            meets = self.key[np.minimum(other, len(self.key) - 1)] == want if len(self.key) else np.zeros(len(k), bool)
            if barred is not None:
                meets &= self.label[edge] != barred[k]
                barred = None
            k, edge, other = k[meets], edge[meets], other[meets]
            of, a, b, i, j = of[k], self.target[edge], self.target[other], i[k] + self.ahead[edge], j[k] + self.ahead[other]
        return found

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of each pair that one edit parts, once each.

        Without an edit both sides are in the same state.  The edit takes them apart: to two successors of the state (a replaced
        character), or one of them one character ahead (a missing one; of equal neighbours, the last).  What both
        accept from there is found once for each state, for all words that pass it.
        """
        k, step = _repeat(self.degree[self.source] - 1 - (np.arange(len(self.source)) - self.head[self.source]))
        other = k + 1 + step
        found = self._walk(self.source[k], self.target[k], self.target[other], self.ahead[k], self.ahead[other])
        found += self._walk(self.source, self.target, self.source, self.ahead, np.zeros(len(self.source), np.int64), self.label)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, i, j = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(self.state, kind="stable")
        heads = np.searchsorted(self.state[order], np.arange(len(self.degree) + 1))
        k, nth = _repeat((heads[1:] - heads[:-1])[of])
        first = self.word[order[heads[of[k]] + nth]]
        return first + i[k], first + j[k]


def _grouped(vocab: DataFrame, least: int, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (back, group, rest, word, n) whose groups hold ``limit`` words at most; and pairs that the edit at a left state parts.

    A group of more words is left for the groups one character on.  Two of its words that differ in that character alone, or
    by it, share what follows it: those are joined there, where as many words meet as there are characters.
    """
    width = (least - 1) // 2
    sides = [F.struct(F.lit(b).alias("back"), F.lit(w).alias("width"), s.alias("spelt")) for b, w, s in ((False, width, F.col("word")), (True, least - width, F.reverse("word")))]
    left = vocab.select("word", "n", F.explode(F.array(*sides)).alias("side")).select("word", "n", "side.*")
    cut = lambda df: df.withColumns({"group": F.expr("left(spelt, width)"), "rest": F.expr("substring(spelt, width + 1)")})
    left, done, parted = cut(left), [], []
    while True:
        hot = frames.stored(left.groupBy("back", "group").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("back", "group"), "hot")
        if hot.isEmpty():
            done.append(left)
            break
        keys = (F.col("back"), F.col("group"))
        done.append(frames.without(left, keys, hot))
        left = frames.stored(frames.only(left, keys, hot), "split")
        members = left.select("back", "group", "word", "n", F.expr("substring(rest, 2)").alias("tail"), F.left("rest", F.lit(1)).alias("c")).where("rest <> ''")
        members = members.unionByName(left.select("back", "group", "word", "n", F.col("rest").alias("tail"), F.lit("").alias("c")))
        other = members.select("back", "group", "tail", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("c").alias("d"))
        apart = (F.col("c") != F.col("d")) & ((F.col("d") != "") | ~F.col("tail").startswith(F.col("c"))) & ((F.col("c") != "") | ~F.col("tail").startswith(F.col("d")))
        met = members.join(other, ["back", "group", "tail"]).where(apart)
        same = F.left("word", F.lit(width)) == F.left("other", F.lit(width))
        parted.append(met.where(~(F.col("back") & same)).select("word", "other", F.col("other_n").alias("n")))
        left = cut(left.where("rest <> ''").withColumn("width", F.col("width") + 1).drop("group", "rest"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select("back", "group", "rest", "word", "n"), parted


def near_words(vocab: DataFrame, least: int = 7, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, form_n, form) of the words of ``vocab`` (word, n) that have a word one edit away.

    One character is inserted, deleted or replaced.  ``form`` is the near word of largest n, ``form_n``; of equal
    ones the first in order of characters.  Words are of at least ``least`` characters, and different.
    Tasks answer for each word of a group by one row; pairs are not sent.
    """
    width = (least - 1) // 2
    rows, parted = _grouped(vocab, least, limit)
    dealt = rows.repartition("back", "group").sortWithinPartitions("back", "group", "rest").select("back", "group", "rest", "word", "n")

    def answers(groups: list, rests: list, names: list, n: list, back: list):
        one, two = Acceptor(np.array(groups), rests).pairs()
        if any(back):
            reverse = np.array(back, bool)
            heads = np.unique(np.array([w[:width] for w in names]), return_inverse=True)[1]
            keep = ~(reverse[one] & (heads[one] == heads[two]))
            one, two = one[keep], two[keep]
        one, two = np.concatenate([one, two]), np.concatenate([two, one])
        if not len(one):
            return
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        n = np.array(n, np.int64)
        order = np.lexsort((place[two], -n[two], one))
        one, two = one[order], two[order]
        head = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        yield pa.record_batch([pa.array([names[i] for i in one[head]], pa.string()), pa.array(np.diff(np.append(head, len(one)))), pa.array(n[two[head]]), pa.array([names[i] for i in two[head]], pa.string())], names=["word", "n_near", "form_n", "form"])

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        at, number = None, -1
        for batch in batches:
            for back, group, rest, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (back, group) != at:
                    at, number = (back, group), number + 1
                    if len(held[0]) >= limit:
                        yield from answers(*held)
                        held = [[], [], [], [], []]
                for column, value in zip(held, (number, rest, word, n, back)):
                    column.append(value)
        if held[0]:
            yield from answers(*held)

    found = frames.in_arrow(dealt, run, "word string, n_near long, form_n long, form string")
    for pairs in parted:
        found = found.unionByName(pairs.select("word", F.lit(1).cast("long").alias("n_near"), F.col("n").alias("form_n"), F.col("other").alias("form")))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): where the forms of forms end, by pointers that double; forms must not go in a circle."""
    ends = frames.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = frames.stored(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def spelling_groups(counts: DataFrame, least: int = 7, least_n: int = 2, factor: int = 10, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for all words of ``counts`` (word, n) of ``least`` characters and ``least_n`` occurrences.

    A word's form is its most frequent near word, if that occurs ``factor`` times as often at least; its root is where the forms of forms
    end, the word itself if it has none.  Words without a near word have n_near 0.  Every form is ``factor`` times as frequent, so chains are
    as long as the logarithm of the largest count at most.  Null words are left out; an empty table gives an empty result.
    """
    if least < 3 or factor < 2:
        raise ValueError("words of three characters at least, and a factor of two")
    vocab = frames.stored(counts.where((F.char_length("word") >= least) & (F.col("n") >= least_n)).select("word", "n"), "vocabulary")
    near = near_words(vocab, least, limit)
    enough = F.col("form_n") >= F.col("n") * factor
    known = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    known = frames.stored(known, "forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of seven letters and two occurrences at least in all documents, each with its more usual form and its root."""
    counts = word_counts(frames.documents(spark, sf_dir), least=7, lose=31)
    return spelling_groups(counts).select("word", "form", "root", "n", "n_near", "form_n")
