"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labels: words, and beginnings of words, that occur in toxic
documents and hardly elsewhere.  A trie holds it; the automaton that walks the trie while
counting edits is made deterministic as texts need it, so a word costs a table lookup per
character.  Matches count less if misspelled, and apart if their window quotes or reports
them; a logistic model turns a document's matches into its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames, words

WORD = re.compile(r"[^\W\d_]+")
#: Words with the digits inside them: a digit for a letter is a misspelling.
JOINED = re.compile(r"[^\W\d_]+(?:\d+[^\W\d_]+)*")
STEM_LENGTHS = range(3, 8)
#: A misspelling counts as this share of its term.
MISSPELLED = 0.7
#: Words on either side that are searched for signs of quotation.
WINDOW = 6
QUOTES = "\"“”„«»‘’‹›`"
#: Words of reporting, in English, French, German and Spanish.
REPORTING = frozenset(
    "said says wrote writes called quoted quote quotes term word slur insult means meaning "
    "dit écrit appelé cité citation mot terme insulte "
    "sagte schrieb nannte zitiert zitat wort begriff beleidigung "
    "dijo escribió llamó citado cita palabra término insulto".split()
)


def allowed_edits(term: str) -> int:
    """None for short words, else one, or two from ten letters on; one for beginnings of words from six letters on."""
    if term.endswith("*"):
        return int(len(term) > 6)
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def _with_parts(found: set[str]) -> set[str]:
    """``found`` with the letters between digits of those that have digits inside."""
    return found | {part for w in found if not w.isalpha() for part in WORD.findall(w)}


class Automaton:
    """Finds the term that a word is, begins with, or is a misspelling of.

    A state is a set of (trie node, edits so far), each as one number.  Reading a letter follows the node's
    child; for an edit it stays (a letter too many), takes any child (a wrong letter), or
    has skipped one (a letter missing).  Where a beginning ends it stays for nothing; one
    without edits ends the word.  States are numbered when they are first reached.
    """

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        self.most = [0]
        self.open = [-1]
        for term in terms:
            edits, node = allowed_edits(term), 0
            self.most[0] = max(self.most[0], edits)
            for letter in term.removesuffix("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                    self.open.append(-1)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], edits)
            self.ends[node].append(term)
            if term.endswith("*"):
                self.open[node] = edits
        self.reset()

    #: States that are numbered; beyond them a word is walked without.
    LIMIT = 60_000

    def reset(self) -> None:
        """Forget all states but the first."""
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.finished: list[bool] = []
        self.dead = self._number(frozenset())
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, edits: dict[int, int]) -> frozenset:
        queue = list(edits.items())
        while queue:  # missing letters
            node, e = queue.pop()
            for child in self.children[node].values():
                if e < self.most[child] and edits.get(child, 99) > e + 1:
                    edits[child] = e + 1
                    queue.append((child, e + 1))
        return frozenset(node << 3 | e for node, e in edits.items())

    def _step(self, pairs: frozenset, letter: str) -> frozenset:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and reached.get(node, 99) > e:
                reached[node] = e

        for node, e in ((x >> 3, x & 7) for x in pairs):
            for other, child in self.children[node].items():
                reach(child, e + (other != letter))
            reach(node, e + (e > self.open[node]))
        return self._closed(reached)

    def _accepts(self, pairs: frozenset) -> tuple[tuple[str, int] | None, bool]:
        """The nearest term that ends here, and whether the word's end doesn't matter."""
        found = [(e, term) for node, e in ((x >> 3, x & 7) for x in pairs) for term in self.ends[node] if e <= allowed_edits(term)]
        stems = [x for x in found if x[1].endswith("*") and not x[0]]
        best = min(stems or found, default=None)
        return best and (best[1], best[0]), bool(stems)

    def _number(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            accepts, finished = self._accepts(pairs)
            self.accepts.append(accepts)
            self.finished.append(finished)
        return self.states[pairs]

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or None."""
        state, moves = self.start, self.moves
        for i, letter in enumerate(word):
            to = moves[state].get(letter)
            if to is None:
                pairs = self._step(self.sets[state], letter)
                if pairs not in self.states and len(self.sets) >= self.LIMIT:
                    return self._walk(pairs, word[i + 1 :])
                to = moves[state][letter] = self._number(pairs)
            state = to
            if state == self.dead:
                return None
            if self.finished[state]:
                break
        return self.accepts[state]

    def _walk(self, pairs: frozenset, rest: str) -> tuple[str, int] | None:
        """match() from a state that has no number, through others that get none."""
        accepts, finished = self._accepts(pairs)
        for letter in rest:
            if not pairs or finished:
                break
            pairs = self._step(pairs, letter)
            accepts, finished = self._accepts(pairs)
        return accepts


@dataclass(frozen=True)
class Model:
    """The lexicon with its weights, words near a term that are clean, terms that count as written only, and the logistic model."""

    terms: tuple[tuple[str, float], ...]
    clean: frozenset[str] = frozenset()
    literal: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = (-2.0, 1.0, 0.5, 0.0)


class _Matches(dict):
    """What words match, for the words met most recently."""

    LIMIT = 60_000
    def __init__(self, model: Model):
        super().__init__()
        self.automaton, self.model, self.older = Automaton(t for t, _ in model.terms), model, {}

    def forget(self) -> None:
        """Leave the automaton alone: a worker outlives its task, and what later stages need is memory."""
        self.clear()
        self.older = {}

    def __missing__(self, word: str):
        if word in self.older:
            found = self.older[word]
        else:
            found = self.automaton.match(word)
            if found and found[1] and (word in self.model.clean or found[0] in self.model.literal):
                found = None
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


@lru_cache(1)
def _matches(model: Model) -> _Matches:
    return _Matches(model)


def find(model: Model, text: str) -> list[tuple[int, int, str, int, bool, float]]:
    """(first, last, term, edits, quoted, weight) of each match; characters of the lower-cased text, last exclusive."""
    cached = _matches(model)
    text = text.lower()
    if not any(cached[w] for w in _with_parts(set(JOINED.findall(text)))):
        return []
    spans = []
    for m in JOINED.finditer(text):
        if m[0].isalpha() or cached[m[0]]:
            spans.append(m.span())
        else:  # no misspelling: words that digits part
            spans += [(m.start() + part.start(), m.start() + part.end()) for part in WORD.finditer(m[0])]
    weights, out = dict(model.terms), []
    for k, (i, j) in enumerate(spans):
        found = cached[text[i:j]]
        if found:
            term, edits = found
            low, high = spans[max(0, k - WINDOW)][0], spans[min(len(spans) - 1, k + WINDOW)][1]
            before, after = text[low:i], text[j:high]
            enclosed = any(q in QUOTES for q in before) and any(q in QUOTES for q in after)
            reported = bool(REPORTING.intersection(WORD.findall(before)))
            out.append((i, j, term, edits, enclosed or reported, weights[term] * (MISSPELLED if edits else 1.0)))
    return out


def _inputs(matches) -> tuple[float, float, float]:
    """The strongest match outside quotations, the sum of those (by its logarithm), and the strongest quoted one."""
    plain = [m[5] for m in matches if not m[4]]
    return max(plain, default=0.0), math.log1p(sum(plain)), max((m[5] for m in matches if m[4]), default=0.0)


def _score(model: Model, matches) -> float:
    a, *b = model.coefficients
    z = a + sum(w * x for w, x in zip(b, _inputs(matches)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _slices(batch, column: int, size: int = 2 << 20):
    """A batch in slices of about ``size`` bytes of text, so that few texts are Python strings at a time."""
    _, offsets = words.utf8(batch.column(column))
    for low, high in words.pieces(offsets, size):
        yield batch.slice(low, high - low)


def _count_features(batches):
    """Partial counts (feature, toxic, total) over documents: words, and beginnings of words."""
    total, toxic = Counter(), Counter()

    def flush():
        names = list(total)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([total[x] for x in names], pa.int64())], names=["feature", "toxic", "total"])
        total.clear()
        toxic.clear()

    for batch in (part for whole in batches for part in _slices(whole, 0)):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _with_parts(set(JOINED.findall((text or "").lower())))
            found |= {w[:k] + "*" for w in found for k in STEM_LENGTHS if k < len(w)}
            total.update(found)
            if label:
                toxic.update(found)
            if len(total) > 150_000:
                yield from flush()
    yield from flush()


#: Features are terms if they are about as precise as the most precise one.
PRECISE = 0.9


def choose_terms(counts: list[tuple[str, int, int]], toxic_docs: int, docs: int, least: int = 5) -> tuple[tuple[str, float], ...]:
    """The lexicon from (feature, toxic, total): precise features, the most frequent first, no beginning that another covers.

    A word that a beginning covers stays, as its misspellings need not begin alike.

    Of features that are as frequent the longest goes first, so that a beginning is no shorter
    than its occurrences in toxic documents justify; a word goes before its own beginning.
    """
    support = max(least, toxic_docs // 400)
    rated = [((t + 0.5) / (n + 1), t, n, f) for f, t, n in counts if t >= support]
    best = max((p for p, *_ in rated), default=0.0)
    share = toxic_docs / max(docs, 1)
    rated = sorted((x for x in rated if x[0] >= PRECISE * best and x[0] > min(2 * share, (1 + share) / 2)), key=lambda x: (-x[1], -len(x[3].rstrip("*")), x[3].endswith("*"), x[3]))
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    covered: dict[str, int] = defaultdict(int)
    base = math.log((toxic_docs + 0.5) / (docs - toxic_docs + 0.5))
    for p, t, n, feature in rated:
        body = feature.rstrip("*")
        under = any(body[:k] in stems for k in range(1, len(body) + 1))
        if feature.endswith("*") and (under or 1.2 * covered[body] >= t):
            continue
        chosen[feature] = round(min(10.0, math.log(p / (1 - p)) - base), 4)
        if feature.endswith("*"):
            stems.add(body)
        for k in range(1, len(body) + 1 if not under else 0):
            covered[body[:k]] += t
    return tuple(chosen.items())


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Intercept and coefficients by Newton's method; the penalty does not touch the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = penalty * np.eye(a.shape[1])
    ridge[0, 0] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(np.round(w, 6).tolist())


#: Labelled rows that the lexicon and the model are fitted on, at most (about; chosen by a hash of doc_id).
SAMPLE = 20_000


#: A document without matches is never called toxic, however many of the labels are: the intercept is at most this.
NO_MATCH = -0.01


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of ``labels`` (doc_id, toxic): rows without either, and without a document, are left out.

    Fitted on a sample of at most about ``sample`` labelled rows, whatever the size of the
    table, so that what reaches the driver and every task is bounded: features that meet
    the support, and three numbers and the near words for each row of the sample.
    The lexicon has every term that meets the support and the precision.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).alias("label")).where("doc_id is not null and label is not null")
    count = known.count()
    share = min(1.0, sample / max(count, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select("text", "label")
    toxic_docs, seen = (int(x or 0) for x in rows.select("label").agg(F.sum(F.col("label").cast("int")), F.count("*")).first())
    if not toxic_docs:
        return Model(())
    support = max(5, toxic_docs // 400)
    counts = frames.in_arrow(rows, _count_features, "feature string, toxic long, total long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    precision = (F.col("toxic") + 0.5) / (F.col("total") + 1)
    supported = frames.stored(counts.where((F.col("toxic") >= support) & (F.col("toxic") * 2 > F.col("total"))), "features")
    best = supported.agg(F.max(precision)).first()[0] or 0.0
    precise = supported.where(precision >= PRECISE * best)
    terms = choose_terms([tuple(r) for r in precise.collect()], toxic_docs, seen)
    model = Model(terms)

    def near(batches):
        for batch in (part for whole in batches for part in _slices(whole, 0)):
            found = [find(model, t or "") for t in batch.column(0).to_pylist()]
            # only where nothing is spelled out does a misspelling show by itself what it is worth
            misspelt = [sorted({f"{t.lower()[m[0] : m[1]]} {m[2]}" for m in ms}) if all(m[3] for m in ms) else [] for t, ms in zip(batch.column(0).to_pylist(), found)]
            xs = [_inputs([m for m in ms if not m[3]]) for ms in found]
            yield pa.record_batch([batch.column(1), pa.array(xs, pa.list_(pa.float64())), pa.array(misspelt, pa.list_(pa.string()))], names=["label", "x", "near"])
        _matches(model).forget()

    fitted = frames.in_arrow(rows, near, "label boolean, x array<double>, near array<string>").collect()
    worth: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in fitted:
        for name in {n for pair in r.near for n in pair.split()}:
            worth[name][0] += r.label
            worth[name][1] += 1
    clean = frozenset(n for n, (bad, there) in worth.items() if bad < 0.5 * there) - {t for t, _ in terms}
    around = Counter(t for t in {tuple(pair.split()) for r in fitted for pair in r.near} if t[0] in clean for t in [t[1]])
    literal = frozenset(t for t, n in around.items() if n >= 3 and worth[t][0] < 0.5 * worth[t][1])
    if not terms:
        return Model(())
    x = np.array([r.x for r in fitted], float)
    none, *some = fit_logistic(x, np.array([r.label for r in fitted], float))
    return Model(terms, clean, literal, (min(none, NO_MATCH), *some))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, matches) of every row, from its whole text alone.

    A null or empty text, and one without matches, scores what the model gives for no match.
    Repeated rows and rows without a doc_id are scored like any other; other columns are ignored.
    """

    def run(batches):
        kinds = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("weight", pa.float64())]))
        names = ("first", "last", "term", "edits", "quoted", "weight")
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            found = [find(model, t) if t else [] for t in batch.column(1).to_pylist()]
            scores = [_score(model, ms) for ms in found]
            rows = [[dict(zip(names, m)) for m in ms] for ms in found]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(rows, kinds)], names=["doc_id", "score", "predicted", "matches"])
        _matches(model).forget()

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int, matches array<struct<first:long,last:long,term:string,edits:int,quoted:boolean,weight:double>>"
    return frames.in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``least``.

    A null or empty text has no matches and stays, as the model's score for none is below one
    half.  Repeated rows and rows without an id are judged like any other; an empty table
    stays empty, and other columns may have any name.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in _slices(batch, at):
                scores = [_score(model, find(model, t) if t else []) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([s < least for s in scores], pa.bool_()))
        _matches(model).forget()

    return frames.in_arrow(docs, run, docs.schema)


def held_out(doc_id):
    """The fifth of the documents that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of the labels outside the held-out fifth."""
    docs = frames.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("matches").cast("long").alias("n_matches"))
