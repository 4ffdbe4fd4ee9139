"""BM25: an inverted index as tables, and ranked search for batches of queries."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.text import bag, run_tokens, runs, searchable_text, tokenize
from lodeseam.schema import not_negative
from lodeseam.sources.arrow import in_arrow
from lodeseam.sources.steps import snapshot, spread


def ranked(results: DataFrame, k: int, score: str = "score", by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each query, ranked from 1: by score, then path in lower case, line and chunk.

    Scores are compared to nine decimals, so that the order of summation decides nothing.
    """
    not_negative(top_k=k)
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), F.lower("file_path"), "start_line", "chunk_id")
    return results.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


@dataclass(frozen=True)
class LexicalIndex:
    """postings (chunk_id, term, tf, dl), doc_stats (chunk_id, dl, file_path, start_line), term_stats (term, df, most), corpus_stats (n, avgdl).

    ``most`` is the largest impact of a term: what its weight is multiplied by in the chunk where that is highest.
    """

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self):
        _checked(self.k1, self.b)


@dataclass(frozen=True)
class Packed:
    """Chunks in stored blocks, for batches that read all of them: see pack().

    A block holds its chunks in the order in which ties go, its different words with the number of its chunks that hold each (dfs),
    and for each word in turn these chunks (docs) and how often they say it (tfs); lengths, docs and tfs are the bytes of 32-bit numbers.
    """

    blocks: DataFrame
    n: int
    avgdl: float
    k1: float = 1.5
    b: float = 0.75


def _checked(k1: float, b: float) -> None:
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b from 0 to 1")


def impact(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    length = 1 - b + b * dl / F.when(avgdl > 0, avgdl).otherwise(1.0)
    return tf * (k1 + 1) / (tf + k1 * length)


def totals(doc_stats: DataFrame) -> DataFrame:
    """(n, avgdl): one row."""
    return doc_stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def from_postings(postings: DataFrame, doc_stats: DataFrame, k1: float = 1.5, b: float = 0.75) -> LexicalIndex:
    """The index of stored postings (chunk_id, term, tf, dl)."""
    corpus_stats = totals(doc_stats)
    avgdl = corpus_stats.select("avgdl").scalar()
    term_stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.max(impact(F.col("tf"), F.col("dl"), avgdl, k1, b)).alias("most"))
    return LexicalIndex(postings, doc_stats, term_stats, corpus_stats, k1, b)


def _numbered(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the token, tf) of the different tokens of each row, by row, and the tokens by number."""
    lengths, flat = tokens.value_lengths().to_numpy(zero_copy_only=False), tokens.flatten().dictionary_encode()
    row, words = np.repeat(np.arange(len(tokens), dtype=np.int64), lengths), max(1, len(flat.dictionary))
    pairs, tf = np.unique(row * words + flat.indices.to_numpy(), return_counts=True)
    return *np.divmod(pairs, words), tf, flat.dictionary


def _tally(tokens: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, tf) of the different tokens of each row, by row."""
    row, word, tf, words = _numbered(tokens)
    return row, words.take(pa.array(word)), tf


def _counted(batches):
    """Each row's different tokens (the last column) with how often they occur, and the number of all."""
    for batch in batches:
        row, terms, tf = _tally(batch.column(batch.num_columns - 1))
        length = np.bincount(row, tf, len(batch))[row]
        yield pa.record_batch([*(c.take(pa.array(row)) for c in batch.columns[:-1]), terms, pa.array(tf, pa.int64()), pa.array(length.astype(np.int32))], names=[*batch.schema.names[:-1], "term", "tf", "dl"])


def counters(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with these arrays of tokens as maps from token to count, made where a row is read."""

    def run(batches):
        for batch in batches:
            out = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name in columns:
                    row, terms, tf = _tally(column)
                    column = pa.MapArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32()), terms, pa.array(tf, pa.int64()))
                out.append(column)
            yield pa.record_batch(out, names=batch.schema.names)

    return in_arrow(rows, run, ", ".join(f"{c} {'map<string,bigint>' if c in columns else k}" for c, k in rows.dtypes))


def count_terms(chunks: DataFrame, by: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(chunk_id, term, tf, dl) of chunks.

    A chunk is a row, so its terms are counted where it is read and nothing is shuffled; only chunks that share a ``chunk_id``, if there are any, are summed.
    """
    rows = spread(chunks).select(*by, bag(searchable_text()).alias("tokens"))
    counted = in_arrow(rows, _counted, ", ".join([*(f"{c} {k}" for c, k in rows.dtypes[:-1]), "term string, tf long, dl int"]))
    if _apart(chunks, *by):
        return counted
    return counted.groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def _apart(chunks: DataFrame, *by: str) -> bool:
    """Does no chunk share its key with another?"""
    return chunks.groupBy(*by).count().where("count > 1").isEmpty()


def lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, file_path, start_line) of chunks whose postings nobody needs."""
    return spread(chunks).select("chunk_id", F.size(bag(searchable_text())).alias("dl"), "file_path", "start_line")


def build(chunks: DataFrame, k1: float = 1.5, b: float = 0.75) -> LexicalIndex:
    """The index of ``chunks``.  Texts are tokenized once: postings are stored, and all other tables come from them."""
    postings = snapshot(count_terms(chunks))
    known = postings.groupBy("chunk_id").agg(F.first("dl").alias("known"))
    places = chunks.select("chunk_id", "file_path", "start_line").join(known, "chunk_id", "left")
    doc_stats = places.select("chunk_id", F.coalesce("known", F.lit(0)).cast("int").alias("dl"), "file_path", "start_line")
    return from_postings(postings, doc_stats, k1, b)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one range after the other, and which range each is of."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


#: Runs that are their only token: most of them, found without looking at each in Python.
_PLAIN = "^[a-z0-9\u00df-\u00f6\u00f8-\u00ff]+$"
#: Runs of a capital and then only such characters: two tokens, both of them the run in lower case.
_CAPITAL = "^[A-Z\u00c0-\u00d6\u00d8-\u00de][a-z0-9\u00df-\u00f6\u00f8-\u00ff]*$"


def _blocks(batches):
    """A block of each batch (chunk_id, file_path, start_line, place, runs): different runs are split into tokens once."""
    for batch in batches:
        if not len(batch):
            continue
        known = lambda x: (x is not None, x)
        places = list(zip(*(map(known, batch.column(c).to_pylist()) for c in (3, 2, 0))))
        batch = batch.take(pa.array(sorted(range(len(batch)), key=places.__getitem__), pa.int64()))
        row, run, times, said = _numbered(batch.column(4))
        capital = pc.match_substring_regex(said, _CAPITAL)
        plain = pc.or_(pc.match_substring_regex(said, _PLAIN), capital)
        tokens = [run_tokens(r) for r in said.filter(pc.invert(plain)).to_pylist()]
        whole = pc.utf8_lower(said.filter(plain))
        plain, capital = (x.to_numpy(zero_copy_only=False) for x in (plain, capital))
        times = times * (1 + capital)[run]
        sizes, starts = np.ones(len(said), np.int64), np.cumsum(plain) - 1
        sizes[~plain] = [len(t) for t in tokens]
        starts[~plain] = plain.sum() + np.cumsum(sizes[~plain]) - sizes[~plain]
        flat = pa.concat_arrays([whole, pa.array(list(chain.from_iterable(tokens)), pa.string())]).dictionary_encode()
        at, which = _ranges(starts[run], sizes[run])
        pairs, same = np.unique(flat.indices.to_numpy()[at].astype(np.int64) * len(batch) + row[which], return_inverse=True)
        tf = np.bincount(same, times[which], len(pairs))
        word, doc = np.divmod(pairs, len(batch))
        dl = np.bincount(doc, tf, len(batch))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (*batch.columns[:3], flat.dictionary, pa.array(np.bincount(word, minlength=len(flat.dictionary)), pa.int32()))]
        numbers = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (dl, doc, tf)]
        yield pa.record_batch([*lists, *numbers, pa.array([len(batch)], pa.int64()), pa.array([int(dl.sum())], pa.int64())], names=["chunk_ids", "file_paths", "start_lines", "words", "dfs", "lengths", "docs", "tfs", "held", "total"])


def pack(chunks: DataFrame, k1: float = 1.5, b: float = 0.75) -> Packed | LexicalIndex:
    """``chunks`` for search() of batches whose terms are most of a corpus: nothing is shuffled, a text is read once and its words never become rows.

    Chunks that share a ``chunk_id`` have to be summed first: if there are any, this is build().
    """
    _checked(k1, b)
    if not _apart(chunks, "chunk_id"):
        return build(chunks, k1, b)
    rows = spread(chunks).select("chunk_id", "file_path", "start_line", F.lower("file_path").alias("place"), runs(searchable_text()).alias("runs"))
    kinds = dict(rows.dtypes)
    lists = [f"{c}s array<{kinds[c]}>" for c in ("chunk_id", "file_path", "start_line")]
    packed = in_arrow(rows, _blocks, ", ".join([*lists, "words array<string>, dfs array<int>, lengths binary, docs binary, tfs binary, held long, total long"]))
    blocks = snapshot(packed, **{"parquet.page.size.row.check.min": "1"})  # a row is megabytes: the writer's memory is looked at after each
    n, total = blocks.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Packed(blocks, n, total / n if n else 0.0, k1, b)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, query): a repeated term counts as often."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_weight(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


#: How many postings of a query's rarest terms are scored to find out what it takes to be among its best, for each result asked for.
PROBE = 200
#: The terms that are not looked up by themselves add this part of what is needed at most: fewer chunks then stay to be completed.
IDLE = 0.3
#: Up to so many postings of a batch's terms are scored in one job: more jobs would take longer than they spare.
DIRECT = 20_000_000
#: Sums in different order differ by less.
SLACK = 1e-6


#: Queries that lie in one row and meet a block at a time.
QUERIES = 1_000
#: Scores of a block that are held at a time: of as many queries as that allows.
HELD = 1 << 18


class _Leading:
    """The rounded scores that are each query's ``k`` best so far, and what it takes to be among them."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.q, self.score = np.zeros(0, np.int64), np.zeros(0)

    def first(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of the ``k`` best of each query, ties in the order in which they come."""
        order = np.lexsort((-score, q))
        nth = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        return order[nth < self.k]

    def add(self, q: np.ndarray, score: np.ndarray) -> None:
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        keep = self.first(q, score)
        self.q, self.score = q[keep], score[keep]
        last = np.flatnonzero(np.append(self.q[1:] != self.q[:-1], True)) if len(keep) else keep
        full = last[np.bincount(self.q)[self.q[last]] == self.k] if len(keep) else last
        self.least[self.q[full]] = self.score[full]


def _meet(k: int, k1: float, b: float, avgdl: float):
    """Of each block and each row of queries, the chunks that may be among a query's ``k`` best of all that the task sees."""

    def run(batches):
        seen: dict[int, _Leading] = {}
        for batch in batches:
            for i in range(len(batch)):
                ids, paths, lines, words, dfs = (batch.column(c)[i].values for c in range(5))
                dl, docs, tfs = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in range(5, 8))
                asked, number = batch.column(8)[i].values, batch.column(9)[i].as_py()
                said = asked.field("said")
                terms, size = said.flatten(), said.value_lengths().to_numpy(zero_copy_only=False)
                leading = seen.setdefault(number, _Leading(len(asked), k))
                place = pc.index_in(terms.field("term"), words)
                there = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                place, weight = place.drop_null().to_numpy(), terms.field("weight").to_numpy(zero_copy_only=False)[there]
                of = np.repeat(np.arange(len(asked)), size)[there]
                sizes = dfs.to_numpy()
                starts, part = np.cumsum(sizes, dtype=np.int64) - sizes, tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * dl[docs] / (avgdl if avgdl > 0 else 1.0)))
                step = max(1, HELD // len(ids))
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                for low in range(0, len(asked), step):
                    mine, high = slice(*np.searchsorted(of, (low, low + step))), min(low + step, len(asked))
                    at, which = _ranges(starts[place[mine]], sizes[place[mine]])
                    scores = np.bincount((of[mine][which] - low) * len(ids) + docs[at], weight[mine][which] * part[at], (high - low) * len(ids)).reshape(-1, len(ids))
                    rounded = np.round(scores, 9)
                    q, c = np.nonzero((scores > 0) & named & (rounded >= leading.least[low:high, None]))
                    keep = leading.first(q, rounded[q, c])
                    q, c = q[keep], c[keep]
                    leading.add(q + low, rounded[q, c])
                    yield pa.record_batch([asked.field("query_id").take(pa.array(q + low)), *(x.take(pa.array(c)) for x in (ids, paths, lines)), pa.array(scores[q, c], pa.float64())], names=["query_id", "chunk_id", "file_path", "start_line", "score"])

    return run


def _search_packed(index: Packed, queries: DataFrame, top_k: int) -> DataFrame:
    """search() of packed chunks: every block meets every row of queries, and tasks keep the best of what they see."""
    asks = snapshot(query_terms(queries))
    words = index.blocks.select(F.inline(F.arrays_zip("words", "dfs"))).toDF("term", "df")
    df = words.join(asks.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.col("qtf") * term_weight(F.lit(index.n), F.col("df"))
    rows = -(-queries.count() // QUERIES) or 1
    asked = asks.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("said"))
    asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(rows)).alias("number")).agg(F.collect_list(F.struct("query_id", "said")).alias("asked"))
    asked = snapshot(asked.select("asked", "number").coalesce(1))
    met = index.blocks.drop("held", "total").crossJoin(asked.hint("shuffle_replicate_nl"))
    kinds = {c: k[len("array<") : -1] for c, k in index.blocks.dtypes if k.startswith("array<")} | dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_ids']}, file_path {kinds['file_paths']}, start_line {kinds['start_lines']}, score double"
    best = in_arrow(met, _meet(top_k, index.k1, index.b, index.avgdl), schema)
    return ranked(best if top_k else best.limit(0), top_k).select("query_id", "rank", "chunk_id", "file_path", "start_line", "score")


def search(index: LexicalIndex | Packed, queries: DataFrame, top_k: int = 10, report=None) -> DataFrame:
    """(query_id, rank, chunk_id, file_path, start_line, score): only chunks that share a term, so scores are positive.

    No chunk that could be among the best is left out (MaxScore).  1: the postings of a query's rarest
    terms name some chunks; the scores of the best of these, completed, give a threshold that the
    query's results reach at least.  2: the terms that together can't reach it are not looked up by themselves; the
    others' postings are scored, and a chunk stays if these terms and the most that the rest could add reach the threshold.
    3: what stays is completed by the rest.  So the long postings of common terms meet few chunks.
    A batch whose terms have ``DIRECT`` postings at most is scored at once, to the same result, and so is any batch over packed chunks.
    ``report`` is called with the name of each step and its rows, which are counted for it.
    """
    not_negative(top_k=top_k)
    if isinstance(index, Packed):
        return _search_packed(index, queries, top_k)
    if not top_k:
        return _described(index, queries.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0), 0)
    n, avgdl = (index.corpus_stats.select(c).scalar() for c in ("n", "avgdl"))
    weight = F.col("qtf") * term_weight(n, F.col("df"))
    rare, weak = (lambda w: w.rowsBetween(Window.unboundedPreceding, 0))(Window.partitionBy("query_id").orderBy("df", "term")), Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = query_terms(queries).join(index.term_stats, "term").withColumn("weight", weight).withColumn("bound", F.col("weight") * F.col("most"))
    terms = snapshot(terms)
    if (terms.agg(F.sum("df")).first()[0] or 0) <= DIRECT:
        found = terms.select("query_id", "term", "weight").join(index.postings, "term")
        return _described(index, found.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * impact(F.col("tf"), F.col("dl"), avgdl, index.k1, index.b)).alias("score")), top_k)
    terms = snapshot(terms.withColumns({"seen": F.sum("df").over(rare), "nth": F.row_number().over(rare), "below": F.sum("bound").over(weak)}))
    of_batch = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    part = F.col("weight") * impact(F.col("tf"), F.col("dl"), avgdl, index.k1, index.b)
    count = lambda name, df: report and report(name, df.count())

    def scored(some: DataFrame, *more: str) -> DataFrame:
        found = some.select("query_id", "term", "weight", *more).join(of_batch, "term")
        count("postings scored", found)
        return found.groupBy("query_id", "chunk_id", *more).agg(F.sum(part).alias("score"))

    def completed(some: DataFrame, by: DataFrame) -> DataFrame:
        """``some`` (query_id, chunk_id, score) with what the terms ``by`` add."""
        asked = some.select("query_id", "chunk_id").join(by.select("query_id", "term", "weight"), "query_id")
        found = asked.join(of_batch, ["chunk_id", "term"])
        count("postings looked up", found)
        added = found.select("query_id", "chunk_id", part.alias("score"))
        return some.select("query_id", "chunk_id", "score").unionByName(added).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    probed = scored(terms.where(f"nth = 1 or seen <= {PROBE * top_k}")).withColumn("place", nth).where(F.col("place") <= 2 * top_k).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    sure = completed(snapshot(probed), terms).withColumn("place", nth).where(F.col("place") == top_k).select("query_id", F.col("score").alias("needed"))
    terms = snapshot(terms.join(sure, "query_id", "left").withColumn("needed", F.coalesce("needed", F.lit(0.0)) - SLACK).withColumn("idle", F.col("below") < IDLE * F.col("needed")))
    rest = terms.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("idle"), F.col("bound"))), F.lit(0.0)).alias("could_add"), F.first("needed").alias("needed"))
    stays = snapshot(scored(terms.where("not idle")).join(rest, "query_id").where("score + could_add >= needed").select("query_id", "chunk_id", "score"))
    count("chunks that stay", stays)
    return _described(index, completed(stays, terms.where("idle")), top_k)


def leading(scored: DataFrame, k: int, by=("query_id",)) -> DataFrame:
    """The rows of ``scored`` with the ``k`` best scores of each ``by``, and all that tie with the last: few, before places are joined to break the ties."""
    nth = F.rank().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9))))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _described(index: LexicalIndex, scored: DataFrame, top_k: int) -> DataFrame:
    return ranked(leading(scored, top_k).join(index.doc_stats, "chunk_id"), top_k).select("query_id", "rank", "chunk_id", "file_path", "start_line", "score")
