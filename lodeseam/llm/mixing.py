"""Mixing sources to target weights: temperature, bisection, budgeted block permutations."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm import frames

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """The exponent found, and for each source its weight and the tokens to take of it."""

    exponent: float
    weights: dict[str, float]
    quotas: dict[str, int]


def entropy(weights) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def solve_sizes(sizes: dict[int, int], target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None) -> tuple[float, dict[int, float], dict[int, int]]:
    """(exponent, weights, quotas) for ``sizes``: how many sources have so many tokens.  Sources of a size get the same.

    The largest exponent in [0, 1] that meets the entropy target, or a larger one that the
    repetition limit forces.  Weights are in proportion to the shares to the power of the
    exponent.  ``target_entropy`` is a share of the largest possible entropy, the logarithm of
    the number of sources; entropy falls as the exponent rises.  ``max_repeats`` bounds how often
    a source is taken on average; repetition falls as the exponent rises, and this bound goes
    first.  ``budget`` is in tokens; without one it is the least that takes every document once.
    A source without tokens has no weight.
    """
    full = sorted(t for t in sizes if t > 0)
    if not full:
        return 1.0, dict.fromkeys(sizes, 0.0), dict.fromkeys(sizes, 0)
    tokens, counts = np.array(full, float), np.array([sizes[t] for t in full], float)
    shares, sources = tokens / sum(t * sizes[t] for t in full), sum(sizes[t] for t in full)

    def weights(e: float) -> np.ndarray:
        raised = shares**e
        return raised / (raised * counts).sum()

    def total(w: np.ndarray) -> float:
        return float(budget) if budget is not None else float((tokens / w).max())

    def spread(e: float) -> float:
        w = weights(e)
        return float(-(counts * w * np.log(w)).sum())

    def repeats(e: float) -> float:
        w = weights(e)
        return float((w / tokens).max()) * total(w)

    def bisect(low_is_good) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if low_is_good(middle) else (low, middle)
        return (low + high) / 2

    exponent = 1.0
    if target_entropy is not None and sources > 1:
        aim = target_entropy * math.log(sources)
        if spread(1.0) < aim:
            exponent = bisect(lambda e: spread(e) >= aim)
    if max_repeats is not None and repeats(exponent) > max_repeats + 1e-9:
        exponent = max(exponent, bisect(lambda e: repeats(e) > max_repeats))
    found = {t: round(float(w), 9) for t, w in zip(full, weights(exponent))}
    needed = budget if budget is not None else max(t / max(w, 1e-9) for t, w in found.items())
    quotas = {t: math.floor(w * needed) for t, w in found.items()}
    if budget is None:  # rounding must not cost a document
        quotas = {t: max(q, t) for t, q in quotas.items()}
    none = [t for t in sizes if t <= 0]
    return exponent, found | dict.fromkeys(none, 0.0), quotas | dict.fromkeys(none, 0)


def solve(totals: dict[str, int], target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None) -> Mix:
    """solve_sizes() for the tokens of each source by name."""
    exponent, weights, quotas = solve_sizes(Counter(totals.values()), target_entropy, max_repeats, budget)
    return Mix(exponent, {s: weights[t] for s, t in totals.items()}, {s: quotas[t] for s, t in totals.items()})


def _draw(*parts) -> Column:
    """A hash of the parts as hex, which orders a permutation."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def mix_sources(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None, block_docs: int = 1000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, epoch, place): one row for each time that a document is taken.

    Tokens are words here.  Each source is cut into blocks by a hash of doc_id; an epoch goes
    through the blocks of a source in a permutation of its own, and through each block in
    one.  Whole epochs are taken while the source's quota holds them; the last epoch stops
    at the first document that starts at or beyond the quota.  place in [0, 1) is where the
    copy starts within the source's quota: sorting by it interleaves the sources by weight.

    A null source is the source "".  Null and empty texts have no tokens; a source without any is
    taken once.  Rows that repeat a doc_id are taken alike, ordered by their tokens.  Other
    columns are ignored; an empty table gives an empty result.  What reaches the driver is how
    many sources there are of each number of tokens: however many sources, at most the square
    root of twice all tokens.  Blocks hold about ``block_docs`` documents, or the square root of
    a source's documents if that is more: no window holds more than a block or a source's blocks.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    per_source = frames.stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    sizes = {r.tokens: r.n for r in per_source.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    _, _, quotas = solve_sizes(sizes, target_entropy, max_repeats, budget)
    plan = per_source.join(frames.local(docs.sparkSession, tokens=pa.array(quotas, pa.int64()), quota=pa.array(quotas.values(), pa.int64())), "tokens")
    whole = F.when(F.col("tokens") > 0, F.expr("quota div nullif(tokens, 0)")).otherwise(1).cast("long")
    rest = F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0)
    size = F.greatest(F.lit(block_docs), F.ceil(F.sqrt("docs")))
    plan = plan.select("source", "tokens", "quota", whole.alias("whole"), (whole + (rest > 0).cast("long")).alias("epochs"), F.ceil(F.col("docs") / size).alias("blocks"))
    if per_source.count() <= frames.BROADCAST_KEYS:
        plan = F.broadcast(plan)

    block = F.pmod(F.conv(F.substring(_draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    dealt = rows.join(plan, "source").withColumn("block", block)
    taken = dealt.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))

    # where each block starts in its source's epoch
    sums = dealt.where("epochs > 0").groupBy("source", "block", "epochs").agg(F.sum("n_tokens").alias("block_tokens"))
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    shuffled = Window.partitionBy("source", "epoch").orderBy(_draw(seed, "block", F.col("epoch"), F.col("source"), F.col("block")), "block")
    starts = sums.withColumn("block_start", F.sum("block_tokens").over(shuffled) - F.col("block_tokens")).select("source", "block", "epoch", "block_start")

    within = Window.partitionBy("source", "block", "epoch").orderBy(_draw(seed, "doc", F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = taken.join(starts, ["source", "block", "epoch"]).withColumn("start", F.col("epoch") * F.col("tokens") + F.col("block_start") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    kept = placed.where((F.col("epoch") < F.col("whole")) | (F.col("start") < F.col("quota")))
    return kept.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), F.coalesce(F.col("start") / F.when(F.col("quota") > 0, F.col("quota")), F.lit(0.0)).alias("place"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to 95 % of the largest entropy within four repetitions."""
    out = mix_sources(frames.documents(spark, sf_dir))
    return out.withColumn("place", F.round("place", 9))


#: The same bisection, permutations and quotas; place is compared to nine decimals.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source),
p AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM s) AS share FROM s WHERE tokens > 0),
goal AS (SELECT 0.95 * ln(count(*)) AS aim, count(*) AS n, -sum(share * ln(share)) AS plain FROM p),
b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN (low + high) / 2 ELSE low END, CASE WHEN good THEN high ELSE (low + high) / 2 END
  FROM (SELECT b.i, b.low, b.high,
          (SELECT ln(sum(pow(share, (b.low + b.high) / 2))) - sum(pow(share, (b.low + b.high) / 2) * ((b.low + b.high) / 2) * ln(share)) / sum(pow(share, (b.low + b.high) / 2)) FROM p) >= (SELECT aim FROM goal) AS good
        FROM b WHERE b.i < 60)),
e1 AS (SELECT CASE WHEN (SELECT n > 1 AND plain < aim FROM goal) THEN (SELECT (low + high) / 2 FROM b WHERE i = 60) ELSE 1.0 END AS e),
c AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN (low + high) / 2 ELSE low END, CASE WHEN good THEN high ELSE (low + high) / 2 END
  FROM (SELECT c.i, c.low, c.high,
          (SELECT max(pow(share, (c.low + c.high) / 2 - 1)) / min(pow(share, (c.low + c.high) / 2 - 1)) FROM p) > 4 AS good
        FROM c WHERE c.i < 60)),
e AS (SELECT CASE WHEN (SELECT max(pow(share, e - 1)) / min(pow(share, e - 1)) FROM p) > 4 + 1e-9
             THEN greatest(e, (SELECT (low + high) / 2 FROM c WHERE i = 60)) ELSE e END AS e FROM e1),
w AS (SELECT source, tokens, round(pow(share, e) / (SELECT sum(pow(share, e)) FROM p), 9) AS weight FROM p, e),
q AS (SELECT s.source, s.tokens, s.docs, CASE WHEN s.tokens = 0 THEN 0 ELSE greatest(s.tokens, CAST(floor(w.weight * (SELECT max(tokens / weight) FROM w)) AS BIGINT)) END AS quota
      FROM s LEFT JOIN w USING (source)),
plan AS (SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE quota // tokens END AS whole,
                CASE WHEN tokens = 0 THEN 1 ELSE (quota + tokens - 1) // tokens END AS epochs,
                CAST(ceil(docs / greatest(1000, ceil(sqrt(docs)))) AS BIGINT) AS blocks FROM q),
dealt AS (SELECT d.doc_id, d.n_tokens, plan.*, CAST('0x' || substr(md5('1:' || d.doc_id), 1, 8) AS BIGINT) % blocks AS block FROM d JOIN plan USING (source)),
taken AS (SELECT *, unnest(range(CAST(epochs AS BIGINT))) AS epoch FROM dealt),
sums AS (SELECT source, block, epoch, sum(n_tokens) AS block_tokens FROM taken GROUP BY ALL),
starts AS (SELECT source, block, epoch, sum(block_tokens) OVER (PARTITION BY source, epoch ORDER BY md5('1:block:' || epoch || ':' || source || ':' || block), block ROWS UNBOUNDED PRECEDING) - block_tokens AS block_start FROM sums),
placed AS (SELECT taken.*, epoch * tokens + block_start - n_tokens
             + sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY md5('1:doc:' || epoch || ':' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) AS start
           FROM taken JOIN starts USING (source, block, epoch))
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, round(coalesce(CAST(start AS DOUBLE) / nullif(quota, 0), 0), 9) AS place
FROM placed WHERE epoch < whole OR start < quota
"""
