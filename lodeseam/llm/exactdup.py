"""Exact duplicates: a tree of merges over sorted runs of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm import frames

#: The characters that texts are compared without.
BLANKS = " \t\n\x0b\f\r"
_KEY = ("digest", "check", "length")


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def merge_runs(digests: DataFrame, runs: int, fan_in: int = 8) -> DataFrame:
    """(run, digest, check, length, best, size) from rows of these: the least ``best`` and the sum of sizes over all runs.

    A tree of merges, up and down again.  Each partition's digests are a sorted run.  On the
    way up, ``fan_in`` neighbouring runs meet in each round: an exchange by (run, digest), a
    merge sort, and one pass over the sorted run that folds equal digests, if a second hash and
    the length of the text agree (Spark's SortAggregate).  When one run is left, the verdicts go
    back the way that they came, from each merged run to those that it was merged from.  So
    every run, the last one as well, is spread over the tasks by its digests, and a digest
    meets ``fan_in`` rows a round in either direction, however many copies it has.
    """
    fold = lambda rows: frames.stored(rows.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size")), "run")
    above = lambda run: F.floor(run / fan_in).cast("int")
    levels = [fold(digests)]
    while runs > 1:
        levels.append(fold(levels[-1].withColumn("run", above(F.col("run")))))
        runs = -(-runs // fan_in)
    verdicts = levels.pop()
    while levels:
        met = levels.pop().select("run", *_KEY, above(F.col("run")).alias("merged"))
        verdicts = met.join(verdicts.withColumnRenamed("run", "merged"), ["merged", *_KEY]).drop("merged")
    return verdicts


def _judged(docs: DataFrame, fan_in: int, runs: int | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_chars, digest, size, best, n): the rows by what tells them apart, how often each is there, and its group's verdict."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    run = F.spark_partition_id() if runs is None else F.pmod(F.spark_partition_id(), F.lit(runs))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), normalised(text).alias("plain"))
    rows = plain.select("doc_id", "n_chars", F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain").alias("check"), F.length("plain").cast("long").alias("length"), run.alias("run"))
    rows = frames.stored(rows, "digests")
    if runs is None:
        runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "run")
    winners = merge_runs(rows.select("run", *_KEY, best.alias("best"), F.lit(1).cast("long").alias("size")), runs, fan_in)
    once = rows.groupBy("run", "doc_id", "n_chars", *_KEY).agg(F.count("*").alias("n"))
    return once.join(winners, ["run", *_KEY]).select("doc_id", "n_chars", "digest", "size", "best", "n", "run")


#: Does a row, or one of those that repeat it in its run, stay?
_STAYS = "n_chars = -best.less and doc_id <=> best.doc_id and run = best.run"


def exact_duplicates(docs: DataFrame, fan_in: int = 8, levels: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when identical without blanks; null counts as empty, and empty texts
    are equal to one another.  Of equal texts the row with the most code points stays, then
    the one of the smallest doc_id; a row without a doc_id comes last, and of repeated rows
    (same doc_id, same length) exactly one stays.  Other columns are ignored, and an empty
    table gives an empty result.  Each partition of ``docs`` is a run, or with ``levels``
    partitions share ``fan_in ** levels`` runs.
    """
    judged = _judged(docs, fan_in, None if levels is None else fan_in**levels, id_col, text_col)
    rows = judged.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    stays = F.expr(_STAYS) & (F.col("nth") == 1)
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which exact_duplicates() says that they stay.

    Texts are not shuffled as long as the rows that go are few enough to broadcast (see
    frames.without()).  Of rows that repeat doc_id, length and normalised text, which row
    stays is decided by the text.
    """
    judged = frames.stored(_judged(docs, fan_in, None, id_col, text_col), "judged")
    row = (F.col(id_col).cast("long"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long"), F.unhex(F.sha2(normalised(F.col(text_col).cast("string")), 256)))
    best = (F.col("n_chars") == -F.col("best.less")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    keys = judged.groupBy("doc_id", "n_chars", "digest").agg(F.first(best).alias("stays"), F.sum("n").alias("n"))
    left = frames.without(docs, row, keys.where("not stays").select("doc_id", "n_chars", "digest"))
    several = frames.stored(keys.where("stays and n > 1").select("doc_id", "n_chars", "digest"), "several")
    if several.isEmpty():
        return left
    key, nth = frames.unused(docs, "key"), frames.unused(docs, "nth")
    among = frames.only(left, row, several).withColumn(key, F.struct(*row))
    one = among.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(text_col))).where(F.col(nth) == 1)
    return frames.without(left, row, several).unionByName(one.select(docs.columns))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return exact_duplicates(frames.documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
