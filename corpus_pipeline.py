"""A corpus made ready for training: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import bpe, exactdup, frames, mixing, neardup, toxicity


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels outside the held-out fifth does not call toxic.

    A null or empty text has no matches and stays.  Rows are judged each by itself, so repeated
    ones go or stay together, with or without a doc_id; an empty table stays empty, and all
    columns come back as they are, whatever else they are.  Labels without a doc_id, a value or a
    document are left out; without any toxic label nothing is dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with most code points, then the smallest doc_id.

    Null texts count as empty, and empty texts are one group.  A row without a doc_id comes
    last; of rows that repeat doc_id and length, the first by text stays, and of wholly
    repeated rows one.  An empty table stays empty; columns of any name come back as they are.
    """
    return exactdup.keep_one(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies: five-word shingles, similarity 0.8.

    Texts that are null, empty or without words are like nothing and stay, as do rows without
    a doc_id.  Rows of one doc_id are one document and go or stay together.  An empty table
    stays empty; columns of any name come back as they are.
    """
    copies = neardup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return frames.without(docs, (F.col("doc_id").cast("long"),), copies)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: at least once, so that none is lost.

    A null source is the source "".  Null and empty texts have no tokens and are taken once if
    their source has none, else with the source's other documents.  Rows of one doc_id (or
    without any) are taken alike, as often as any of them is.  An empty table stays empty;
    columns of any name come back as they are.
    """
    taken, times, time = (frames.unused(docs, name) for name in ("taken", "times", "time"))
    each = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(taken)).agg(F.countDistinct("epoch").cast("int").alias(times))
    often = docs.join(each, F.col("doc_id").cast("long").eqNullSafe(F.col(taken)))
    return often.withColumn(time, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of each text, and a digest of the bytes that they decode to.

    A row for each row, repeated ones and those without a doc_id as well; a null or empty text
    has no ids.  An empty table gives an empty result; other columns are ignored.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: A learned score, an edit automaton and byte-pair merges are beyond SQL: the test has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; what each stage before it returns is stored and read again."""
    docs = frames.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = frames.stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
