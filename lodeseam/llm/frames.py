"""Small DataFrame helpers that several operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.sources.arrow import _BATCH, BATCH_BYTES, in_arrow  # noqa: F401
from lodeseam.sources.steps import shared_folder, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; one that is read in fewer splits than there are cores is dealt to all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 400_000


def local(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table of the driver's; unlike rows of Python objects, it needs no Python workers."""
    return spark.createDataFrame(pa.table(columns))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _keyed(df: DataFrame, row, keys: DataFrame, how: str) -> DataFrame:
    keys = stored(keys, "keys")
    names = [unused(df, f"key_{k}") for k in range(len(row))]
    keys = keys.toDF(*names)
    match = F.lit(True)
    for value, name in zip(row, names):
        match = match & value.eqNullSafe(F.col(name))
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, match, how)


def without(df: DataFrame, row, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose values ``row`` (columns) are not among ``keys``; nulls are equal.

    Keys are counted first: up to ``BROADCAST_KEYS`` go to all tasks and ``df`` stays where it is.
    """
    return _keyed(df, row, keys, "left_anti")


def only(df: DataFrame, row, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose values ``row`` (columns) are among ``keys``; nulls are equal."""
    return _keyed(df, row, keys, "left_semi")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, for choosing numbers of buckets."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def range_buckets(docs: DataFrame, count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, doc_id, text) of ``docs``, in ``count`` buckets that hold about as many rows each.

    Buckets follow the order of doc_id: a smaller one is never in a later bucket, and
    equal ones share a bucket.  Rows without a doc_id are in the last bucket.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = []
    if count > 1:
        shares = [k / count for k in range(1, count)]
        cuts = rows.approxQuantile("doc_id", shares, 1 / (8 * count)) or []
    cuts = sorted(set(cuts))
    splits = [-float("inf"), *cuts, float("inf")] if cuts else [-float("inf"), 0.0, float("inf")]
    place = Bucketizer(splits=splits, inputCol="place", outputCol="bucket", handleInvalid="keep")
    placed = place.transform(rows.withColumn("place", F.col("doc_id").cast("double")))
    return placed.select(F.coalesce("bucket", F.lit(len(splits) - 1)).cast("int").alias("bucket"), "doc_id", "text")
