"""Chunks that arrive as a stream, kept as an index by repository and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodeseam.functions.text import searchable_text, tokenize
from lodeseam.operators.lexical import LexicalIndex, from_postings
from lodeseam.schema import CHUNK
from lodeseam.sources.log import names

#: So many segments of a level are merged into one of the next.
FANOUT = 8

_DOCS = "chunk_id string, dl int, file_path string, start_line int, deleted boolean, seen long"
_POSTINGS = "chunk_id string, term string, tf long, dl int, seen long"


def chunk_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of chunks, file by file as they appear; a line with ``deleted`` true and a chunk_id takes the chunk out."""
    return spark.readStream.schema(T.StructType([*CHUNK, T.StructField("deleted", T.BooleanType())])).json(folder)


def segments(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(first batch, last batch, level) of the segments that count, oldest first: whole ones that no other whole one covers."""
    found = [tuple(map(int, n.split("=")[1].split("-"))) for n in names(spark, f"{path}/doc_stats") if n.startswith("segment=")]
    whole = [s for s in found if "_SUCCESS" in names(spark, f"{path}/doc_stats/{_name(s)}")]
    return sorted(s for s in whole if not any(o != s and o[0] <= s[0] and s[1] <= o[1] and o[2] > s[2] for o in whole))


def _name(segment: tuple[int, int, int]) -> str:
    return "segment={}-{}-{}".format(*segment)


def _read(spark: SparkSession, path: str, parts: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Postings and rows of chunks in these segments, of each chunk as it was last seen."""
    table = lambda name, schema: spark.read.schema(schema).parquet(*(f"{path}/{name}/{_name(s)}" for s in parts)) if parts else spark.createDataFrame([], schema)
    docs, postings = table("doc_stats", _DOCS), table("postings", _POSTINGS)
    newest = docs.groupBy("chunk_id").agg(F.max_by(F.struct("dl", "file_path", "start_line", "deleted", "seen"), "seen").alias("d")).select("chunk_id", "d.*")
    return postings.join(newest.select("chunk_id", "seen"), ["chunk_id", "seen"], "left_semi"), newest


def _write(path: str, segment: tuple[int, int, int], postings: DataFrame, docs: DataFrame) -> None:
    """The rows of chunks come last: a segment without them does not count."""
    postings.write.mode("overwrite").parquet(f"{path}/postings/{_name(segment)}")
    docs.write.mode("overwrite").parquet(f"{path}/doc_stats/{_name(segment)}")


def merge(spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
    """Merge each run of ``fanout`` segments of a level into one of the next level, until no level has so many.

    Of each chunk the newest state stays; a deletion does too, unless nothing older is left that it could hide.
    Merged segments no longer count but stay where readers may have them open; the folder is the owner's to clean.
    """
    while True:
        whole = segments(spark, path)
        level = next((k for k in sorted({s[2] for s in whole}) if sum(s[2] == k for s in whole) >= fanout), None)
        if level is None:
            return
        run = [s for s in whole if s[2] == level][:fanout]
        postings, docs = _read(spark, path, run)
        if run[0] == whole[0]:
            docs = docs.where("not deleted")
        _write(path, (run[0][0], run[-1][1], level + 1), postings, docs)


def index_stream(chunks: DataFrame, path: str, checkpoint: str, fanout: int = FANOUT) -> StreamingQuery:
    """Writes the postings and lengths of new chunks below ``path``, a segment a batch, until what is there is done.

    A chunk that comes again replaces what was seen of it before, and one that is ``deleted`` goes. If a batch says several things
    of a chunk, a deletion counts last, then the greatest (file_path, start_line, tokens).
    A batch writes its own segment, and again only if that was left incomplete, so a restart counts
    nothing twice.  df, the number of chunks and their mean length are read from what is stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        said = batch.select("chunk_id", F.struct(deleted.alias("deleted"), "file_path", "start_line", tokenize(searchable_text()).alias("tokens")).alias("d"))
        rows = said.groupBy("chunk_id").agg(F.max("d").alias("d")).select("chunk_id", "d.*", F.lit(number).cast("long").alias("seen"))
        words = rows.where("not deleted").select("chunk_id", "seen", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        postings = words.groupBy("chunk_id", "term", "seen").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
        docs = rows.select("chunk_id", F.size("tokens").alias("dl"), "file_path", "start_line", "deleted", "seen")
        spark = batch.sparkSession
        if not any(first <= number <= end for first, end, _ in segments(spark, path)):
            _write(path, (number, number, 0), postings, docs)
        merge(spark, path, fanout)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, path: str) -> LexicalIndex:
    """The index of all batches so far."""
    postings, docs = _read(spark, path, segments(spark, path))
    return from_postings(postings.drop("seen"), docs.where("not deleted").drop("deleted", "seen"))
