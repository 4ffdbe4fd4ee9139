"""A log of numbered entries, each the whole state as JSON, of which a number is written once."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def _reach(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in the folder, by name; nothing of one that is missing."""
    fs, target = _reach(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def last(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The number of the newest entry and what it says; (0, None) of an empty log."""
    numbers = [n for n in names(spark, folder) if n.endswith(".json") and not n.startswith("_")]
    if not numbers:
        return 0, None
    text = spark.read.text(f"{folder}/{numbers[-1]}", wholetext=True).first().value
    return int(numbers[-1].removesuffix(".json")), json.loads(text)


def append(spark: SparkSession, folder: str, number: int, state: dict) -> bool:
    """Write entry ``number`` unless it is there; was it written?

    The text is written aside and then takes its name in one step, which fails where the name is taken: a link in a
    local folder, elsewhere a rename of the file system, which HDFS refuses then.  Stores whose renames are not atomic need a single writer.
    """
    fs, target = _reach(spark, f"{folder}/{number:020d}.json")
    aside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if target.toUri().getScheme() != "file":
        if not fs.exists(target) and fs.rename(aside, target):
            return True
        fs.delete(aside, False)
        return False
    try:
        os.link(aside.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(aside, False)
