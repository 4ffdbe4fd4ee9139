"""Git as a source: commits, what they changed, and the files of a commit as chunks; the work tree is not touched."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.schema import CHUNK
from lodeseam.sources.steps import snapshot
from lodeseam.sources.tree import chunk_files, is_eligible, language_of, repository_id


def _git(repository: str, *arguments: str) -> bytes:
    try:
        return subprocess.run(["git", "-C", repository, *arguments], check=True, capture_output=True).stdout
    except subprocess.CalledProcessError as e:
        raise ValueError(e.stderr.decode(errors="replace").strip() or "git failed") from e


def root_of(repository: str) -> str:
    """The top folder of the work tree that ``repository`` is in."""
    return _git(repository, "rev-parse", "--show-toplevel").decode().rstrip("\n")


def resolve_commit(repository: str, revision: str) -> tuple[str, list[str]]:
    """(commit, parents) of a revision; an empty one and one that looks like an option raise ValueError."""
    if not revision.strip() or revision.startswith("-"):
        raise ValueError("not a revision")
    commit = _git(repository, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().split()[-1]
    return commit, _git(repository, "rev-list", "--parents", "-n", "1", commit).decode().split()[1:]


def changed_paths(repository: str, commit: str, parents: list[str]) -> tuple[list[str], dict[str, str]]:
    """(paths, renames from old to new) against the first parent; none for a root."""
    if not parents:
        return [], {}
    # fields end in NUL, so that no path is quoted: a status, then one path, or two of what has moved
    fields = iter(_git(repository, "diff", "--find-renames", "--name-status", "-z", parents[0], commit).decode(errors="replace").split("\0")[:-1])
    moves = [(status[0], next(fields), next(fields) if status[0] in "RC" else None) for status in fields]
    return sorted({p for _, *paths in moves for p in paths if p is not None}), {old: new for status, old, new in moves if status == "R"}


def trees(spark: SparkSession, repository: str, commits: DataFrame) -> DataFrame:
    """(version_id, file_path, language, blob) of the eligible files of each commit, from its tree alone: no content is read.

    A file is named by its blob, the hash of its content; links and submodules are left out.  The
    repository has to be there on the executors.
    """

    def run(parts):
        for commit in (c for part in parts for c in part["version_id"]):
            rows = []
            with subprocess.Popen(["git", "-C", repository, "ls-tree", "-r", "-z", "-l", "--full-tree", commit], stdout=subprocess.PIPE) as lister:
                for entry in _until_nul(lister.stdout):
                    about, _, path = entry.partition(b"\t")
                    mode, kind, blob, size = about.split()
                    name = path.decode(errors="replace")
                    if kind == b"blob" and mode.startswith(b"100") and is_eligible(name, int(size)):
                        rows.append((commit, name, blob.decode()))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["version_id", "file_path", "blob"])
                        rows = []
            if lister.returncode:
                raise ValueError(f"git ls-tree of {commit} failed")
            yield pd.DataFrame(rows, columns=["version_id", "file_path", "blob"], dtype=object)

    found = commits.select("version_id").repartition("version_id").mapInPandas(run, "version_id string, file_path string, blob string")
    return found.select("version_id", "file_path", language_of(F.col("file_path")).alias("language"), "blob")


def _until_nul(stream):
    """The parts of a stream of bytes that end in NUL."""
    rest = b""
    while part := stream.read(1 << 16):
        *whole, rest = (rest + part).split(b"\0")
        yield from whole


def blobs(spark: SparkSession, repository: str, wanted: DataFrame) -> DataFrame:
    """(blob, language, text) of ``wanted`` (blob, language): each is read once, by one process a task; text is null if it isn't UTF-8."""

    def run(parts):
        with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as reader:
            for part in parts:
                for low in range(0, len(part), 200):
                    some, contents = part.iloc[low : low + 200], []
                    for blob in some["blob"]:
                        reader.stdin.write(f"{blob}\n".encode())
                        reader.stdin.flush()
                        said = reader.stdout.readline().split()
                        if len(said) != 3:
                            raise ValueError(f"no blob {blob}")
                        contents.append(reader.stdout.read(int(said[2])))
                        reader.stdout.read(1)
                    yield pd.DataFrame({"blob": list(some["blob"]), "language": list(some["language"]), "content": contents})
            reader.stdin.close()

    found = wanted.repartition("blob").mapInPandas(run, "blob string, language string, content binary")
    return found.select("blob", "language", F.try_validate_utf8("content").alias("text"))


VERSION = "version_id string, version_label string, commit_hash string, parents array<string>, changed_paths array<string>, renames map<string,string>, position int"


def index_versions(spark: SparkSession, repository: str, revisions: dict[str, str | None], known: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, files, chunks) for revisions by label (without a revision, the label is one): chunk ids of a version also hash the commit.

    Versions share most of their files: each different content is read and parsed once, and its chunks are joined to all
    trees that hold it.  Attributes that change an archive's content (export-ignore, export-subst) are not looked at.

    ``known`` are commits that are indexed, with their labels: they are left out, and a label of
    theirs, or one that repeats, raises ValueError for another commit.
    """
    top = root_of(repository)
    name, records, taken = repository_id(top), [], dict(known or {})
    for label, revision in revisions.items():
        commit, parents = resolve_commit(top, label if revision is None else revision)
        if commit in taken:
            continue
        if label in taken.values():
            raise ValueError(f"the label {label} is another version's")
        taken[commit] = label
        records.append((commit, label, commit, parents, *changed_paths(top, commit, parents), len(taken) - 1))
    versions = spark.createDataFrame(records, VERSION)
    found = snapshot(trees(spark, top, versions))
    texts = snapshot(blobs(spark, top, found.select("blob", "language").distinct()))
    parsed = snapshot(chunk_files(texts.select(F.col("blob").alias("file_path"), "language", "text"), name).where("chunk_id is not null"))
    of_blob = parsed.drop("warning", "version_id", "version_label", "commit_hash", "chunk_id").withColumnRenamed("file_path", "blob")
    chunks = found.join(of_blob, ["blob", "language"])
    plain = F.substring(F.sha1(F.concat_ws(":", "repository_id", "file_path", "symbol_name", "symbol_type", F.col("start_line").cast("string"), F.col("end_line").cast("string"))), 1, 20)
    chunks = chunks.withColumn("chunk_id", F.substring(F.sha1(F.concat_ws(":", plain, "version_id")), 1, 20))
    chunks = chunks.join(versions.select("version_id", "version_label", "commit_hash"), "version_id").select(*CHUNK.names)
    readable = texts.where("text is not null").select("blob", "language")
    return versions, found.join(readable, ["blob", "language"]).groupBy("version_id").agg(F.count("*").alias("number_of_files")), chunks
