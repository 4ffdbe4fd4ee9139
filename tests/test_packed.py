"""Batches over packed chunks: what they find, and that no row for each query and chunk is shuffled."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseam.functions import text
from lodeseam.operators import lexical
from lodeseam.plans import queries as registered
from tests.test_growth import SAID, plan, rows_of
from tests.test_maxscore import plain
from tests.test_operators import chunk_rows

PACKED = ["bm25_batch", "hybrid_fusion", "hybrid_topk", "rerank_features", "rerank_topk"]
STORED = ["evaluate_ndcg_mrr"]  # the search is a step of its own


@pytest.fixture
def small(spark, monkeypatch):
    """Blocks of 100 chunks, rows of a few queries, scores of three queries at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    monkeypatch.setattr(lexical, "QUERIES", 20)
    monkeypatch.setattr(lexical, "HELD", 300)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_to_scoring_all_postings(spark, small):
    r = random.Random(3)
    words = [f"{c}{k}" for c in ("c", "r", "É", "Http_Server") for k in range(20)]
    docs = [" ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randrange(30))) for _ in range(1500)]
    docs += docs[:300] + ["c0 c1"] * 250 + SAID  # ties
    rows = chunk_rows(spark, [(f"d{k}", f"{'Aa'[k % 2]}{k % 7}.py", "s", "function", t, None, [], []) for k, t in enumerate(docs)])
    asked = [(q, " ".join(r.choices(words, k=r.randrange(8)))) for q in range(40)]
    asked += [(100, "c1 c1 c2"), (101, "r1"), (102, "nowhere"), (103, ""), (104, None), (105, "c0 c1")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    packed, index = lexical.pack(rows), lexical.build(rows)
    assert packed.blocks.count() > 15
    key = lambda x: (x.query_id, x["rank"], x.chunk_id, x.file_path, x.start_line, round(x.score, 8))
    for k in (1, 10, 4000):
        got = lexical.search(packed, queries, k)
        assert sorted(map(key, got.collect())) == sorted(map(key, plain(index, queries, k).collect()))
    assert got.columns == lexical.search(index, queries, 1).columns


def test_no_row_for_each_query_and_chunk_is_shuffled(spark):
    found = plan(registered.bm25_batch(spark, "/root/testdata/sf0.001"))
    assert found.count("hashpartitioning(") == found.count("hashpartitioning(query_id#") == 1  # of what tasks keep


def test_queries_of_one_batch_are_packed(spark, monkeypatch):
    """Before, postings were joined and each query's chunks grouped by a shuffle of them all."""
    monkeypatch.setattr(lexical, "build", None)
    for query in PACKED:
        assert "CartesianProduct" in plan(getattr(registered, query)(spark, "/root/testdata/sf0.001"))
    for query in STORED:
        assert getattr(registered, query)(spark, "/root/testdata/sf0.001").count() > 0


def test_no_rows_without_queries_chunks_or_results(spark):
    none, asked = (spark.createDataFrame(x, "query_id int, query string") for x in ([], [(1, "x plain")]))
    packed = lexical.pack(rows_of(spark))
    assert lexical.search(packed, none).collect() == []
    assert lexical.search(packed, asked, 0).collect() == []
    empty = lexical.pack(rows_of(spark).limit(0))
    assert (empty.n, empty.avgdl) == (0, 0.0) and lexical.search(empty, asked).collect() == []
    with pytest.raises(ValueError):
        lexical.pack(rows_of(spark), k1=0)


def test_chunks_that_share_an_id_are_summed(spark):
    rows, asked = rows_of(spark, ["x"] * len(SAID)), spark.createDataFrame([(1, "plain hello")], "query_id int, query string")
    key = lambda x: (x["rank"], x.chunk_id, round(x.score, 8))
    assert sorted(map(key, lexical.search(lexical.pack(rows), asked).collect())) == sorted(map(key, lexical.search(lexical.build(rows), asked).collect()))


def test_tokens_of_a_run_are_those_of_the_column(spark):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LN"]
    letters = [c for c in letters if not "丐" < c < "鼀" and not "감" < c < "휀" and c < "\U00020100"]
    said = [*SAID, *(f"{c} x{c} {c}x_{c}Y{c} _{c}{c}" for c in letters)]
    rows = spark.createDataFrame([(s,) for s in said], "s string").repartition(8)
    for r in rows.select("s", text.tokenize(F.col("s")).alias("want"), text.runs(F.col("s")).alias("runs")).collect():
        assert [t for run in r.runs for t in text.run_tokens(run)] == r.want, r.s


def test_capitalised_runs_are_not_looked_at_one_by_one(monkeypatch):
    """Before, each different run with a capital was split in Python: nine of ten of those that were, over check_s."""
    seen = []
    monkeypatch.setattr(lexical, "run_tokens", lambda r: seen.append(r) or text.run_tokens(r))
    capitals = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Lu", "Lt")]
    said = [["Hello", "hello", "É", "Élan", "élan", "A1", "Hello"], ["HTTPServer", "x_Y", "ABC", "__", "Hello", "Z"], [], [f"{c}{x}" for c in capitals for x in ("", "a", f"a{c}")]]
    ids = [f"d{k}" for k in range(len(said))]
    rows = pa.record_batch([pa.array(ids), pa.array(["f"] * len(ids)), pa.array([1] * len(ids), pa.int32()), pa.array(["f"] * len(ids)), pa.array(said, pa.list_(pa.string()))], names=["chunk_id", "file_path", "start_line", "place", "runs"])
    block = next(iter(lexical._blocks([rows]))).to_pylist()[0]
    docs, tfs, lengths = (np.frombuffer(block[c], np.int32).tolist() for c in ("docs", "tfs", "lengths"))
    got = {(d, w): n for w, d, n in zip(np.repeat(block["words"], block["dfs"]).tolist(), docs, tfs)}
    want = [[t for r in runs for t in text.run_tokens(r)] for runs in said]
    assert got == {(k, t): tokens.count(t) for k, tokens in enumerate(want) for t in set(tokens)}
    assert lengths == [len(tokens) for tokens in want] and block["total"] == sum(lengths)
    assert {"HTTPServer", "x_Y", "ABC", "__"} <= set(seen) and not {"Hello", "É", "Élan", "A1", "Z"} & set(seen)
