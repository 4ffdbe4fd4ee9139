import random

from pyspark.sql import functions as F

from lodeseam.operators import lexical
from tests.test_operators import chunk_rows


def plain(index, queries, k):
    """Every posting of every term, scored."""
    n, avgdl = index.corpus_stats.first()
    terms = lexical.query_terms(queries).join(index.term_stats, "term").join(index.postings, "term")
    part = F.col("qtf") * lexical.term_weight(F.lit(n), F.col("df")) * lexical.impact(F.col("tf"), F.col("dl"), F.lit(avgdl), index.k1, index.b)
    scored = terms.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).join(index.doc_stats, "chunk_id")
    return lexical.ranked(scored, k)


def test_equal_to_scoring_all_postings_and_fewer(spark, monkeypatch):
    r = random.Random(2)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    docs = [" ".join(r.choices(common, k=r.randrange(5, 40)) + r.choices(rare, k=r.randrange(4))) for _ in range(2500)]
    docs += docs[:300]  # ties
    index = lexical.build(chunk_rows(spark, [(f"d{k}", f"{k % 7}.py", "s", "function", t, None, [], []) for k, t in enumerate(docs)]))
    asked = [(q, " ".join(r.choices(rare, k=r.randrange(4)) + r.choices(common, k=r.randrange(6)))) for q in range(40)]
    asked += [(100, "c1 c1 c2"), (101, "r1"), (102, "nowhere"), (103, ""), (104, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    monkeypatch.setattr(lexical, "PROBE", 20)
    monkeypatch.setattr(lexical, "DIRECT", 0)
    key = lambda x: (x.query_id, x["rank"], x.chunk_id, round(x.score, 8))
    for k in (1, 10, 4000):
        told = []
        got = lexical.search(index, queries, k, lambda name, n, told=told: told.append((name, n))).collect()
        assert sorted(map(key, got)) == sorted(map(key, plain(index, queries, k).collect()))
    told = []
    monkeypatch.setattr(lexical, "IDLE", 0.9)
    lexical.search(index, queries, 10, lambda name, n: told.append((name, n)))
    everything = lexical.query_terms(queries).join(index.term_stats, "term").agg(F.sum("df")).first()[0]
    assert sum(n for name, n in told if name.startswith("postings")) < 0.7 * everything, (told, everything)


def test_no_rows_without_queries_or_results(spark):
    index = lexical.build(chunk_rows(spark, [("a", "a.py", "a", "function", "x", None, [], [])]))
    none = spark.createDataFrame([], "query_id int, query string")
    assert lexical.search(index, none).collect() == []
    assert lexical.search(index, spark.createDataFrame([(1, "x")], none.schema), 0).collect() == []
