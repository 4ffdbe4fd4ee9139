"""What a query moves, and where: plans whose largest task or shuffle must not grow faster than the input."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseam.functions import text
from lodeseam.llm.frames import _BATCH, BATCH_BYTES
from lodeseam.operators import lexical, semantic, versions
from lodeseam.plans import queries
from lodeseam.sources.steps import shuffled, snapshot
from tests.test_operators import chunk_rows

SAID = ["", "plain words plain", "Hello hello HTTPServer parse_Query __init__ _x_ a_b_C", "É éÉ straße_Größe 12 a1_B2 ___", None, "İstanbul ΣΑΣ x" * 30]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark, ids=None):
    return chunk_rows(spark, [(ids[k] if ids else f"d{k}", f"{k % 3}.py", "s", "function", t, None, [], []) for k, t in enumerate(SAID)])


def test_bag_holds_the_tokens(spark):
    rows = spark.createDataFrame([(s,) for s in SAID], "s string")
    for r in rows.select(F.sort_array(text.bag(F.col("s"))).alias("a"), F.sort_array(text.tokenize(F.col("s"))).alias("b")).collect():
        assert r.a == r.b


def test_postings_are_counted_where_texts_are_read(spark):
    rows = rows_of(spark)
    got = lexical.count_terms(rows)
    assert "hashpartitioning" not in plan(got)
    said = rows.select("chunk_id", text.tokenize(text.searchable_text()).alias("t"))
    want = said.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert sorted(lexical.lengths(rows).select("chunk_id", "dl").collect()) == sorted(lexical.build(rows).doc_stats.select("chunk_id", "dl").collect())
    twice = lexical.count_terms(rows_of(spark, ["x"] * len(SAID))).collect()
    assert len(twice) == len({r.term for r in twice}) and sum(r.tf for r in twice) == sum(r.dl for r in lexical.lengths(rows).collect())


def test_counters_equal_counting_by_groups(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"], []), (2, [], ["c"]), (3, ["b"] * 5, ["b", "a"])], "id int, a array<string>, b array<string>")
    got = {r.id: (r.a, r.b) for r in lexical.counters(rows, "a", "b").collect()}
    assert got == {1: ({"a": 2, "b": 1}, {}), 2: ({}, {"c": 1}), 3: ({"b": 5}, {"a": 1, "b": 1})}
    assert "ObjectHashAggregate" not in plan(lexical.counters(rows, "a", "b"))


def test_ties_of_the_last_place_stay_until_places_break_them(spark):
    scored = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 1.0 + 1e-12), (1, "d", 0.5), (2, "a", 0.1)], "query_id int, chunk_id string, score double")
    assert sorted((r.query_id, r.chunk_id) for r in lexical.leading(scored, 2).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]
    assert lexical.leading(scored, 0).isEmpty()
    index = lexical.build(rows_of(spark))
    found = plan(lexical.search(index, spark.createDataFrame([(1, "plain x")], "query_id int, query string")))
    assert found.count("WindowGroupLimit") >= 3  # before places are joined as well


def test_no_task_reads_a_version_by_itself(spark):
    rows = rows_of(spark).withColumns({"version_id": F.lit("v"), "version_label": F.lit("l")})
    asked = spark.createDataFrame([(1, "plain x hello")], "query_id int, query string")
    scored = versions._lexical(rows, asked, 1.5, 0.75, 10)
    assert "hashpartitioning(version_id" not in plan(scored)
    plain = lexical.search(lexical.build(rows), asked, 10).collect()
    assert sorted((r.chunk_id, round(r.score, 8)) for r in scored.collect()) == sorted((r.chunk_id, round(r.score, 8)) for r in plain)


def test_grown_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    rows = snapshot(spark.range(1000).select("id", F.array_repeat(F.lit("token"), 50).alias("tokens")))
    assert "BroadcastExchange" in plan(rows.join(rows.select("id"), "id"))
    for side in (shuffled(rows), shuffled(rows).select("id"), shuffled(rows).groupBy("id").count()):
        assert "BroadcastExchange" not in plan(rows.join(side, "id"))


def test_digits_are_found_once_a_text(spark):
    rows = spark.createDataFrame([(1, "some words and Words"), (2, "")], "id int, s string")
    made = queries.digit_counts(rows, "id", F.col("s"))
    assert plan(made).count("md5") == 1
    for r in made.join(rows, "id").select("vector", F.transform(text.tokenize(F.col("s")), lambda t: F.substring(F.md5(t), 1, 1)).alias("d")).collect():
        assert r.vector == [float(r.d.count(x)) for x in "0123456789abcdef"]


def test_multi_pass_shuffles_no_words_and_sorts_no_texts(spark, monkeypatch):
    given, windows = [], []
    monkeypatch.setattr(queries.multipass, "search", lambda index, vectors, nodes, edges, rows, asked, **_: given.extend((index, rows)) or (asked.select("query_id", F.lit("c").alias("chunk_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score")), asked.select("query_id", *(F.lit(0).alias(c) for c in ("pass1", "seeds", "expansions", "added", "pass5")))))
    monkeypatch.setattr(queries, "snapshot", lambda df: windows.append(df._jdf.queryExecution().optimizedPlan().toString()) or snapshot(df))
    assert queries.multi_pass(spark, "/root/testdata/sf0.001").count() > 0
    assert isinstance(given[0], lexical.Packed)
    texts = [x for x in windows[0].split("\n") if "Relation" in x and "text#" in x]
    below = windows[0][windows[0].index("Window") :]
    assert len(texts) == 2 and "text#" not in below[: below.index("Relation")]  # what the window sorts is without them
    after = F.lead("symbol_name").over(Window.partitionBy(F.substring_index("file_path", "/", 1)).orderBy(F.col("chunk_id").cast("long")))
    want = queries.chunks(spark, "/root/testdata/sf0.001").select("chunk_id", F.array_compact(F.array(after)).alias("calls"), "code")
    assert sorted(given[1].select("chunk_id", "calls", "code").collect()) == sorted(want.collect())


def test_vectors_come_in_small_batches(spark):
    spark.conf.unset(_BATCH)
    rows = spark.range(20).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    found = semantic.search(rows, rows.where("chunk_id < 2").withColumnRenamed("chunk_id", "query_id"), 3)
    assert spark.conf.get(_BATCH) == str(BATCH_BYTES)
    assert found.count() == 6
