import corpus_pipeline
import pytest
from pyspark.sql import functions as F

#: Names that the stages' operators use themselves.
CLASHING = ("keep", "kept", "text_sha256", "nth", "taken", "times", "time", "key", "key_0", "digest", "n", "run", "component_id", "score", "bucket", "epoch", "place", "best")
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (900, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(spark, given):
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in given], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in CLASHING))


def run(stage, spark, docs, home):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, home)
    assert out.columns == docs.columns
    got = out.collect()
    for r in got:  # a user's column is what it was
        assert all(r[name] == f"{name}:{'none' if r.doc_id is None else r.doc_id}" for name in CLASHING)
    return sorted(((r.doc_id, r.text) for r in got), key=repr)


HARD = [(1, "a b", "x"), (2, "ab", "x"), (3, None, None), (4, "", "y"), (4, "", "y"), (5, "long " * 3000, "x"), (None, None, None), (None, "a  b", "x"), (6, "other", "x"), (6, "other", "x"), (7, " \n", None)]


def test_toxicity(spark, home):
    given = [(k, f"document number {k} {'scumbag' if k % 2 else 'flower'} ends", "s") for k in range(40)] + [(100, "you scumbag", "s"), (100, "you scumbag", "s"), (101, "a flower", "s")]
    got = run("toxicity", spark, rows(spark, given + HARD), home)
    want = [(d, t) for d, t, _ in given + HARD if "scumbag" not in (t or "")]
    assert got == sorted(want, key=repr)


def test_exact_dedup(spark, home):
    got = run("exact dedup", spark, rows(spark, HARD).repartition(4), home)
    assert got == sorted([(None, "a  b"), (7, " \n"), (5, "long " * 3000), (6, "other")], key=repr)
    # of rows that repeat doc_id and length, the first by text
    assert run("exact dedup", spark, rows(spark, [(1, "a b\n", "s"), (1, "a\nb ", "s"), (1, "a b\n", "s"), (2, "ab", "s")]), home) == [(1, "a\nb ")]


def test_near_dedup(spark, home):
    base = " ".join(WORDS * 3)
    given = [(10, base + " tail", "s"), (11, base, "s"), (12, "head " + base, "s"), (13, "something else entirely", "s"), (11, base, "s")]
    got = run("MinHash near-dedup", spark, rows(spark, given + HARD), home)
    hard = [(d, t) for d, t, _ in HARD]
    assert got == sorted([(10, base + " tail"), (13, "something else entirely"), *hard], key=repr)


def test_mixing(spark, home):
    given = [(k, "w " * 10, "big") for k in range(20, 30)] + [(50, "w " * 25, "small"), (51, None, "none"), (52, "", None)]
    got = run("mixing sources to target weights", spark, rows(spark, given), home)
    assert set(got) == {(d, t) for d, t, _ in given}
    assert all(got.count((d, t)) == 1 for d, t, s in given if s != "small") and got.count((50, "w " * 25)) >= 2
    assert {d for d, _ in run("mixing sources to target weights", spark, rows(spark, HARD), home)} == {d for d, _, _ in HARD}


def test_empty_tables(spark, home):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert run(name, spark, rows(spark, HARD).limit(0), home) == []


def test_many_copies_by_a_shuffle(spark, home, monkeypatch):
    from lodeseam.llm import frames

    monkeypatch.setattr(frames, "BROADCAST_KEYS", 0)
    test_exact_dedup(spark, home)
    test_near_dedup(spark, home)
