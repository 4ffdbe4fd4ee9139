import math
import random
from collections import deque

import pytest
from lodeseam.functions import similarity, text
from lodeseam.operators import evaluate, fusion, graph, lexical, rerank, semantic, versions
from lodeseam.sources import tables, tree
from lodeseam.streaming import incremental
from pyspark.sql import functions as F


def tokens(s):
    """The tokens of a text, letter by letter."""
    out, run = [], ""
    for ch in s + " ":
        if ch.isalnum() or ch == "_":
            run += ch
            continue
        raw, run = run.strip("_"), ""
        if not raw:
            continue
        out.append(raw.lower())
        before = raw.lower()
        for part in filter(None, raw.split("_")):
            if part != before:
                out.append(part.lower())
            before = part.lower()
        for part in raw.split("_"):
            pieces, piece = [], ""
            for k, ch2 in enumerate(part):
                if k and ch2.isupper():
                    pieces.append(piece)
                    piece = ""
                piece += ch2
            pieces.append(piece)
            if len(pieces) > 1:
                out += [p.lower() for p in pieces]
    return out


def test_tokenizer(spark):
    said = ["FILE: hash_password", "getUserName_x2", "__init__ a__b Python", "", "héÉllo_Wörld ½ 漢字", "x_X_x A_b", "snake_case_Name HTTPServer"]
    r = random.Random(1)
    said += ["".join(r.choices("aAbB_1é .É", k=30)) for _ in range(80)]
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.tokenize(F.col("s")).alias("t")).collect()
    for row in got:
        assert row.t == tokens(row.s), row.s
    assert tokens("FILE") == ["file", "file", "f", "i", "l", "e"] and tokens("hash_password") == ["hash_password", "hash", "password"]
    assert spark.range(1).select(text.tokenize(F.lit(None).cast("string")).alias("t")).first().t == []


def chunk_rows(spark, rows):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    frame = spark.createDataFrame(rows, "chunk_id string, file_path string, symbol_name string, symbol_type string, code string, parent_symbol string, calls array<string>, imports array<string>")
    return frame.withColumns({"repository_id": F.lit("r"), "language": F.lit("Python"), "start_line": F.lit(1), "end_line": F.lit(2), "docstring": F.lit(""), "class_name": none, "version_id": none, "version_label": none, "commit_hash": none}).withColumn("imports", F.coalesce("imports", empty))


def test_bm25_scores_and_storage(spark, tmp_path):
    docs = {"a": "alpha beta beta", "b": "beta gamma", "c": "delta"}
    chunks = chunk_rows(spark, [(k, f"{k}.py", k, "function", v, None, [], []) for k, v in docs.items()])
    index = lexical.build(chunks)
    tables.save_lexical(index, f"{tmp_path}/index")
    stored = tables.load_lexical(spark, f"{tmp_path}/index")
    queries = spark.createDataFrame([(1, "beta beta"), (2, "nothing_there"), (3, " ")], "query_id int, query string")
    bag = {k: tokens(f"FILE: {k}.py\nLANGUAGE: Python\nTYPE: function\nSYMBOL: {k}\nCODE:\n{v}") for k, v in docs.items()}
    mean = sum(map(len, bag.values())) / 3
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    want = {}
    for k, t in bag.items():
        if tf := t.count("beta"):
            want[k] = 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    for each in (index, stored):
        got = lexical.search(each, queries).collect()
        assert {r.query_id for r in got} == {1}
        assert {r.chunk_id: r.score for r in got} == pytest.approx(want)
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=want.get, reverse=True)
    with pytest.raises(ValueError):
        lexical.LexicalIndex(None, None, None, None, k1=0)
    with pytest.raises(ValueError):
        lexical.search(index, queries, -1)


def test_semantic_search_in_blocks(spark):
    r = random.Random(8)
    base = [[float(r.randint(-3, 3)) for _ in range(4)] + [1.0] for _ in range(60)]
    rows = [(f"c{k}", base[k % 60] if k % 3 else base[0]) for k in range(200)]  # many ties
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(k, base[k % 60]) for k in range(70)], "query_id long, vector array<double>")
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)
    want = {k: [c for c, _ in sorted(((c, cosine(base[k % 60], v)) for c, v in rows), key=lambda p: (-p[1], p[0]))[:7]] for k in range(70)}
    for block in (16, 1000):
        got = {}
        found = semantic.search(vectors, queries, 7, block=block)
        for row in sorted(found.collect(), key=lambda row: row["rank"]):
            got.setdefault(row.query_id, []).append(row.chunk_id)
        assert got == want
        assert ("CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()) == (block == 1000)  # few blocks are all visited
    assert semantic.search(vectors, queries, 0).collect() == semantic.search(vectors, queries.limit(0)).collect() == semantic.search(vectors.limit(0), queries).collect() == []


def test_semantic_search(spark, tmp_path):
    rows = [(f"c{k}", [float(k == j) for j in range(3)]) for k in range(3)] + [("t", [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(9, [2.0, 0.0, 0.0])], "query_id long, vector array<double>")
    got = semantic.search(vectors.repartition(3), queries, 2).collect()
    assert [(r["rank"], r.chunk_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "c0", 1.0), (2, "t", 1.0)]
    with pytest.raises(Exception, match="dimensions"):
        semantic.search(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")).collect()
    with pytest.raises(Exception, match="finite"):
        semantic.normalize(spark.createDataFrame([("z", [0.0, 0.0])], "chunk_id string, vector array<double>")).collect()
    tables.save_vectors(vectors, f"{tmp_path}/v", "m")
    assert tables.load_vectors(spark, f"{tmp_path}/v", "m").count() == 4
    with pytest.raises(ValueError):
        tables.load_vectors(spark, f"{tmp_path}/v", "other")


def test_fusion_and_dedupe(spark):
    chunks = spark.createDataFrame([(c, f"{c}.py", 1) for c in ("lex", "shared", "sem")], "chunk_id string, file_path string, start_line int")
    results = lambda rows: spark.createDataFrame([(1, c, s, k + 1) for k, (c, s) in enumerate(rows)], "query_id int, chunk_id string, score double, rank int")
    fused = fusion.fuse(results([("lex", 10.0), ("shared", 2.0)]), results([("shared", 0.95), ("sem", 0.1)]), chunks, 0.25, 0.75)
    got = lexical.ranked(fused, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["shared", "lex", "sem"] and got[0].score == 0.75
    assert lexical.ranked(fusion.fuse(results([("lex", 3.5)]), results([]), chunks), 5).first().score == 0.5
    with pytest.raises(ValueError):
        fusion.fuse(results([]), results([]), chunks, 0, 0)
    twice = spark.createDataFrame([(1, "a", 0.5, "x"), (1, "a", 0.7, "x")], "query_id int, chunk_id string, score double, path string")
    assert fusion.dedupe(twice, ["path"]).first().score == 0.7
    with pytest.raises(Exception, match="differ"):
        fusion.dedupe(twice.withColumn("path", F.col("score").cast("string")), ["path"]).collect()


def test_rerank_features(spark):
    chunks = chunk_rows(spark, [("c", "auth/tokens.py", "Guard.check_token", "method", "x", None, ["jwt.decode"], ["hashlib"])])
    candidates = spark.createDataFrame([(1, "c", 0.6, 0.7)], "query_id int, chunk_id string, normalized_lexical double, normalized_semantic double")
    ask = lambda q: rerank.features(candidates, spark.createDataFrame([(1, q)], "query_id int, query string"), chunks).first()
    said = ask("how does check_token decode a jwt in python?")
    assert said.exact_symbol == 1.0 and said.language == 1.0 and said.dependency > 0 and said.intent > 0
    assert any(s.startswith("Exact symbol") for s in said.signals) and "Requested language matches: Python" in said.signals
    other = ask("recheck_tokens javascript")
    assert other.exact_symbol == 0.0 and other.language == 0.0
    with pytest.raises(ValueError):
        rerank.Weights(semantic=-1)


def test_evaluation(spark):
    results = spark.createDataFrame([(1, k + 1, f"c{k}") for k in range(12)], "query_id int, rank int, chunk_id string")
    judged = spark.createDataFrame([(1, "c1", 3), (1, "c11", 2), (1, "gone", 1), (2, "c0", 0)], "query_id int, chunk_id string, grade int")
    got = {r.query_id: r for r in evaluate.evaluate(results, judged).collect()}
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert got[1].ndcg == pytest.approx(7 / math.log2(3) / ideal) and got[1].rr == 0.5
    assert got[2].ndcg == 0 and got[2].rr == 0


def walk(nodes, edges, seeds, max_hops, cap):
    """Simple paths from each seed in turn, the shortest kept, until ``cap`` symbols are met."""
    found = {}
    for seed in dict.fromkeys(seeds):
        queue = deque([(seed, 0, (), {seed})])
        while queue and len(found) < cap:
            at, hops, path, visited = queue.popleft()
            if hops >= max_hops:
                continue
            steps = sorted({(r, s, t) for s, t, rs in edges for r in rs if at in (s, t)})
            for r, s, t in steps:
                to = t if s == at else s
                if to in visited:
                    continue
                label = nodes[to] or to
                path2 = (*path, f"{r} -> {label}" if s == at else f"{graph.INVERSE[r]} <- {label}")
                if nodes[to] and to != seed and (to not in found or hops + 1 < found[to][1]):
                    found[to] = (seed, hops + 1, path2)
                queue.append((to, hops + 1, path2, {*visited, to}))
                if len(found) >= cap:
                    break
    return found


@pytest.mark.parametrize(("hops", "cap"), [(3, 3), (2, 100)])
def test_expansion_is_the_naive_walk(spark, hops, cap):
    r = random.Random(hops)
    nodes, edges, seeds, want = [], [], [], {}
    for g in range(40):
        names = {f"g{g}n{k}": (f"s{g}{k}" if r.random() < 0.8 else None) for k in range(r.randint(3, 7))}
        own = {}
        for _ in range(r.randint(2, 10)):
            own.setdefault((r.choice(list(names)), r.choice(list(names))), set()).add(r.choice(graph.RELATIONS))
        own = [(s, t, sorted(x, key=graph.RELATIONS.index)) for (s, t), x in own.items()]
        start = r.sample([n for n in names if names[n]] or list(names), 1) + [n for n in names if names[n] and r.random() < 0.3]
        nodes += [(n, "symbol" if s else "file", s, f"{n}.py") for n, s in names.items()]
        edges += own
        seeds += [(g, n, k) for k, n in enumerate(dict.fromkeys(start))]
        found = walk({n: s for n, s in names.items()}, own, start, hops, cap)
        for n, (seed, h, path) in found.items():
            want[g, n] = (seed, h, [p.replace("<- " + n, "<- " + n) for p in path])
    node_rows = spark.createDataFrame(nodes, "node_id string, kind string, symbol_name string, file_path string")
    edge_rows = spark.createDataFrame(edges, "source string, target string, relations array<string>")
    got = graph.expand(node_rows, edge_rows, spark.createDataFrame(seeds, "query_id int, node_id string, position int"), hops, cap).collect()
    assert {(x.query_id, x.node_id): (x.seed, x.hops) for x in got} == {k: v[:2] for k, v in want.items()}
    for x in got:
        paths = [p.removesuffix(".py") for p in x.relation_path]
        assert paths == list(want[x.query_id, x.node_id][2]), x


def test_a_hub_is_split(spark):
    """A star: its edges lie under many keys, no task reads much more than another, and the result is that of the whole node."""
    n = 60_000
    leaves = spark.range(n).select(F.format_string("n%06d", "id").alias("leaf"))
    edge_rows = leaves.select(F.lit("hub").alias("source"), F.col("leaf").alias("target"), F.array(F.lit("CALLS")).alias("relations"))
    node_rows = leaves.union(spark.createDataFrame([("hub",)], "leaf string")).select(F.col("leaf").alias("node_id"), F.lit("symbol").alias("kind"), F.col("leaf").alias("symbol_name"), F.lit("a.py").alias("file_path"))
    steps, moves, heavy = graph.adjacency(edge_rows, 200)
    assert [tuple(r) for r in heavy.collect()] == [("hub", n // 200)] and moves.count() == 2 * n
    assert moves.where("at = 'hub'").groupBy("slice").count().agg(F.max("count")).first()[0] < 300
    dealt = moves.where("at = 'hub'").repartition(8, "at", "slice").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r[1] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[3]
    order = steps.orderBy("step").select("relation", "source", "target").collect()
    assert order == sorted(order)
    seeds = spark.createDataFrame([(1, "hub", 0), (2, "n000007", 0)], "query_id int, node_id string, position int")
    for size in (200, 10 * n):
        got = graph.expand(node_rows, edge_rows, seeds, 2, n, size).groupBy("query_id", "hops").agg(F.count("*").alias("n"), F.min("node_id").alias("low"), F.max(F.array_join("relation_path", "; ")).alias("path")).collect()
        assert sorted(map(tuple, got)) == [
            (1, 1, n, "n000000", f"CALLS -> n{n - 1:06d}"), (2, 1, 1, "hub", "CALLED_BY <- hub"), (2, 2, n - 1, "n000000", f"CALLED_BY <- hub; CALLS -> n{n - 1:06d}"),
        ]


def test_greedy_assignment(spark):
    r = random.Random(7)
    pairs = [(f"p{g}", f"s{a}", f"t{b}", round(r.random(), 2)) for g in range(12) for a in range(6) for b in range(6) if r.random() < 0.6]
    want = set()
    for g in {p[0] for p in pairs}:
        used = set()
        for _, s, t, x in sorted((p for p in pairs if p[0] == g), key=lambda p: (-p[3], p[1], p[2])):
            if s not in used and t not in used:
                used |= {s, t}
                want.add((g, s, t))
    frame = spark.createDataFrame(pairs, "pair_id string, s_chunk_id string, t_chunk_id string, similarity double")
    assert {(x.pair_id, x.s_chunk_id, x.t_chunk_id) for x in versions.greedy_match(frame).collect()} == want


def test_order_selection_and_similarity(spark):
    rows = [("a", [], "va"), ("b", ["a"], "vb"), ("c", ["a", "b"], "vc"), ("x", ["y"], "vx"), ("y", ["x"], "vy"), ("z", ["gone"], "vz")]
    frame = spark.createDataFrame([(v, p, label, f"{v}00", k) for k, (v, p, label) in enumerate(rows)], "version_id string, parents array<string>, version_label string, commit_hash string, position int")
    layers = {r.version_id: r.layer for r in versions.topological_order(frame).collect()}
    assert layers["a"] == layers["z"] == 0 and layers["b"] == 1 and layers["c"] == 2 and layers["x"] == layers["y"] == 3
    assert versions.select(frame, "vb").first().version_id == "b" and versions.select(frame, "c0").first().version_id == "c"
    with pytest.raises(ValueError):
        versions.select(frame, "nope")
    one = spark.createDataFrame([({"a": 2, "b": 1}, {"a": 1, "c": 1}, ["x", "y"], ["y"])], "a map<string,int>, b map<string,int>, x array<string>, y array<string>")
    got = one.select(similarity.counter_jaccard(F.col("a"), F.col("b")).alias("c"), similarity.jaccard(F.col("x"), F.col("y")).alias("j"), similarity.path_similarity(F.lit("A/b.py"), F.lit("a\\b.py")).alias("p")).first()
    assert (got.c, got.j, got.p) == (0.25, 0.5, 1.0)


def test_eligibility_and_chunk_files(spark, tmp_path):
    paths = [("a/b.py", 1_000_000, True), ("a/b.py", 1_000_001, False), ("A/Node_Modules/b.py", 1, False), ("x.PY", 1, True), ("build.py", 1, True), ("a/b.rs", 1, False), ("Makefile", 1, False)]
    got = spark.createDataFrame(paths, "path string, size long, want boolean").select(tree.eligible(F.col("path"), F.col("size")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    chunks = chunk_rows(spark, [("k", "a.py", "f", "function", "def f(): pass", None, [], [])])
    tables.write_chunks(chunks.select(*tree.CHUNK.names), f"{tmp_path}/json")
    back = tables.read_chunks(spark, f"{tmp_path}/json").collect()
    assert len(back) == 1 and back[0].code == "def f(): pass" and back[0].class_name is None


def test_stream_is_indexed_once(spark, tmp_path):
    folder = f"{tmp_path}/in"
    first = chunk_rows(spark, [("a", "a.py", "a", "function", "alpha beta", None, [], [])]).select(*tree.CHUNK.names)
    second = chunk_rows(spark, [("b", "b.py", "b", "function", "beta gamma", None, [], [])]).select(*tree.CHUNK.names)
    for k, batch in enumerate((first, second)):
        batch.write.mode("append").json(folder)
        for _ in range(2):  # the second run finds nothing new
            incremental.index_stream(incremental.chunk_stream(spark, folder), f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
        assert incremental.load(spark, f"{tmp_path}/index").corpus_stats.first().n == k + 1
    queries = spark.createDataFrame([(1, "gamma")], "query_id int, query string")
    assert lexical.search(incremental.load(spark, f"{tmp_path}/index"), queries).first().chunk_id == "b"


def test_stream_replaces_deletes_and_merges(spark, tmp_path):
    """The index of a stream is that of a rebuild from what was said last, whatever was merged."""
    rng = random.Random(3)
    state, folder = {}, f"{tmp_path}/in"
    for k in range(7):
        rows = [(f"c{n}", f"{n}.py", f"s{n}", "function", " ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(0, 5))), None, [], []) for n in rng.sample(range(12), 4)]
        gone = rng.sample(sorted(set(state) - {r[0] for r in rows}), 1) if k > 2 else []
        state = {c: r for c, r in (state | {r[0]: r for r in rows}).items() if c not in gone}
        chunk_rows(spark, rows).select(*tree.CHUNK.names).write.mode("append").json(folder)
        if gone:
            spark.createDataFrame([(c, True) for c in gone], "chunk_id string, deleted boolean").write.mode("append").json(folder)
        incremental.index_stream(incremental.chunk_stream(spark, folder), f"{tmp_path}/index", f"{tmp_path}/checkpoint", fanout=3).awaitTermination()
    assert incremental.segments(spark, f"{tmp_path}/index") == [(0, 2, 1), (3, 5, 1), (6, 6, 0)]
    got, want = incremental.load(spark, f"{tmp_path}/index"), lexical.build(chunk_rows(spark, list(state.values())))
    for name in ("postings", "doc_stats"):
        columns = getattr(want, name).columns
        assert sorted(map(tuple, getattr(got, name).select(columns).collect())) == sorted(map(tuple, getattr(want, name).collect())), name
    assert got.corpus_stats.first() == want.corpus_stats.first()
