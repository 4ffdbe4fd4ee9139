import subprocess

import pytest
from lodeseam.plans.session import Engine, NotFound
from lodeseam.sources import tree

FILES = {
    "auth/tokens.py": '''import hashlib
from . import base


def check_token(token):
    """Verify a login token."""
    return hashlib.sha256(token.encode()).hexdigest() == lookup_digest(token)


class Guard(base.Door):
    """Protects routes."""

    def allow(self, request):
        return check_token(request.token)
''',
    "auth/base.py": "class Door:\n    pass\n",
    "auth/__init__.py": "",
    "media/images.py": 'from auth.tokens import check_token\n\n\ndef resize_picture(picture, width):\n    """Shrink an uploaded image."""\n    return scale(picture, width)\n\n\ndef scale(picture, width):\n    return picture\n',
    "broken.py": "def (:\n",
    "node_modules/x.py": "def hidden():\n    pass\n",
    "notes.txt": "nothing",
    "app.js": "function f() {}",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "latin.py").write_bytes(b"x = '\xff'")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("home")))
    made.warnings = made.index_repository(repo, "demo")
    return made


def test_chunks_and_warnings(spark, repo, engine):
    rows = {r.symbol_name: r for r in spark.read.parquet(f"{engine.home}/{tree.repository_id(repo)}/chunks").collect()}
    assert set(rows) == {"check_token", "Guard", "Guard.allow", "Door", "resize_picture", "scale"}
    assert rows["check_token"].calls == ["hashlib.sha256", "hexdigest", "lookup_digest", "token.encode"]
    assert rows["check_token"].imports == [".", "hashlib"]
    assert (rows["Guard.allow"].symbol_type, rows["Guard.allow"].class_name, rows["Guard.allow"].parent_symbol) == ("method", "Guard", "Guard")
    assert len(engine.warnings) == 2 and any("syntax error at line 1" in w for w in engine.warnings)
    assert engine.repositories().first().available_methods == ["bm25", "semantic", "hybrid", "reranked", "multi_pass"]


def test_graph(spark, repo, engine):
    edges = {(r.source.split("::")[1], r.target.split("::")[1]): r.relations for r in spark.read.parquet(f"{engine.home}/{tree.repository_id(repo)}/graph/edges").collect()}
    ids = {r.symbol_name: r.chunk_id for r in spark.read.parquet(f"{engine.home}/{tree.repository_id(repo)}/chunks").collect()}
    assert edges[ids["Guard"], ids["Guard.allow"]] == ["CONTAINS"]
    assert "CALLS" in edges[ids["Guard.allow"], ids["check_token"]]
    assert edges[ids["Guard"], ids["Door"]][-1] == "INHERITS"
    assert edges["media/images.py", "auth/tokens.py"] == ["IMPORTS"]
    assert ("auth/tokens.py", "auth/__init__.py") not in edges  # a file without chunks is not a node
    assert edges[ids["resize_picture"], ids["scale"]] == ["CALLS", "REFERENCES"]
    near = engine.graph(ids["Guard.allow"]).collect()
    assert {(r.direction, r.relation, r.symbol_name) for r in near} == {("incoming", "CALLS,REFERENCES", "Guard") if "REFERENCES" in edges.get((ids["Guard"], ids["Guard.allow"]), []) else ("incoming", "CONTAINS", "Guard"), ("outgoing", "CALLS", "check_token")}
    assert {r.chunk and r.chunk.symbol_name for r in near} == {"Guard", "check_token"}
    with pytest.raises(NotFound):
        engine.graph("missing")
    totals = {(r.what, r.name): r.total for r in engine.graph_summary().collect()}
    assert totals["kind", "file"] == 3 and totals["relation", "CONTAINS"] == 6


def test_graph_is_derived_where_none_is_stored(spark, repo, tmp_path):
    plain = Engine(spark, str(tmp_path))
    plain.index_repository(repo, "plain", with_semantic=False, with_graph=False)
    assert plain.repositories().first().available_methods == ["bm25"]
    ids = {r.symbol_name: r.chunk_id for r in spark.read.parquet(f"{plain.home}/{tree.repository_id(repo)}/chunks").collect()}
    assert {r.symbol_name for r in plain.graph(ids["resize_picture"]).collect()} == {None, "scale"}


def test_report(engine):
    found, report = engine.search_report(["verify login token", "zzzunknown qqq"], method="multi_pass", top_k=2, seed_k=1, max_graph_hops=1)
    rows = {r.query_id: r for r in report.collect()}
    assert rows[0].method == "multi_pass" and rows[0].seeds == 1 and rows[0].pass5 == rows[0].total_candidates >= rows[0].pass1 and rows[0].latency_ms > 0
    _, plain = engine.search_report(["verify login token", "zzzunknown qqq"], method="bm25", top_k=2)
    assert {r.query_id: r.total_candidates for r in plain.collect()} == {0: 2, 1: 0}


def test_names_before_contents(repo):
    assert tree.is_eligible("a/b.PY", 1_000_000) and not tree.is_eligible("a/b.py", 1_000_001)
    assert not tree.is_eligible("a/Node_Modules/b.py", 1) and not tree.is_eligible("a/b.txt", 1) and tree.is_eligible("build.py", 1)


def test_outline():
    import ast

    code = """
import os.path as p
from ..pkg import y
if True:
    def hidden():
        from z import q
        inside()
@deco(arg())
class Outer(base.Door, Other):
    def method(self):
        def helper():
            a.b(c)().d()
        class Local:
            def run(self): return (lambda: go())()
    class Inner:
        x = make()
async def free(a, /, b, *c, d, **e): await b.c.d(a)
"""
    found, imported = tree.outline(ast.parse(code))
    got = {d.name: (d.kind, d.class_name, d.around and d.around.name, sorted(d.calls - {""})) for d in found}
    assert imported == {"os.path", "..pkg", "z"}
    assert got == {
        "Outer": ("class", None, None, ["a.b", "arg", "d", "deco", "go", "make"]),
        "Outer.method": ("method", "Outer", "Outer", ["a.b", "d", "go"]),
        "Outer.helper": ("method", "Outer", "Outer.method", ["a.b", "d"]),
        "Outer.method.Local": ("class", "Outer", "Outer.method", ["go"]),
        "Local.run": ("method", "Local", "Outer.method.Local", ["go"]),
        "Outer.Inner": ("class", "Outer", "Outer", ["make"]),
        "free": ("function", None, None, ["b.c.d"]),
    }
    assert tree.spelled(ast.parse("f(x).a.b").body[0].value) == "a.b" and tree.spelled(ast.parse("x[0]").body[0].value) == ""


def test_malformed_lines_are_named(spark, tmp_path):
    from lodeseam.sources import tables

    (tmp_path / "c.json").write_text('{"chunk_id": "a"}\n\n{"chunk_id": "b"\n')
    with pytest.raises(ValueError, match=r"c\.json:3: "):
        tables.read_chunks(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text('{"chunk_id": "a"}\n\n{"chunk_id": "b"}\n')
    assert [r.chunk_id for r in tables.read_chunks(spark, str(tmp_path / "d.json")).collect()] == ["a", "b"]


@pytest.mark.parametrize("method", ["bm25", "semantic", "hybrid", "reranked", "multi_pass"])
def test_search(engine, method):
    found = engine.search(["resize the uploaded image", "verify login token"], method=method, top_k=3, seed_k=1, max_graph_hops=1).collect()
    best = {r.query_id: r.symbol_name for r in found if r["rank"] == 1}
    assert best[0] == "resize_picture" and best[1] in ("check_token", "Guard.allow", "Guard")


def test_limits_and_evaluation(spark, repo, engine):
    with pytest.raises(ValueError):
        engine.search(["  "])
    with pytest.raises(ValueError):
        engine.search(["x"], top_k=101)
    with pytest.raises(NotFound):
        engine.search(["x"], repository="other")
    ids = {r.symbol_name: r.chunk_id for r in spark.read.parquet(f"{engine.home}/{tree.repository_id(repo)}/chunks").collect()}
    out = engine.evaluate([("shrink an uploaded image", {ids["resize_picture"]: 3, ids["scale"]: 0})], method="bm25").first()
    assert out.ndcg == 1.0 and out.rr == 1.0 and out.method == "bm25"
    both = engine.evaluate([("shrink an uploaded image", {ids["resize_picture"]: 3}), ("verify a token", {ids["check_token"]: 1})], method=["bm25", "hybrid"])
    total = engine.evaluation_summary(both).first()
    assert (total.cases, total.method) == (2, "mixed") and total.mrr == 1.0
    assert engine.search(["zzzunknown"], method="bm25").count() == 0
    with pytest.raises(PermissionError):
        Engine(spark, engine.home, read_only=True).index_repository(repo)


def test_versions(spark, tmp_path, tmp_path_factory):
    root = tmp_path_factory.mktemp("git")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "a.py").write_text("def load_user(name):\n    return find(name)\n\n\ndef other():\n    return 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("tag", "v1")
    (root / "a.py").write_text("def load_account(name):\n    return find(name)\n\n\ndef other():\n    return 1\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    run("tag", "v2")
    engine = Engine(spark, str(tmp_path))
    versions = engine.index_versions(str(root), {"v1": "v1", "v2": "v2"}).orderBy("position").collect()
    assert versions[1].parents == [versions[0].version_id] and versions[1].changed_paths == ["a.py"]
    assert {r.version_label for r in engine.search_versions(["load name"]).collect()} == {"v1", "v2"}
    assert {r.version_label for r in engine.search_versions(["load name"], version="v2").collect()} == {"v2"}
    with pytest.raises(ValueError):
        engine.search_versions(["x"], version="v9")
    tracks = engine.evolve("load find name", min_similarity=0.3).collect()
    changes = {tuple(i.change for i in t["items"]) for t in tracks}
    assert ("first_observed", "likely_renamed_or_moved") in changes
    # what is there stays, and a commit is indexed once
    (root / "b.py").write_text("class Store:\n    def save(self, row):\n        return row\n")
    run("add", "-A")
    run("commit", "-qm", "three")
    again = engine.index_versions(str(root), {"HEAD": None, "other": "v1"}).orderBy("position").collect()
    assert [r.version_label for r in again] == ["v1", "v2", "HEAD"] and [r.number_of_files for r in again] == [1, 1, 2] and [r.number_of_chunks for r in again] == [2, 2, 4]
    (root / "c.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "four")
    with pytest.raises(ValueError, match="another version"):
        engine.index_versions(str(root), {"v1": "HEAD"})
    assert {r.retrieval_mode for r in engine.search_versions(["load name"]).collect()} == {"hybrid"}
    assert {r.retrieval_mode for r in engine.search_versions(["load name"], mode="bm25").collect()} == {"lexical"}
    assert {(r.version_label, r["rank"]) for r in engine.search(["load account"], version="v2", top_k=1).collect()} == {("v2", 1)}
    assert engine.search(["save row store"], version="all", top_k=1).first().symbol_name.startswith("Store")
    with pytest.raises(ValueError):
        engine.search(["x"], version="v2", method="multi_pass")
    best = {r.s_symbol_name: r for r in engine.compare_versions("v1", "v2", matches_per_chunk=1).collect()}
    assert best["load_user"].t_symbol_name == "load_account" and best["load_user"].change == "likely_renamed_or_moved" and best["other"].change == "likely_unchanged"
    assert best["load_user"].components["git"] == 0.75 and best["load_user"].similarity > 0.5
    with pytest.raises(ValueError, match="different"):
        engine.compare_versions("v1", "v1")
