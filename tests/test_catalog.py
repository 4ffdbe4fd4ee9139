import subprocess
from threading import Barrier, Thread

import pytest

from lodeseam.plans import session
from lodeseam.plans.session import Engine
from lodeseam.sources import log


@pytest.fixture
def commits(tmp_path):
    """A repository of a few commits, oldest first."""
    root = tmp_path / "code"
    root.mkdir()
    run = lambda *args: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    names = []
    for k in range(4):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    return {k}\n")
        run("add", "-A")
        run("commit", "-qm", f"c{k}")
        names.append(run("rev-parse", "HEAD"))
    return str(root), names


def test_a_number_is_written_once(spark, tmp_path):
    folder, written = f"{tmp_path}/log", []
    together = Barrier(6)

    def write(k):
        together.wait()
        written.append(log.append(spark, folder, 1, {"by": k}))

    threads = [Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(written) == [False] * 5 + [True]
    number, state = log.last(spark, folder)
    assert number == 1 and state["by"] in range(6) and log.names(spark, folder) == [f"{1:020d}.json"]
    assert log.last(spark, f"{tmp_path}/none") == (0, None)


def test_two_writers_of_one_label(spark, tmp_path, commits, monkeypatch):
    """Both have read the catalog before either writes: one label stays, other versions of both do."""
    path, names = commits
    engine, together, failed = Engine(spark, f"{tmp_path}/home"), Barrier(2), []
    commit = Engine._commit_versions

    def late(self, base, rows):
        together.wait()
        commit(self, base, rows)

    monkeypatch.setattr(Engine, "_commit_versions", late)

    def index(name):
        try:
            engine.index_versions(path, {"same": name}, with_semantic=False)
        except ValueError as error:
            failed.append((name, str(error)))

    threads = [Thread(target=index, args=(n,)) for n in names[:2]]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(failed) == 1 and "same" in failed[0][1]
    rows = engine.versions().collect()
    assert [(r.version_label, r.version_id) for r in rows] == [("same", names[1] if failed[0][0] == names[0] else names[0])]

    monkeypatch.setattr(Engine, "_commit_versions", commit)
    monkeypatch.setattr(session, "FOLDERS", 1)  # rows of earlier calls are written together
    engine.index_versions(path, {"third": names[2], "fourth": names[3]}, with_semantic=False)
    assert [(r.version_label, r.position) for r in engine.versions().orderBy("position").collect()] == [("same", 0), ("third", 1), ("fourth", 2)]
    assert len(log.last(spark, f"{engine.home}/{engine.repositories().first().repository_id}/versions/log")[1]["rows"]) == 1
    assert engine.repositories().first().versions and engine.search(["f3"], version="fourth", top_k=1).count() == 1
