import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_works_without_the_text_subpackage(tmp_path):
    for path in ROOT.glob("lodeseam/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            to = tmp_path / path.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_batch' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
