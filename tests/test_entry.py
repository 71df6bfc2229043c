"""The driver's contract, with and without the training-text subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from frameloom.plans import registry

ROOT = Path(__file__).parent.parent


def test_queries_and_sql_have_the_same_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(registry.QUERIES) <= set(queries) and set(sql) <= set(queries) and registry.FLAGSHIP in queries


def test_all_else_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['frameloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.QUERIES), len(e.oracle_sql()) > 30)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert out.stdout.split()[-2:] == ["True", "True"]


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("frameloom/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "frameloom.llm" not in path.read_text()
