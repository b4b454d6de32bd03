"""The registered queries against their oracles, and the driver contract."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import difference, duck

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, folder, connection, name):
    assert difference(entry.queries()[name](spark, folder), connection, ORACLES[name]) is None


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["segment", "expected_annual_loss", "avg_churn_probability"] and rows.count() == 4


def test_names():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("left", [[], ["churnlake/llm/__pycache__"], ["corpus_pipeline.py"]])
def test_runs_without_the_corpus_operators(tmp_path, left):
    """A copy without the corpus folders, with nothing or with leftovers of them, still imports and answers."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/churnlake", tmp_path / "churnlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    for name in left:
        if name.endswith(".py"):
            (tmp_path / name).write_text("from churnlake.llm import packing\n")
        else:
            os.makedirs(tmp_path / name)
    code = ("import __spark_entry__ as e; from churnlake.session import build_session\n"
            "assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())\n"
            "assert set(e.oracle_sql()) <= set(e.queries())\n"
            "assert e.entry(build_session('alone', 'local[2]', 2)).count() == 4")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
