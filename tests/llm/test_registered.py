"""The registered queries, the pipeline, and the optional import."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_extendible_sharding", "op10_quality_rules", "op12_toivonen_phrases", "op13_filter_audit"])
def test_oracles(spark, name):
    import __spark_entry__ as entry
    from compare import difference, duck
    assert difference(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name]) is None


def test_pipeline(spark):
    import corpus_pipeline
    from churnlake.llm.tables import kept_table, read_table
    docs = read_table(spark, FOLDER, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept_table(stage(spark, docs, FOLDER), "t")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    empty = read_table(spark, FOLDER, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
        assert empty.count() == 0


def test_nothing_else_imports_the_subpackage():
    code = ("import sys; sys.modules['churnlake.llm'] = None; sys.path.insert(0, %r); import pkgutil, importlib, churnlake\n"
            "for m in pkgutil.walk_packages(churnlake.__path__, 'churnlake.'):\n"
            "    if not m.name.startswith('churnlake.llm'): importlib.import_module(m.name)") % ROOT
    assert subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True).returncode == 0
