"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_query(spark):
    assert entry.entry(spark).columns == ["query", "doc", "score", "rank"] and entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['graphloom', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name='corpus_pipeline' if name == 'corpus_pipeline' else 'graphloom.llm')
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'bm25_topk' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()), sorted(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "graphloom.llm" not in path.read_text(), path
