import importlib
import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_text_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("crestline.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    root = importlib.import_module("pathlib").Path(entry.__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
