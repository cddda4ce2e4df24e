"""The entry points, also without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from parcelflow.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["entity_id", "display_name"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("parcelflow.llm", "corpus_pipeline"), ("corpus_pipeline",), ("ahocorasick",), ("public_tokenizers",)])
def test_without_the_text_operators_or_what_they_need(gone):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if any(name == g or name.startswith(g + ".") for g in {gone!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from parcelflow.plans import registry
print(len(e.queries()), len(e.oracle_sql()), set(registry.queries()) <= set(e.queries()))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, sql = len(registry.queries()), len(registry.oracle_sql())
    if gone == ("corpus_pipeline",):
        from parcelflow.llm import queries

        n, sql = n + len(queries.queries()), sql + len(queries.oracle_sql())
    assert out.stdout.split() == [str(n), str(sql), "True"], out.stderr
