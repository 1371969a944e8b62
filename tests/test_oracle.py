"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from conftest import SF
from oracle import differences, duck

from skerry.plans import registry


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    assert differences(spark, con, registry.QUERIES[name], registry.SQL[name], SF) == []


def test_entry_module_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_envelope(spark):
    import json

    rows = registry.QUERIES["envelope_json"](spark, SF).collect()
    got = json.loads(rows[0]["envelope"])
    assert got["mode"] == "hybrid" and got["query"] == rows[0]["qid"] and got["text"][0]["score"] >= got["text"][-1]["score"]
