"""The driver contract."""

import subprocess
import sys

import __spark_entry__ as entry
from vellum.plans import queries as core


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(core.QUERIES) <= set(queries)
    assert {f"p{n}_found" for n in (1, 5)} <= set(core.QUERIES)


def test_flagship(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["questions"] > 0


def test_core_stands_without_llm():
    code = "import sys; sys.modules['vellum.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(k.startswith(('p2', 'p9')) for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_nothing_imports_llm():
    out = subprocess.run(["grep", "-rnE", "vellum.llm|from vellum import llm", "vellum", "--include=*.py"], capture_output=True, text=True).stdout
    assert all(line.startswith("vellum/llm/") for line in out.splitlines())
