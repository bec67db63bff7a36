import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    from quern import catalog

    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["rank", "doc_id", "score"] and found.count() > 0


def test_the_search_engine_needs_nothing_of_llm():
    code = (
        "import sys, quern.catalog, quern.streaming.incremental, quern.operators.facets\n"
        "assert not [m for m in sys.modules if m.startswith('quern.llm')]\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quern.llm'):\n"
        "            raise ModuleNotFoundError('gone', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert set(e.queries()) == set(quern.catalog.QUERIES) and set(e.oracle_sql()) == set(quern.catalog.ORACLE_SQL)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
