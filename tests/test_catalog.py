import os
import shutil
import subprocess
import sys

import pytest
from checks import same

import __spark_entry__ as entry
from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, entry, name, SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "count(*)", "sum(value)"] and df.count() > 0


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_llm_folders(tmp_path, left):
    """With the pipeline's file deleted as well, and with that file left behind."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *({"corpus_pipeline.py"} - set(left))))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
