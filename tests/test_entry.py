import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_works_without_the_training_operators(tmp_path):
    shutil.copytree(f"{REPO}/vesperline", tmp_path / "vesperline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50 and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}).returncode == 0


def test_a_missing_library_takes_only_the_training_operators_away(tmp_path):
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO).returncode == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["tasks_flat_list", "occurrences_monthly", "workday_bracket"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from vesperline.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()[name](spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(columns).collect())
