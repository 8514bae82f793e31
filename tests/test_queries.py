import subprocess
import sys
from pathlib import Path

import pytest

from regista.plans import backfills, files, jobs, lookups, mechanisms, reading, records, stats  # noqa: F401
from regista.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    ours, sql = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_import_needs_no_session():
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
