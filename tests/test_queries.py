"""Every registered query against its SQL on the smallest data set."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from orderloom.registry import areas

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EVERY = entry.queries()
QUERIES = {name: EVERY[name] for area in areas() for name in area.queries()}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection():
    return connect(DIRECTORY)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(EVERY)
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, connection, name):
    found = differences(spark, connection, DIRECTORY, name, QUERIES[name], SQL[name])
    assert [f for f in found if f != "no rows"] == []


def test_names_and_sql_need_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
