"""Every registered query against its SQL, over whole small tables."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from inkfold.plans.oracle import ORACLE
from inkfold.plans.queries import QUERIES
from tests.compare import differences, tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, check=True, text=True).stdout) > 40


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, DATA), con, ORACLE[name]) == []
