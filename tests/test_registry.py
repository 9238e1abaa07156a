"""Every registered query against its SQL in DuckDB, on whole tables."""

import re

import pytest

import __spark_entry__ as entry
from oracle import check, connect

from tidemark.plans.catalog import QUERIES, SQL

ROWS_ONLY = {"logistic_fit_predict", "chrono_train_test", "walk_forward_expanding"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    problem, rows, _ = check(spark, duck, name, QUERIES[name], SQL.get(name), sf_dir)
    assert not problem
    assert rows >= 0


def test_only_inexpressible_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


def test_names_are_plain():
    assert not [n for n in QUERIES if re.match(r"(op\d+_|.*pipeline)", n)]


def test_entry_serves_the_catalog():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
