"""Every registered query on the smallest tables: against its SQL, or for rows where SQL can't say it."""

import pytest

from checks import load_all
from checks.compare import compare, oracle

SF = "/root/testdata/sf0.001"
REG = load_all()
#: Queries whose right answer has no rows on these tables, as their SQL has none either.
NO_ROWS: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(REG.ORACLE))
def test_query(spark, con, name):
    note = compare(REG.QUERIES[name](spark, SF), con, REG.ORACLE[name])
    assert note == ("EMPTY" if name in NO_ROWS else ""), note


@pytest.mark.parametrize("name", sorted(set(REG.QUERIES) - set(REG.ORACLE)))
def test_query_without_sql(spark, name):
    assert not REG.QUERIES[name](spark, SF).isEmpty()


def test_every_query_is_registered_once():
    assert set(REG.ORACLE) <= set(REG.QUERIES)
