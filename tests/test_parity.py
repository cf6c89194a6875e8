"""Every registered query with SQL against that SQL."""

import pytest

from quadrille.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_parity(parity, name):
    parity(QUERIES[name], ORACLE_SQL[name])


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
