"""Every registered query of the training-data operators with SQL against that SQL."""

import pytest

from quadrille.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_parity(parity, name):
    parity(QUERIES[name], ORACLE_SQL[name])
