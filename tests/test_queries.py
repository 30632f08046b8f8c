"""Every core query against its SQL on the smallest tables."""

import pytest
from conftest import duck, rows

from siltworks.queries import registry

Q, S = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, small, name):
    got = Q[name](spark, small)
    pdf = got.toPandas()
    if name in S:
        assert rows(pdf) == duck(small, S[name])
    else:
        assert list(pdf.columns)


def test_every_sql_has_a_query():
    assert set(S) <= set(Q)
