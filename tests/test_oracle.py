"""Every registered query of the engine against DuckDB."""

import pytest

import oracle
from postmill.plans import catalog, replays, service, stored  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(catalog.CATALOG))
def test_same_rows(spark, sf_dir, con, name):
    f, sql = catalog.CATALOG[name]
    ours, theirs, names = oracle.difference(f(spark, sf_dir), con, sql)
    assert (ours[:3], theirs[:3], names) == ([], [], [])
