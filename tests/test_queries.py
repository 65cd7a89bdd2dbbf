"""Every registered query of the reference operators: against its SQL, or for rows and a stable schema."""

import pytest

from speechtab.plans import queries as registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same):
    same(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(name, spark, sf_dir):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns and df.limit(1).count() == 1
