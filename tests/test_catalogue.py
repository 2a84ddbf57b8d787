"""Every query of the catalogue with SQL gives the same rows as the SQL; the others run and keep their promises."""

import pytest
from conftest import same

from driftline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    same(catalogue.queries()[name](spark, sf).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_twice_alike(spark, sf, name):
    q = catalogue.queries()[name]
    a, b = q(spark, sf).toPandas(), q(spark, sf).toPandas()
    assert len(a)
    same(a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
