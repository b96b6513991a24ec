"""Every registered query: its plan, and its result against SQL or, without SQL, that it yields rows."""

import pytest

from tapeloom.catalog import all_queries
from tests.compare import connection, differences
from tests.test_plans import assert_scalable, plan

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name].run(spark, sf)
    assert_scalable(name, plan(df))
    got = df.toPandas()
    want = duck.execute(QUERIES[name].oracle()).fetchdf()
    assert differences(got, want) == ""


# Fits without SQL are run in tests/test_models.py, each once.
FITTED = {"J4_mlp", "J5_boosted_trees", "J13_benchmark_sweep", "J14_fee_pivot", "J14_accuracy_pivot"}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None and n not in FITTED])
def test_yields_rows(spark, sf, name):
    assert QUERIES[name].run(spark, sf).count() > 0
