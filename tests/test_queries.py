"""Every registered core query against its SQL, over whole tables of the smallest size."""

import pytest

from tests.conftest import DATA, same_as_sql
from weftmark import queries, queries_core, queries_known

ALL = queries.QUERIES | queries_core.QUERIES | queries_known.QUERIES
SQL = queries.ORACLE | queries_core.ORACLE | queries_known.ORACLE
SMALL = DATA / "sf0.001"

pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    df = ALL[name](spark, str(SMALL))
    if name in SQL:
        same_as_sql(df, SQL[name], SMALL)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
