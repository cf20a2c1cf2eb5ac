import pytest
from compare import duck, rows_of, rows_sql

from faultlens.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, data, con, name):
    names, rows = rows_of(catalogue.QUERIES[name](spark, data))
    if name in catalogue.ORACLE_SQL:
        sql_names, sql_rows = rows_sql(con, catalogue.ORACLE_SQL[name])
        assert names == sql_names
        assert rows == sql_rows
    else:
        assert names
