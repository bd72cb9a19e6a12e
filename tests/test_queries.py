"""Every query with SQL equals DuckDB's result; the others run, and are held against plain Python elsewhere."""

import os

import pytest

from quillstone.plans import registry
from tests.oracle import compare

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        compare(df, sql, SF)
    else:
        df.write.format("noop").mode("overwrite").save()  # every column is computed, which count() would not do
