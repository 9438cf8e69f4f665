import os

import duckdb
import pytest

from deckloom.llm.queries import QUERIES
from deckloom.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{sf_dir}/{table}'")
    got, want = QUERIES[name](spark, sf_dir).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in columns], strict=True)))
    assert rows(got) == rows(want)
