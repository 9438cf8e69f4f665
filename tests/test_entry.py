import os

import duckdb
import pytest

import __spark_entry__ as entries
from deckloom.plans.queries import QUERIES
from deckloom.plans.sql import ORACLES


def test_entry(spark):
    assert entries.entry(spark).columns == ["deck_id", "markdown"]
    assert set(ORACLES) <= set(QUERIES) <= set(entries.queries()) and set(entries.oracle_sql()) <= set(entries.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in columns], strict=True)))
    assert rows(got) == rows(want)


def plan(frame, capsys):
    frame.explain("formatted")
    return capsys.readouterr().out


def test_plans_read_what_they_need(spark, sf_dir, capsys):
    text = plan(QUERIES["assemble_document_decks"](spark, sf_dir), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text and "n_chars" not in text
    for name in sorted(set(QUERIES) - {"describe_once", "reconstruct_routed", "deck_source", "convert_decks", "convert_deck_tables", "pixel_features", "convert_rich_decks", "rich_shapes", "validate_structure", "validate_plain"}):
        text = plan(QUERIES[name](spark, sf_dir), capsys)
        assert not any(x in text for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")), name
