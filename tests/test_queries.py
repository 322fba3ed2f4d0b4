"""Each corpus query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from glyphora import queries
from glyphora.plans import search
from glyphora.plans.pattern import Leaf

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.Q[name](spark, SF)
    found = duck.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), columns)


def test_others_run(spark):
    for name in set(queries.Q) - set(queries.SQL):
        assert queries.Q[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["tid", "first", "second"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_adjacency_is_an_equi_join(spark):
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = shown(queries.Q["search_value_adjacent"](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown(queries._documents(spark, SF).where("value = 'the'"))


def test_texts_are_read_once_and_without_a_shuffle(spark):
    rows = queries._documents(spark, SF, edges=True)
    wanted = [(leaf, frozenset(["starts_line"])) for leaf in (Leaf("value", "the"), Leaf("value", "of"))]
    marked = search._marked(rows, wanted, queries._words, ["tid", *search._NUMBERS])
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Window" not in plan


def test_many_patterns_read_the_relation_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(search, "materialized", lambda df, name, f=search.materialized: written.append(name) or f(df, name))
    plan = queries.Q["search_leaves"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert written == ["candidates"] and plan.count("mapentries") <= 2
