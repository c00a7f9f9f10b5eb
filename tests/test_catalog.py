"""Every registered query of the core against its SQL, and the plans of some."""

import __spark_entry__ as entry
import duckdb
import pytest

from marginalia.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    show = lambda v: "" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    assert len(set(got.columns)) == len(got.columns)
    if sql is not None:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["sentences", "negation_flag", "entity_offsets", "char_replace", "page_text"])
def test_narrow_plans(spark, name):
    assert "Exchange" not in _plan(catalog.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["overlap_join", "nested_segments", "fuzzy_match", "dup_shingle"])
def test_joins_have_keys(spark, name):
    plan = _plan(catalog.queries()[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_needed_columns_are_read(spark):
    plan = _plan(catalog.queries()["flagship"](spark, SF))
    assert "ReadSchema: struct<text:string,lang:string>" in plan and plan.count("Exchange") == 1
