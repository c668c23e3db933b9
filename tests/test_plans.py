"""What the plans must not contain, and every query against its SQL."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from pagemill.operators import language as L
from pagemill.operators.paragraphs import parse_pages
from pagemill.plans import catalog, fixtures as fx, oracle
from pagemill.sources.pages import bucket_pages

QUERIES = catalog.QUERIES
ORACLE = oracle.oracle_sql()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())


def test_html_is_read_once_for_paragraph_rows(spark, sf_dir):
    plan = physical(catalog.QUERIES["paragraph_rows"](spark, sf_dir))
    assert not [x for x in re.findall(r"ReadSchema: (.*)", plan) if "html" in x]


def test_pages_are_parsed_once_without_languages(spark, sf_dir):
    assert physical(catalog.QUERIES["paragraph_rows_disabled"](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_bucketed_pages_need_no_shuffle(spark, sf_dir):
    table = bucket_pages(parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), "bucketed_pages", 8)
    stored = L.LanguageModel(catalog.model(spark, sf_dir).profile, fx.MODEL_LANGUAGES, catalog.model(spark, sf_dir).grams)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(L.parse_with_languages(table, stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = physical(catalog.QUERIES["last_writer_wins"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan)
    plan = physical(catalog.QUERIES["depth_limit"](spark, sf_dir))
    assert "html" not in re.search(r"ReadSchema: (.*)", plan).group(1)


KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = physical(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.collect()
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in result.description}
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert dict(df.dtypes) == kinds
    order = sorted(columns)
    place = [columns.index(c) for c in order]
    assert got, "a query should give rows"
    assert sorted((tuple(r[c] for c in order) for r in got), key=repr) == sorted(
        (tuple(r[i] for i in place) for r in want), key=repr
    )
