"""Registered queries against their SQL in DuckDB, as multisets of rows."""

from collections import Counter

import duckdb
import pytest

from plumbline.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, DIR)
    expected = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    mine = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert mine == Counter(expected.fetchall()) and mine


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", ["normalize_diagram", "normalize_layers", "normalize_padding", "validate_architecture", "validate_lora_ts"])
def test_texts_are_parsed_once(spark, name):
    plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") < 20


def test_stream_equals_batch(spark):
    columns = ["node_id", "component_id", "param_pos", "code", "got", "message"]
    stream, batch = (catalog.queries()[n](spark, DIR).select(*columns) for n in ("stream_validate", "validate_lora"))
    assert Counter(map(tuple, stream.collect())) == Counter(map(tuple, batch.collect()))


def test_validation_does_not_shuffle(spark):
    plan = catalog.validate_dropout(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    assert plan.count("from_json(MapType(StringType,VariantType") == 1  # each config is parsed once
