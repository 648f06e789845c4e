"""Driver contract + every registered query against its DuckDB twin on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from armature.plans.catalog import REGISTRY
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data missing")


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["model_id", "condition", "mean_score", "mean_diff", "sd_score", "sd_diff",
                          "se_score", "se_diff", "n_rows"]


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(sdf.columns)
    tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {f.name: tmap.get(f.dataType.simpleString()) for f in sdf.schema.fields} == dtypes
    order = [rel.columns.index(c) for c in sdf.columns]
    drows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert sorted(srows, key=key) == sorted(drows, key=key)
