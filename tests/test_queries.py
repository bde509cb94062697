"""Every query against its SQL on the small tables, and the shape of every plan."""

import os
import re

import pytest

import __spark_entry__ as entry
from commentlens.plans.oracles import ORACLES
from commentlens.plans.queries import REGISTRY as QUERIES

SF = os.environ.get("COMMENTLENS_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables at hand")
# Fitting a model takes many passes over the data; what is checked for it is elsewhere.
FITTED = {"text_model_report", "text_model_stance"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{file}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_query_but_the_fitted_ones_has_sql():
    assert set(QUERIES) - set(ORACLES) == FITTED
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert got == canonical(names, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("hourly_counts", "ts:timestamp_ntz,event_type:string"),
        ("distinct_authors", "user_id:bigint"),
        ("confusion", "doc_id:bigint"),
    ],
)
def test_scans_read_only_what_is_needed(spark, name, columns):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{columns}>" in plan


@pytest.mark.parametrize("name", ["post_metrics", "impact_top", "gold_labels", "missing_validation"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)
