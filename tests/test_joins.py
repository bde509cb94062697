import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlens.functions.joins import attach
from commentlens.functions.quantiles import exact_quantiles


@pytest.fixture
def skewed(spark):
    """A hot key, a key without a name, and many small ones."""
    return spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('k', id % 40) end as post_id",
        "id as ord",
        "cast(id % 97 as double) as x",
    )


def test_attached_figures(skewed):
    stats = skewed.groupBy("post_id").agg(F.max("x").alias("top"))
    expected = {r.post_id: r.top for r in stats.collect()}
    rows = attach(skewed, stats, ["post_id"]).select("post_id", "ord", "top").collect()
    assert len(rows) == 3000 and len({r.ord for r in rows}) == 3000
    assert all(r.top == expected[r.post_id] for r in rows)


def test_attaching_starts_no_job(spark, skewed):
    context = spark.sparkContext
    context.setJobGroup("attach", "attach")
    try:
        attach(skewed, skewed.groupBy("post_id").agg(F.max("x").alias("top")), ["post_id"])
        exact_quantiles(skewed, ["post_id"], "x", {"q1": 0.25})
        assert not context.statusTracker().getJobIdsForGroup("attach")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def sample(kind, n, seed):
    rng = random.Random(seed)
    if kind == "spread":
        return [rng.uniform(-1, 1) for _ in range(n)]
    if kind == "ties":
        return [rng.choice([0.0, 0.0, 0.0, 0.5, -0.25]) for _ in range(n)]
    return [rng.paretovariate(0.4) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 400, 20_000])
def test_quantiles_are_exact(spark, n):
    kinds = ("spread", "ties", "tail")
    data = {k: sample(k, n, n) for k in kinds}
    rows = [(k, i, x) for k in kinds for i, x in enumerate(data[k])] + [("spread", n, None)]
    df = spark.createDataFrame(rows, "g string, ord long, x double")
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99, "all": 1.0}
    # A coarse sketch, so that the brackets leave most values out.
    for r in exact_quantiles(df, ["g"], "x", wanted, accuracy=300).collect():
        assert r.n == n
        assert (r.lowest, r.highest) == (min(data[r.g]), max(data[r.g]))
        for name, q in wanted.items():
            assert r[name] == pytest.approx(np.quantile(data[r.g], q), rel=1e-12, abs=1e-12)
