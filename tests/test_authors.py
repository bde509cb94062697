"""Sketches of authors against exact counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from commentlens.operators import authors

DAY = datetime(2024, 5, 1)


def test_sketches_merge_to_exact_counts(spark):
    """Null posts, missing and empty authors, undated comments, overlapping batches."""
    rows = [(p, a, DAY.replace(hour=h) if h else None) for p in ("a", "b", None) for a in ("x", "", None, p) for h in (0, 3, 4)]
    rows += [("c", None, DAY), ("d", "x", None), ("d", "q", DAY)]
    df = spark.createDataFrame(rows, "post_id string, author string, ts timestamp")
    want = {r[0]: r[1] for r in df.groupBy("post_id").agg(F.count_distinct("author") + F.max(F.col("author").isNull().cast("int"))).collect()}
    halves = authors.author_sketches(df.where("hour(ts) = 3 OR ts IS NULL")).unionByName(authors.author_sketches(df))
    got = authors.counted(authors.merged(halves, ["post_id"]))
    assert {r.post_id: r.unique_authors for r in got.collect()} == want
    assert authors.counted(authors.merged(halves)).collect()[0].unique_authors == 6
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), (None, "d"), ("a", "none")], "post_id string, other string")
    shared = authors.shared_authors(authors.merged(halves, ["post_id"]), pairs).collect()
    assert {(r.post_id, r.other): r.shared_authors for r in shared} == {("a", "b"): 2, ("a", "c"): 0, (None, "d"): 1}
    assert authors.author_sketches(df.limit(0)).count() == 0


def test_error_beyond_the_size(spark):
    """100,000 authors in 50 hours in sketches that are exact up to 16,384: within three standard errors."""
    df = spark.range(200_000).select(
        F.lit("p").alias("post_id"), (F.col("id") % 100_000).cast("string").alias("author"),
        F.timestamp_seconds(F.col("id") % 50 * 3600).alias("ts"),
    )
    n = authors.counted(authors.merged(authors.author_sketches(df), ["post_id"])).collect()[0].unique_authors
    assert abs(n / 100_000 - 1) < 3 * 2 ** (-authors.LG_SIZE / 2)
