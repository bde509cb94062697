"""Row positions for tables that come without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentlens.functions.joins import null_safe_join

#: Ranges of keys, holding about equally many rows, that are ranked apart from each other.
BLOCKS = 256


def with_ord(df: DataFrame, key: str, post: str = "post_id", blocks: int = BLOCKS) -> DataFrame:
    """Add ``ord``: the row's position in its post by ``key``, a unique whole number, from 0.

    Rows are ranked within blocks of neighbouring keys, cut at quantiles of the keys that are there: sparse or
    time-shaped keys make no more blocks than dense ones, and even a post with most of all rows is ranked by many
    tasks. What precedes a block is a running total over at most ``blocks`` rows per post.
    """
    shares = [k / blocks for k in range(1, blocks)]
    cuts = df.agg(F.percentile_approx(key, shares, 10 * blocks)).scalar()
    block = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<bigint>")), lambda c: c < F.col(key)))
    blocked = df.withColumn("__cuts", cuts).withColumn("__block", block).drop("__cuts")
    earlier = Window.partitionBy(post).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        blocked.groupBy(post, "__block")
        .agg(F.count("*").alias("__rows"))
        .select(post, "__block", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    )
    within = F.row_number().over(Window.partitionBy(post, "__block").orderBy(key)) - 1
    return (
        null_safe_join(blocked.withColumn("ord", within), before, [post, "__block"], "left")
        .withColumn("ord", F.col("ord") + F.col("__before"))
        .drop("__block", "__before")
    )
