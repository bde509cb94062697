"""Distinct authors from sketches that merge: kept per post and hour, comments need not be read again.

A sketch of size ``lg`` is exact up to 2 ** lg authors; beyond, its relative standard error is about 2 ** (-lg / 2), that is
0.8 percent at 14. A missing author counts as one more, as in the exact figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.functions.joins import null_safe_join
from commentlens.functions.times import hour_of

LG_SIZE = 14


def author_sketches(df: DataFrame, post: str = "post_id", author: str = "author", ts: str = "ts", lg: int = LG_SIZE) -> DataFrame:
    """One row per post and hour (null for undated comments): ``authors``, a sketch, and ``unnamed``, whether one is missing."""
    # An empty name is a name, but sketches skip empty strings: hashes go in.
    name = F.when(F.col(author).isNotNull(), F.xxhash64(author))
    return df.groupBy(post, hour_of(F.col(ts)).alias("hour")).agg(
        F.theta_sketch_agg(name, lg).alias("authors"), F.max(F.col(author).isNull()).alias("unnamed")
    )


def merged(sketches: DataFrame, by: Sequence[str] = (), lg: int = LG_SIZE) -> DataFrame:
    """Sketches of any coarser grouping; of batches, too, which may overlap or repeat."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("authors", lg).alias("authors"), F.max("unnamed").alias("unnamed"))


def _count(sketch: Column, unnamed: Column) -> Column:
    return F.theta_sketch_estimate(sketch) + F.coalesce(unnamed, F.lit(False)).cast("long")


def counted(sketches: DataFrame) -> DataFrame:
    """``unique_authors`` in place of the sketch."""
    count = _count(F.col("authors"), F.col("unnamed")).alias("unique_authors")
    return sketches.select(*[c for c in sketches.columns if c not in ("authors", "unnamed")], count)


def shared_authors(per_post: DataFrame, pairs: DataFrame, post: str = "post_id") -> DataFrame:
    """Named authors of both posts of each row of ``pairs`` (``post`` and ``other``), as ``shared_authors``.

    ``per_post`` has a sketch per post. Pairs with a post that has none are left out.
    """
    mine = per_post.select(post, F.col("authors").alias("__mine"))
    its = per_post.select(F.col(post).alias("other"), F.col("authors").alias("__its"))
    both = null_safe_join(null_safe_join(pairs.select(post, "other"), mine, [post], "inner"), its, ["other"], "inner")
    return both.select(post, "other", F.theta_sketch_estimate(F.theta_intersection("__mine", "__its")).alias("shared_authors"))
