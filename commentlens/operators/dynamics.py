"""How fast and how long a post is discussed.

Input: one row per comment with ``post_id``, ``ord`` (any value that grows with the
row's position in its post), ``author``, ``reactions``, ``sub_comments`` and ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens.functions.joins import attach, null_safe_join
from commentlens.functions.times import days_between, hour_of, hours_between, minutes_between

OVERALL = "aggregated"


def _rate(views: Column, days: Column, compat: bool) -> Column:
    """Views per day; at zero span NULL, or infinite with ``compat``."""
    rate = F.try_divide(views.cast("double"), days)
    if compat:
        rate = F.when((days == 0) & (views > 0), F.lit(float("inf"))).otherwise(rate)
    return rate


def _distinct_authors(author: str, approx: float | None) -> Column:
    """Distinct authors, a missing author counting as one more."""
    named = F.count_distinct(author) if approx is None else F.approx_count_distinct(author, approx)
    return (named + F.max(F.col(author).isNull().cast("int"))).alias("unique_authors")


def _second_event(df: DataFrame, post: str, ts: str) -> DataFrame:
    """Time of every post's second event, simultaneous events counted separately.

    The rank filter is applied before the shuffle as well: each task sends two rows per post.
    """
    nth = F.row_number().over(Window.partitionBy(post).orderBy(ts))
    return (
        df.where(F.col(ts).isNotNull())
        .select(post, ts)
        .withColumn("nth", nth)
        .where("nth <= 2")
        .groupBy(post)
        .agg(F.max(F.when(F.col("nth") == 2, F.col(ts))).alias("second_event"))
    )


def post_metrics(
    df: DataFrame,
    post: str = "post_id",
    ord: str = "ord",
    author: str = "author",
    ts: str = "ts",
    compat: bool = False,
    approx_authors: float | None = None,
) -> DataFrame:
    """One row per post: life span, spread times, views, distinct authors, growth rate.

    Views are the reactions and sub-comments of the post's first row. Undated comments
    do not count as events; with ``compat`` a single one voids the longest spread time.
    ``approx_authors`` is a relative error for sketched author counts.
    """
    facts = df.groupBy(post).agg(
        F.min(ts).alias("first_event"),
        F.max(ts).alias("last_event"),
        F.min_by(F.col("reactions") + F.col("sub_comments"), F.col(ord)).alias("views"),
        _distinct_authors(author, approx_authors),
        F.count_if(F.col(ts).isNull()).alias("undated"),
    )
    first, last = F.col("first_event"), F.col("last_event")
    longest = minutes_between(first, last)
    if compat:
        longest = F.when(F.col("undated") == 0, longest)
    return (
        null_safe_join(facts, _second_event(df, post, ts), [post], "left")
        .withColumn("cls_days", days_between(first, last))
        .select(
            post,
            "first_event",
            "last_event",
            minutes_between(first, F.col("second_event")).alias("min_spread_time_minutes"),
            longest.alias("max_spread_time_minutes"),
            "views",
            "unique_authors",
            "cls_days",
            _rate(F.col("views"), F.col("cls_days"), compat).alias("growth_rate"),
        )
    )


def overall_metrics(
    df: DataFrame,
    post: str = "post_id",
    author: str = "author",
    compat: bool = False,
    last_post: str | None = None,
    **columns,
) -> DataFrame:
    """The same figures over all posts, as one row.

    An author active in several posts counts once. With ``compat`` views count twice and
    the shortest spread time is that of ``last_post`` instead of the smallest.
    """
    if compat and last_post is None:
        raise ValueError("compat needs last_post: the post whose spread time stands for all")
    posts = post_metrics(df, post=post, author=author, compat=compat, **columns)
    approx = columns.get("approx_authors")
    authors = df.agg(_distinct_authors(author, approx)).scalar()
    shortest, longest = F.col("min_spread_time_minutes"), F.col("max_spread_time_minutes")
    return (
        posts.agg(
            F.min("first_event").alias("first_event"),
            F.max("last_event").alias("last_event"),
            F.max(F.when(F.col(post) == last_post, shortest)).alias("min_spread_time_minutes")
            if compat
            else F.min(shortest).alias("min_spread_time_minutes"),
            F.max(longest).alias("max_spread_time_minutes"),
            (F.sum("views") * (2 if compat else 1)).alias("views"),
        )
        .withColumn("unique_authors", authors)
        .withColumn("cls_days", days_between(F.col("first_event"), F.col("last_event")))
        .withColumn("growth_rate", _rate(F.col("views"), F.col("cls_days"), compat))
    )


def metrics_report(df: DataFrame, post: str = "post_id", **options) -> DataFrame:
    """One row per post and one for all of them."""
    per_post = {k: v for k, v in options.items() if k != "last_post"}
    overall = overall_metrics(df, post=post, **options).withColumn(post, F.lit(OVERALL))
    return post_metrics(df, post=post, **per_post).unionByName(overall)


def spread_offset(df: DataFrame, post: str = "post_id", ord: str = "ord", ts: str = "ts") -> DataFrame:
    """Every dated comment with the minutes since its post's first event."""
    dated = df.where(F.col(ts).isNotNull())
    starts = dated.groupBy(post).agg(F.min(ts).alias("first_event"))
    return (
        attach(dated, starts, [post])
        .withColumn("offset_minutes", minutes_between(F.col("first_event"), F.col(ts)))
        .drop("first_event")
    )


def event_timeline(df: DataFrame, post: str = "post_id", ord: str = "ord", ts: str = "ts") -> DataFrame:
    """Dated comments of every post in order of time."""
    return spread_offset(df, post, ord, ts).orderBy(post, ts, ord)


def hourly_counts(df: DataFrame, post: str = "post_id", ts: str = "ts") -> DataFrame:
    """Comments per post and hour; hours without comments have no row."""
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(post, hour_of(F.col(ts)).alias("hour"))
        .agg(F.count("*").alias("n"))
    )


def hourly_curve(hourly: DataFrame, post: str = "post_id") -> DataFrame:
    """Hourly counts on a common scale: hours since the first one, share of the busiest one."""
    whole_post = Window.partitionBy(post)
    return hourly.select(
        post,
        "hour",
        hours_between(F.min("hour").over(whole_post), F.col("hour")).alias("hours_since_first"),
        (F.col("n") / F.max("n").over(whole_post)).alias("relative_n"),
    )
