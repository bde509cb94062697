"""Signed impact of comments: does the thread strengthen or weaken the story, and when?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.functions.joins import attach
from commentlens.functions.labels import direction, encode_label
from commentlens.functions.quantiles import exact_quantiles

INPUTS = ("content", "stance", "reactions", "sub_comments", "comment_at")


def impact_scores(
    df: DataFrame,
    w_reactions: float = C.REACTIONS_WEIGHT,
    w_sub: float = C.SUB_COMMENTS_WEIGHT,
    sarcasm_weight: float = C.SARCASM_WEIGHT,
    polarity: Mapping[str, int] | None = None,
    compat: bool = False,
    post: str = "post_id",
    ord: str = "ord",
    ts: str = "ts",
) -> DataFrame:
    """Add normalised counts, ``polarity``, ``impact``, ``adjusted_impact`` and ``date``.

    Counts are relative to the post's largest. A stance without a polarity leaves the
    adjusted impact NULL; ``compat`` knows only the short stance names, which full labels
    never equal.
    """
    if polarity is None:
        polarity = C.POLARITY_SHORT_KEYS if compat else C.POLARITY
    largest = df.groupBy(post).agg(
        F.max("reactions").alias("__max_reactions"),
        F.max("sub_comments").alias("__max_sub"),
    )
    epsilon = C.NORMALISATION_EPSILON
    return (
        attach(df, largest, [post])
        .withColumn("reactions_norm", F.col("reactions") / (F.col("__max_reactions") + epsilon))
        .withColumn("sub_comments_norm", F.col("sub_comments") / (F.col("__max_sub") + epsilon))
        .drop("__max_reactions", "__max_sub")
        .withColumn("polarity", encode_label(F.col("stance"), polarity))
        .withColumn("impact", w_reactions * F.col("reactions_norm") + w_sub * F.col("sub_comments_norm"))
        .withColumn(
            "adjusted_impact",
            # Adding zero turns a negative zero into a plain one.
            F.lit(0.0)
            + F.col("impact") * F.col("polarity") * (1 - F.col("sarcasm_score") * sarcasm_weight),
        )
        .withColumn("date", F.to_date(ts))
    )


def _total():
    return F.coalesce(F.sum("adjusted_impact"), F.lit(0.0))


def daily_impact(df: DataFrame, post: str = "post_id") -> DataFrame:
    """Adjusted impact per post and day, and its running total; undated comments left out."""
    days = (
        df.where(F.col("date").isNotNull())
        .groupBy(post, "date")
        .agg(_total().alias("adjusted_impact"))
    )
    so_far = Window.partitionBy(post).orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return days.withColumn("cumulative_impact", F.sum("adjusted_impact").over(so_far))


def impact_by_stance(df: DataFrame, by: Sequence[str] = ("post_id",)) -> DataFrame:
    return (
        df.where(F.col("stance").isNotNull())
        .groupBy(*by, "stance")
        .agg(F.avg("adjusted_impact").alias("mean_adjusted_impact"))
    )


def impact_total(df: DataFrame, by: Sequence[str] = ("post_id",)) -> DataFrame:
    return df.groupBy(*by).agg(_total().alias("impact_index"))


def impact_summary(df: DataFrame, by: Sequence[str] = ("post_id",)) -> DataFrame:
    """Comments, impact index and what the index says."""
    return (
        df.groupBy(*by)
        .agg(F.count("*").alias("n_comments"), _total().alias("impact_index"))
        .withColumn("direction", direction(F.col("impact_index")))
    )


def top_impact(
    df: DataFrame,
    k: int = C.TOP_K,
    weakening: bool = False,
    post: str = "post_id",
    ord: str = "ord",
) -> DataFrame:
    """The ``k`` comments of every post that strengthen (or weaken) the story most.

    The rank filter also runs before the shuffle: a task passes on k rows per post.
    """
    impact = F.col("adjusted_impact")
    order = impact.asc_nulls_last() if weakening else impact.desc_nulls_last()
    place = F.row_number().over(Window.partitionBy(post).orderBy(order, F.col(ord)))
    return df.withColumn("place", place).where(F.col("place") <= k)


def top_comment_table(df: DataFrame, width: int = C.EXCERPT_CHARS, extra: Sequence[str] = ()) -> DataFrame:
    """Report columns, the comment cut to ``width`` characters with "..." always added."""
    return df.select(
        *extra,
        F.concat(F.substring("content", 1, width), F.lit("...")).alias("content"),
        "stance", "reactions", "sub_comments", "sarcasm_score", "adjusted_impact",
    )


def impact_scatter(df: DataFrame, post: str = "post_id", ord: str = "ord") -> DataFrame:
    return df.select(post, ord, "stance", "sarcasm_score", "adjusted_impact", "content")


def impact_box(
    df: DataFrame,
    by: Sequence[str] = ("post_id", "stance"),
    exact: bool = True,
    accuracy: int = 10_000,
    ord: str = "ord",
) -> DataFrame:
    """Box-plot figures of the adjusted impact per group.

    Fences are the outermost values within one and a half quartile distances of the box;
    values beyond them are outliers. ``exact=False`` takes the quartiles from a sketch.
    """
    by = list(by)
    impact = F.col("adjusted_impact")
    rows = df.where(impact.isNotNull()).select(*by, ord, "adjusted_impact")
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if exact:
        boxes = exact_quantiles(rows, by, "adjusted_impact", quartiles, accuracy)
    else:
        boxes = rows.groupBy(*by).agg(
            F.count("*").alias("n"),
            F.min(impact).alias("lowest"),
            F.max(impact).alias("highest"),
            *[F.percentile_approx(impact, q, accuracy).alias(name) for name, q in quartiles.items()],
        )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    beside = impact.between(F.col("q1") - reach, F.col("q3") + reach)
    figures = ["n", "lowest", "q1", "median", "q3", "highest"]
    return (
        attach(rows, boxes, by)
        .groupBy(*by, *figures)
        .agg(
            F.min(F.when(beside, impact)).alias("lower_fence"),
            F.max(F.when(beside, impact)).alias("upper_fence"),
            F.count_if(~beside).alias("n_outliers"),
        )
    )
