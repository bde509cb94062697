"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here a
sketch first says between which two values each quantile must lie; all other
values are only counted, so that one task gets a sliver of even the largest group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens.functions.joins import attach


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group: ``n`` non-null values, ``lowest``, ``highest`` and each named quantile.

    Quantiles interpolate linearly between neighbouring values.
    """
    names = list(quantiles)
    x = F.col(value)
    rows = df.where(x.isNotNull()).select(*by, value)

    # A sketch value is at most n / accuracy ranks off. Three times that on either side,
    # minus the sketch's own error, still leaves room for the two neighbouring ranks.
    reach = 3.0 / accuracy
    probes = [p for q in quantiles.values() for p in (max(q - reach, 0.0), min(q + reach, 1.0))]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min(x).alias("lowest"),
        F.max(x).alias("highest"),
        F.percentile_approx(x, probes, accuracy).alias("__probes"),
    )
    # In a small group the neighbouring rank may lie outside; it is taken whole.
    small = F.col("n") <= accuracy
    edges = {}
    for i, name in enumerate(names):
        edges[f"__from_{name}"] = F.when(small, F.col("lowest")).otherwise(F.col("__probes")[2 * i])
        edges[f"__to_{name}"] = F.when(small, F.col("highest")).otherwise(F.col("__probes")[2 * i + 1])
    placed = attach(rows, sketch.withColumns(edges).select(*by, "n", "lowest", "highest", *edges), by)

    # Values inside a bracket stay themselves; the ones in a gap share one cell that sorts
    # right after the bracket below it.
    lower, upper = [F.col(f"__from_{n}") for n in names], [F.col(f"__to_{n}") for n in names]
    inside = F.lit(False)
    for start, end in zip(lower, upper):
        inside = inside | x.between(start, end)
    passed = [F.when(end < x, end) for end in upper]
    below = F.greatest(*passed) if len(passed) > 1 else passed[0]
    cells = (
        placed.select(
            *by, "n", "lowest", "highest", (~inside).alias("__gap"),
            F.when(inside, x).otherwise(below).alias("__cell"),
        )
        .groupBy(*by, "n", "lowest", "highest", "__cell", "__gap")
        .agg(F.count("*").alias("__count"))
    )
    in_order = Window.partitionBy(*by).orderBy(F.col("__cell").asc_nulls_first(), "__gap")
    ranked = cells.withColumn(
        "__end", F.sum("__count").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )

    def value_at(rank: Column) -> Column:
        here = (rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__count"))
        missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
        return F.max(F.when(here, F.when(F.col("__gap"), missed).otherwise(F.col("__cell"))))

    picks, results = [], []
    for name in names:
        position = (F.col("n") - 1) * F.lit(float(quantiles[name]))
        left, right = F.floor(position), F.ceil(position)
        picks += [value_at(left).alias(f"__left_{name}"), value_at(right).alias(f"__right_{name}")]
        a, b = F.col(f"__left_{name}"), F.col(f"__right_{name}")
        results.append((a + (b - a) * (position - left)).alias(name))
    return (
        ranked.groupBy(*by, "n", "lowest", "highest")
        .agg(*picks)
        .select(*by, "n", "lowest", "highest", *results)
    )
