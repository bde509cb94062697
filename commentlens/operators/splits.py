"""Splits whose sizes are exact, overall or within each class, without sorting the rows.

Every row draws a number from its key. A part is the rows up to a certain smallest draw, which is found by counting draws in cells, and
in finer cells of the one that holds it; only rows of that last cell are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAW_BITS = 60
#: Cells of one level, as a power of two, and levels; of n rows about n / 2 ** (CELL_BITS * LEVELS) are ranked.
CELL_BITS, LEVELS = 12, 2


def _shares(n: Column, fractions: Sequence[float]) -> list[Column]:
    """Whole parts of ``n``: what is left after rounding down goes to the largest remainders, of equal ones to the first."""
    exact = [F.round(n * F.lit(f), 6) for f in fractions]
    left = n - sum((F.floor(x) for x in exact[1:]), F.floor(exact[0]))
    rest = [F.round(x - F.floor(x), 6) for x in exact]
    out = []
    for k, x in enumerate(exact):
        ahead = [F.when((r >= rest[k]) if j < k else (r > rest[k]), 1).otherwise(0) for j, r in enumerate(rest) if j != k]
        out.append(F.floor(x) + F.when(sum(ahead[1:], ahead[0]) < left, 1).otherwise(0))
    return out


def exact_split(df: DataFrame, key: Sequence[str], fractions: Mapping[str, float], seed: int = 42, by: str | None = None) -> DataFrame:
    """Add ``split``: parts of exactly the sizes that ``fractions`` make of all rows, or of the rows of each value of ``by``.

    Sizes are rounded by largest remainder, the part named first winning ties. Which rows a part has depends on ``seed`` and ``key`` only, not
    on order or partitions. The key must be unique: rows that share it stay together, and a size is off by as many. A null in
    ``key`` counts as missing from it; rows with a null ``by`` are a class of their own. Without rows there is nothing to split.
    """
    if len(fractions) < 2 or abs(sum(fractions.values()) - 1.0) > 1e-9 or min(fractions.values()) < 0:
        raise ValueError("fractions must be two or more, and add up to 1")
    digest = F.md5(F.concat_ws(":", F.lit(seed), *key))
    draw = F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")
    # All rows are one class without a column; as a literal it would be no key to join by.
    group = F.when(draw < 0, "=").otherwise("") if by is None else F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    drawn = df.withColumns({"__group": group, "__draw": draw})
    rows = drawn.select("__group", "__draw")

    parts = _shares(F.col("n"), list(fractions.values()))
    upto = [sum(parts[1 : k + 1], parts[0]) for k in range(len(parts) - 1)]
    sizes = rows.groupBy("__group").agg(F.count("*").alias("n"))
    wanted = sizes.select("__group", F.posexplode(F.array(*upto)).alias("__bound", "__rank")).where("__rank > 0").withColumn("__cell", F.lit(0).cast("bigint"))
    for level in range(1, LEVELS + 1):
        below = DRAW_BITS - CELL_BITS * level
        inside = rows.withColumn("__cell", F.shiftright("__draw", below + CELL_BITS))
        inside = inside.join(wanted.select("__group", "__cell").distinct(), ["__group", "__cell"]) if level > 1 else inside
        counted = inside.groupBy("__group", "__cell", F.shiftright("__draw", below).alias("__next")).agg(F.count("*").alias("__n"))
        # At most 2 ** CELL_BITS cells of one cell.
        before = Window.partitionBy("__group", "__cell").orderBy("__next").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        wanted = (
            wanted.join(placed, ["__group", "__cell"])
            .where("__rank > __before AND __rank <= __before + __n")
            .select("__group", "__bound", (F.col("__rank") - F.col("__before")).alias("__rank"), F.col("__next").alias("__cell"))
        )
    last = rows.withColumn("__cell", F.shiftright("__draw", DRAW_BITS - CELL_BITS * LEVELS)).join(wanted, ["__group", "__cell"])
    place = F.row_number().over(Window.partitionBy("__group", "__bound").orderBy("__draw"))
    found = last.withColumn("__place", place).where("__place = __rank")
    limits = found.groupBy("__group").agg(*[F.max(F.when(F.col("__bound") == k, F.col("__draw"))).alias(f"__upto{k}") for k in range(len(upto))])
    names = list(fractions)
    split = F.lit(names[-1])
    for k in reversed(range(len(upto))):
        split = F.when(F.col("__draw") <= F.col(f"__upto{k}"), names[k]).otherwise(split)
    if by is None:
        bounded = drawn.withColumns({f"__upto{k}": limits.select(f"__upto{k}").scalar() for k in range(len(upto))})
    else:
        bounded = drawn.join(limits, "__group", "left")
    return bounded.select(*df.columns, split.alias("split"))
