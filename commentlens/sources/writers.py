"""Writers. Each writes a folder of part files from all tasks at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens import schemas as S


def write_comments(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    by: str | None = "post_id",
    order: Sequence[str | Column] = ("ord",),
    mode: str = "errorifexists",
) -> None:
    """Write comments, by default into one subfolder per post, in ``order`` within each file.

    Rows of a post are brought together by a rebalance, which fills files to a size: small posts
    share a task, and a post too large for one task is spread over several. CSV files carry the
    headers of the files they were read from.
    """
    if by:
        df = df.hint("rebalance", by).sortWithinPartitions(by, *order)
    if fmt == "csv":
        df = df.withColumnsRenamed({name: header for header, (name, _) in S.COLUMNS.items()})
    writer = df.write.mode(mode).format(fmt)
    if by:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', emptyValue="")
    writer.save(path)


def write_gold(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write ``text`` and ``stance``. Keep ``path`` outside the folder annotations are read from,
    or the next run reads its own output."""
    write_comments(df.select("text", "stance"), path, fmt, by=None, mode=mode)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write post metrics as JSON lines under their published names."""
    df.select(
        "post_id",
        "min_spread_time_minutes",
        "max_spread_time_minutes",
        "views",
        "unique_authors",
        F.col("cls_days").alias("CLS_days"),
        F.col("growth_rate").alias("GR"),
    ).write.mode(mode).option("ignoreNullFields", False).json(path)
