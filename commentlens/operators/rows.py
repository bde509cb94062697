"""Row selection and combination shared by all analyses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Pass ``df`` on, or fail while the plan is built."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input must contain {', '.join(map(repr, missing))}; it has {df.columns}")
    return df


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of ``columns`` is missing."""
    return df.dropna(subset=list(columns))


def drop_post_row(df: DataFrame, ord: str = "ord") -> DataFrame:
    """Leave out each post's leading row, which describes the post itself."""
    return df.where(F.col(ord) >= 1)


def known_labels(df: DataFrame, labels: Sequence[str], label: str = "stance") -> DataFrame:
    return df.where(F.col(label).isin(list(labels)))


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, duplicates kept."""
    if not parts:
        raise ValueError("nothing to combine: no part given")
    return reduce(DataFrame.unionByName, parts)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def by_time(df: DataFrame, ts: str = "ts", post: str = "post_id", ord: str = "ord") -> DataFrame:
    """Comments of every post in order of time, undated ones last."""
    return df.orderBy(F.col(post), F.col(ts).asc_nulls_last(), F.col(ord))
