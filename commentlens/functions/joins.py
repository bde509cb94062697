"""Bringing per-key figures back to the rows they describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a missing key equals a missing key."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    matches = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, matches, how).drop(*[f"__{k}" for k in keys])


def attach(df: DataFrame, figures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``figures``, one row per key, to every row of ``df`` with the same keys.

    Lazy, and the same on every master. How many keys there are depends on the data, so nothing is broadcast here:
    adaptive execution broadcasts the figures if their measured size is small, and splits the rows of a key that is
    much heavier than others.
    """
    return null_safe_join(df, figures, keys, "left")
