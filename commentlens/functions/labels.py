"""Label lookups and rule-of-sign text, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlens import constants as C


def encode_label(label: Column, mapping: Mapping[str, int]) -> Column:
    """Number of a label; NULL for a label outside the mapping."""
    coded = F.lit(None).cast("int")
    for name, number in mapping.items():
        coded = F.when(label == name, F.lit(number)).otherwise(coded)
    return coded


def first_label(labels: Column) -> Column:
    """First element of a label list; NULL for an empty list."""
    return F.try_element_at(labels, F.lit(1))


def direction(index: Column) -> Column:
    return (
        F.when(index > 0, C.STRENGTHENING).when(index < 0, C.WEAKENING).otherwise(C.BALANCED)
    )


def top_label(scores: Column, labels: Sequence[str]) -> Column:
    """Best label of a ``map<label, score>`` as ``struct<score, rank, label>``.

    Equal scores resolve to the label named first. NULL if the map holds none of them.
    """
    candidates = [
        F.struct(
            F.try_element_at(scores, F.lit(name)).alias("score"),
            F.lit(-rank).alias("rank"),
            F.lit(name).alias("label"),
        )
        for rank, name in enumerate(labels)
    ]
    scored = F.filter(F.array(*candidates), lambda c: c["score"].isNotNull())
    return F.array_max(scored)
