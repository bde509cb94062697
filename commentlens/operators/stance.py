"""Stance of each comment and how stances are distributed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlens import constants as C
from commentlens.functions.cues import is_blank
from commentlens.functions.labels import top_label

# scorer(texts, hypotheses) gives, for every text, one score per hypothesis.
Scorer = Callable[[list[str], list[str]], Sequence[Sequence[float]]]


def score_text(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    labels: Sequence[str] = C.STANCES,
    content: str = "content",
    scores: str = "scores",
    template: str = C.HYPOTHESIS_TEMPLATE,
) -> DataFrame:
    """Add ``scores``, a map from label to score, from any batch text model.

    ``scorer_factory`` runs once per task, on the executor, and the scorer it returns gets
    whole Arrow batches. Only ``content`` travels to Python. Blank texts are not scored
    (NULL). Filter before this call: nothing is pushed below a model.
    """
    hypotheses = [template.format(label) for label in labels]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_factory()
        for texts in batches:
            results = pd.Series([None] * len(texts), dtype=object)
            spoken = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            if spoken:
                rows = scorer([texts.iloc[i] for i in spoken], hypotheses)
                for i, row in zip(spoken, rows, strict=True):
                    results.iat[i] = [float(s) for s in row]
            yield results

    # Declared non-deterministic so that a later filter on the result cannot make the
    # optimizer run the model a second time.
    per_label = scored.asNondeterministic()(content)
    names = F.array(*[F.lit(label) for label in labels])
    return df.withColumn("__scored", per_label).withColumn(
        scores, F.map_from_arrays(names, "__scored")
    ).drop("__scored")


def label_stance(
    df: DataFrame,
    labels: Sequence[str] = C.STANCES,
    content: str = "content",
    scores: str = "scores",
) -> DataFrame:
    """Turn ``scores`` into ``stance`` and ``confidence``; blank texts are neutral at 0."""
    blank = is_blank(F.col(content))
    best = top_label(F.col(scores), labels)
    return (
        df.withColumn("__best", best)
        .withColumns(
            {
                "stance": F.when(blank, F.lit(C.NEUTRAL)).otherwise(F.col("__best.label")),
                "confidence": F.when(blank, F.lit(0.0)).otherwise(F.col("__best.score")),
            }
        )
        .drop("__best", scores)
    )


def score_stance(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    labels: Sequence[str] = C.STANCES,
    content: str = "content",
    template: str = C.HYPOTHESIS_TEMPLATE,
) -> DataFrame:
    """Add ``stance`` and ``confidence``: the best label and its score."""
    return label_stance(score_text(df, scorer_factory, labels, content, template=template), labels, content)


def stance_distribution(df: DataFrame, post: str = "post_id", stance: str = "stance") -> DataFrame:
    """Count and percentage of every stance, largest first within a post.

    Percentages are of all rows of the post, rows without a stance included; those rows
    have no line of their own. Halves round to the even digit.
    """
    counts = df.groupBy(post, stance).agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(post))
    return (
        counts.withColumn("percentage", F.bround(share, 2))
        .where(F.col(stance).isNotNull())
        .orderBy(F.col(post), F.col("n").desc(), F.col(stance))
    )
