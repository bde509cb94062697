"""Finding uncertain comments, judging their sarcasm, explaining and counting them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.functions.cues import explanation, stripped

# A detector gives, for every prompt, generated text or a (label, score) pair.
Detector = Callable[[list[str]], Sequence[str | tuple[str, float]]]


def uncertain(df: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    return df.where(F.col("confidence") < threshold)


def is_suspect(confidence: float = C.CONFIDENCE_THRESHOLD, sarcasm: float = C.SARCASM_THRESHOLD):
    return (F.col("confidence") < confidence) & (F.col("sarcasm_score") > sarcasm)


def suspects(
    df: DataFrame,
    confidence: float = C.CONFIDENCE_THRESHOLD,
    sarcasm: float = C.SARCASM_THRESHOLD,
    post: str = "post_id",
    ord: str = "ord",
) -> DataFrame:
    """Uncertain and sarcastic comments, most sarcastic first within a post."""
    return df.where(is_suspect(confidence, sarcasm)).orderBy(
        F.col(post), F.col("sarcasm_score").desc(), F.col(ord)
    )


def sarcasm_prompt(content: str = "content", max_chars: int = C.SARCASM_MAX_CHARS):
    """The detector reads at most ``max_chars`` characters of a comment, after a fixed prefix."""
    return F.concat(F.lit(C.SARCASM_PROMPT), F.substring(content, 1, max_chars))


def score_sarcasm(
    df: DataFrame,
    detector_factory: Callable[[], Detector],
    max_chars: int = C.SARCASM_MAX_CHARS,
    content: str = "content",
    sarcastic_label: str = "irony",
    compat: bool = False,
) -> DataFrame:
    """Add ``sarcasm_label`` and ``sarcasm_score``; a text the detector fails on gets ("error", 0).

    A generated answer scores 1 if it says "sarcastic", else 0. A classified one scores the
    probability of ``sarcastic_label``; with ``compat`` the probability of whichever label
    was answered. Meant for the uncertain subset: filter before this call.
    """

    @F.pandas_udf("generated string, label string, score double")
    def detected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = detector_factory()

        def answers(prompts: list[str]) -> list:
            """All at once; if that fails, by halves, so that only the culprits are lost, for a few calls each."""
            try:
                got = list(detector(prompts))
                if len(got) != len(prompts):
                    raise ValueError("one answer per prompt expected")
                return got
            except Exception:
                half = len(prompts) // 2
                return answers(prompts[:half]) + answers(prompts[half:]) if half else [None]

        for prompts in batches:
            rows = []
            asked = [p for p in prompts if p is not None]
            given = iter(answers(asked) if asked else [])
            for prompt in prompts:
                answer = None if prompt is None else next(given)
                if isinstance(answer, str):
                    rows.append((answer, None, None))
                elif answer is None:
                    rows.append((None, None, None))
                else:
                    rows.append((None, str(answer[0]), float(answer[1])))
            yield pd.DataFrame(rows, columns=["generated", "label", "score"])

    answer = detected.asNondeterministic()(sarcasm_prompt(content, max_chars))
    generated, label, score = (F.col(f"__answer.{n}") for n in ("generated", "label", "score"))
    said = F.lower(stripped(generated))
    if not compat:
        score = F.when(F.lower(label) == sarcastic_label, score).otherwise(1.0 - score)
    return (
        df.withColumn("__answer", answer)
        .withColumns(
            {
                "sarcasm_label": F.coalesce(said, F.lower(label), F.lit("error")),
                "sarcasm_score": F.when(said.contains("sarcastic"), 1.0)
                .when(said.isNotNull(), 0.0)
                .otherwise(F.coalesce(score, F.lit(0.0))),
            }
        )
        .drop("__answer")
    )


def explained(df: DataFrame, content: str = "content", whole_words: bool = False) -> DataFrame:
    """Add ``explanation``."""
    columns = F.col(content), F.col("sarcasm_score"), F.col("stance"), F.col("confidence")
    return df.withColumn("explanation", explanation(*columns, whole_words=whole_words))


def triage_counts(
    df: DataFrame,
    confidence: float = C.CONFIDENCE_THRESHOLD,
    sarcasm: float = C.SARCASM_THRESHOLD,
    post: str = "post_id",
) -> DataFrame:
    """Per post: all, uncertain and suspect comments."""
    return df.groupBy(post).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence") < confidence).alias("uncertain"),
        F.count_if(is_suspect(confidence, sarcasm)).alias("suspect"),
    )


def sarcasm_counts(df: DataFrame, post: str = "post_id") -> DataFrame:
    """Comments per sarcasm label, most frequent first within a post."""
    return (
        df.where(F.col("sarcasm_label").isNotNull())
        .groupBy(post, "sarcasm_label")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col(post), F.col("n").desc(), "sarcasm_label")
    )


def crosstab(
    df: DataFrame, rows: Sequence[str], columns: str, values: Sequence[str]
) -> DataFrame:
    """Counts of every listed value of ``columns`` per ``rows``, zero where there are none, and of all ``other`` ones.

    Naming the values spares the scan that would find them. Missing values count as other, so that a line adds up
    to its rows.
    """
    counts = [F.count_if(F.col(columns) == v).alias(v) for v in values]
    listed = F.coalesce(F.col(columns).isin(list(values)), F.lit(False))
    counts.append(F.count_if(~listed).alias("other"))
    keyed = df
    for key in rows:
        keyed = keyed.where(F.col(key).isNotNull())
    return keyed.groupBy(*rows).agg(*counts)


def suspect_table(df: DataFrame, post: str = "post_id", ord: str = "ord") -> DataFrame:
    """The suspect report's table: least confident first within a post."""
    return df.select(
        post, ord, "content", "stance", "confidence", "sarcasm_score", "explanation"
    ).orderBy(F.col(post), F.col("confidence").asc(), F.col(ord))


def triage_scatter(
    df: DataFrame,
    confidence: float = C.CONFIDENCE_THRESHOLD,
    sarcasm: float = C.SARCASM_THRESHOLD,
    post: str = "post_id",
    ord: str = "ord",
) -> DataFrame:
    """Confidence against sarcasm score, with the side of each threshold a comment is on."""
    return df.select(
        post, ord, "stance", "confidence", "sarcasm_score", "sarcasm_label", "content", "explanation",
        (F.col("sarcasm_score") > sarcasm).alias("above_sarcasm"),
        (F.col("confidence") < confidence).alias("below_confidence"),
        is_suspect(confidence, sarcasm).alias("is_suspect"),
    )
