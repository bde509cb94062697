"""Agreement between predicted and human labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.operators.rows import distinct_values


def annotated_rows(df: DataFrame, n: int = C.ANNOTATED_ROWS, ord: str = "ord") -> DataFrame:
    """The leading ``n`` rows of every post, the ones people annotated."""
    return df.where(F.col(ord) < n)


def missing_validation(df: DataFrame, n: int = C.ANNOTATED_ROWS, ord: str = "ord") -> DataFrame:
    return annotated_rows(df, n, ord).where(F.col("validation").isNull())


def gold_labels(df: DataFrame, n: int = C.ANNOTATED_ROWS, ord: str = "ord") -> DataFrame:
    """Annotated rows as ``text`` and ``stance``, the stance being the human one."""
    return annotated_rows(df, n, ord).select(
        F.col("content").alias("text"), F.col("validation").alias("stance")
    )


def validation_values(df: DataFrame, n: int = C.ANNOTATED_ROWS, ord: str = "ord") -> DataFrame:
    return distinct_values(annotated_rows(df, n, ord), "validation")


def confusion(
    df: DataFrame,
    predicted: str = "stance",
    actual: str = "validation",
    wide: bool = False,
    labels: Sequence[str] = C.STANCES,
) -> DataFrame:
    """Rows per pair of ``predicted`` and ``actual``, missing labels being a value of their own.

    ``wide`` gives one line per predicted label, one column per label of ``labels`` and one, ``other``, for all else.
    """
    if wide:
        counts = [F.count_if(F.col(actual) == label).alias(label) for label in labels]
        listed = F.coalesce(F.col(actual).isin(list(labels)), F.lit(False))
        counts.append(F.count_if(~listed).alias("other"))
        return df.groupBy(F.col(predicted).alias("predicted")).agg(*counts)
    return df.groupBy(
        F.col(predicted).alias("predicted"), F.col(actual).alias("actual")
    ).agg(F.count("*").alias("n"))


def annotation_metrics(
    confusion_df: DataFrame, positive: str = C.BELIEVES, negative: str = C.CRITICIZES
) -> DataFrame:
    """Ratios over the two polar labels, as one row.

    The unprefixed ratios follow the established definitions, which read the matrix with
    predicted and actual exchanged: their precision is the textbook recall, their false
    negative rate the share of positive predictions that are wrong. The ``textbook_``
    columns give the usual meaning. Accuracy credits the two polar labels only, the
    textbook one every label.
    """
    predicted, actual, n = F.col("predicted"), F.col("actual"), F.col("n")

    def cell(p: str, a: str) -> Column:
        return F.sum(F.when((predicted == p) & (actual == a), n).otherwise(0)).cast("double")

    counts = confusion_df.agg(
        cell(positive, positive).alias("pp"),
        cell(positive, negative).alias("pn"),
        cell(negative, positive).alias("np"),
        cell(negative, negative).alias("nn"),
        F.sum(F.when(predicted == actual, n).otherwise(0)).cast("double").alias("hits"),
        F.sum(n).cast("double").alias("total"),
    )
    pp, pn, np, nn, total = (F.col(c) for c in ("pp", "pn", "np", "nn", "total"))
    precision, recall = F.try_divide(pp, pp + np), F.try_divide(pp, pp + pn)
    return counts.select(
        F.try_divide(pn, pn + pp).alias("false_negative_rate"),
        F.try_divide(np, np + nn).alias("false_positive_rate"),
        F.try_divide(pp + nn, total).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        F.try_divide(np, np + pp).alias("textbook_false_negative_rate"),
        F.try_divide(pn, pn + nn).alias("textbook_false_positive_rate"),
        F.try_divide(F.col("hits"), total).alias("textbook_accuracy"),
        recall.alias("textbook_precision"),
        precision.alias("textbook_recall"),
    )


def class_report(confusion_df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted averages.

    A ratio without cases is 0. The accuracy line carries its value under ``f1``.
    """
    pairs = confusion_df.dropna(subset=["predicted", "actual"])
    predicted, actual, n, none = F.col("predicted"), F.col("actual"), F.col("n"), F.lit(0).cast("long")

    def role(label: Column, hit: Column, said: Column, support: Column) -> Column:
        return F.struct(
            label.alias("label"), hit.alias("hit"), said.alias("said"), support.alias("support")
        )

    hit = F.when(predicted == actual, n).otherwise(none)
    sides = pairs.select(
        F.inline(F.array(role(predicted, hit, n, none), role(actual, none, none, n)))
    )
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hit", "said", "support")])
    precision = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    classes = sums.select("label", "hit", "support", precision.alias("p"), recall.alias("r")).withColumn(
        "f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    )

    # A rollup yields every label's own line and the line of all labels from one pass.
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w{c}") for c in "prf"]
    lines = classes.rollup("label").agg(
        F.grouping("label").alias("all"),
        *[F.avg(c).alias(c) for c in "prf"],
        *weighted,
        F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )

    def line(label: Column, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            label.alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            F.col("support").alias("support"),
        )

    blank = F.lit(None).cast("double")
    averages = F.array(
        line(F.lit("accuracy"), blank, blank, F.col("accuracy")),
        line(F.lit("macro avg"), F.col("p"), F.col("r"), F.col("f")),
        line(F.lit("weighted avg"), F.col("wp"), F.col("wr"), F.col("wf")),
    )
    own = F.array(line(F.col("label"), F.col("p"), F.col("r"), F.col("f")))
    return lines.select(F.inline(F.when(F.col("all") == 1, averages).otherwise(own)))
