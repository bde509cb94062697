"""The analyses end to end, from input files to written tables.

Models run once: what they produce is written, and everything after reads it back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens import schemas as S
from commentlens.functions.joins import null_safe_join
from commentlens.functions.times import parse_comment_time
from commentlens.operators import dynamics, evaluation, impact, rows, stance, training, triage
from commentlens.sources import readers, writers


def _timed(df: DataFrame, compat: bool = False, patterns: Sequence[str] = C.COMMENT_TIME_PATTERNS) -> DataFrame:
    return df.withColumn("ts", parse_comment_time(F.col("comment_at"), patterns, compat=compat))


def undated(df: DataFrame, patterns: Sequence[str] = C.COMMENT_TIME_PATTERNS, compat: bool = False) -> DataFrame:
    """Per post: comments, and those whose time fits no pattern and which dated tables therefore lack."""
    lost = F.count_if(F.col("comment_at").isNotNull() & F.col("ts").isNull())
    return _timed(df, compat, patterns).groupBy("post_id").agg(F.count("*").alias("comments"), lost.alias("undated"))


def measure_dynamics(
    spark: SparkSession, posts: str, out: str, compat: bool = False, last_post: str | None = None,
    patterns: Sequence[str] = C.COMMENT_TIME_PATTERNS,
) -> dict[str, DataFrame]:
    """Write the metrics of every post and of all; give the activity curves and how many comments have no readable time."""
    texts = readers.read_posts(spark, posts)
    comments = _timed(texts, compat, patterns)
    writers.write_metrics(dynamics.metrics_report(comments, compat=compat, last_post=last_post), out)
    hourly = dynamics.hourly_counts(comments)
    return {
        "hourly_counts": hourly,
        "hourly_curve": dynamics.hourly_curve(hourly),
        "undated": undated(texts, patterns, compat),
    }


def classify(
    spark: SparkSession, posts: str, out: str, scorer_factory: Callable[[], stance.Scorer], fmt: str = "parquet"
) -> DataFrame:
    """Score the stance of every comment, write the result, give the distribution."""
    comments = rows.require_columns(readers.read_posts(spark, posts), "content")
    plain = rows.drop_post_row(comments).select(
        "post_id", "ord", "content", "reactions", "sub_comments", "comment_at"
    )
    # A file is read by one task. Whatever its size, the model's work is dealt out evenly.
    writers.write_comments(stance.score_stance(plain.hint("rebalance"), scorer_factory), out, fmt)
    return stance.stance_distribution(readers.read_comments(spark, out, S.CLASSIFIED, fmt))


def triage_classified(
    spark: SparkSession,
    classified: DataFrame,
    report_out: str,
    suspects_out: str,
    detector_factory: Callable[[], triage.Detector],
    fmt: str = "parquet",
    compat: bool = False,
) -> dict[str, DataFrame]:
    """Judge and explain the uncertain comments, write them and the suspects, give the report tables."""
    complete = rows.complete_rows(classified, ["content", "stance", "confidence"])
    judged = triage.score_sarcasm(triage.uncertain(complete), detector_factory, compat=compat)
    writers.write_comments(triage.explained(judged), report_out, fmt)
    report = readers.read_comments(spark, report_out, S.REPORT, fmt)
    most_sarcastic = [F.col("sarcasm_score").desc(), "ord"]
    writers.write_comments(report.where(triage.is_suspect()), suspects_out, fmt, order=most_sarcastic)
    judged_counts = triage.triage_counts(report).drop("total")
    totals = complete.groupBy("post_id").agg(F.count("*").alias("total"))
    return {
        "counts": null_safe_join(totals, judged_counts, ["post_id"], "left").fillna(0),
        "crosstab": triage.crosstab(report, ["post_id", "stance"], "sarcasm_label", C.SARCASM_LABELS),
        "sarcasm_counts": triage.sarcasm_counts(report),
        "suspects": triage.suspect_table(report.where(triage.is_suspect())),
        "scatter": triage.triage_scatter(report),
    }


def measure_impact(
    report: DataFrame, compat: bool = False, patterns: Sequence[str] = C.COMMENT_TIME_PATTERNS
) -> dict[str, DataFrame]:
    """All impact tables of an uncertainty report."""
    complete = rows.complete_rows(report, impact.INPUTS)
    scores = impact.impact_scores(_timed(complete, patterns=patterns), compat=compat).persist()  # seven tables are made of it
    # Excerpts are cut first: ranking then moves short rows.
    excerpts = impact.top_comment_table(scores, extra=["post_id", "ord"])
    return {
        "daily": impact.daily_impact(scores),
        "by_stance": impact.impact_by_stance(scores),
        "summary": impact.impact_summary(scores),
        "strengthening": impact.top_impact(excerpts),
        "weakening": impact.top_impact(excerpts, weakening=True),
        "box": impact.impact_box(scores),
        "scatter": impact.impact_scatter(scores),
        "undated": undated(complete, patterns),
    }


def evaluate_annotations(spark: SparkSession, annotations: str, gold_out: str) -> dict[str, DataFrame]:
    """Write the gold labels; give agreement figures and the training set."""
    annotated = readers.read_annotations(spark, annotations)
    writers.write_gold(evaluation.gold_labels(annotated), gold_out)
    confusion = evaluation.confusion(evaluation.annotated_rows(annotated))
    return {
        "confusion": confusion,
        "metrics": evaluation.annotation_metrics(confusion),
        "class_report": evaluation.class_report(confusion),
        "missing": evaluation.missing_validation(annotated),
        "training_set": training.training_set_from_annotations(annotated),
    }
