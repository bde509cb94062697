"""The given tables seen as comment threads.

=========  ==========================  ==============================================
thread of  made from                   post
=========  ==========================  ==============================================
comments   ``events``                  event type
scored     ``documents`` (+ events)    language
annotated  ``documents``, ``labels``   language
=========  ==========================  ==============================================

Stances, confidences and sarcasm scores are arithmetic on the document's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.sources.ordinals import with_ord


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stance_of(number: Column) -> Column:
    return (
        F.when(number == 0, C.BELIEVES).when(number == 1, C.CRITICIZES).when(number == 2, C.NEUTRAL)
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comments; ``ord`` grows with the event id but leaves gaps."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("post_id"),
        F.col("event_id").alias("ord"),
        F.col("user_id").alias("author"),
        F.floor("value").alias("reactions"),
        (F.col("user_id") % 7).alias("sub_comments"),
        "ts",
    )


def scored(spark: SparkSession, sf_dir: str, timed: bool = False) -> DataFrame:
    """Documents as scored comments; ``timed`` adds time and counts of the event of the same id."""
    doc = F.col("doc_id")

    def marked(divisor: int, mark: str) -> Column:
        return F.when(doc % divisor == 0, mark).otherwise("")

    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("post_id"),
        doc.alias("ord"),
        F.concat("text", marked(5, " ?"), marked(7, " 😂"), marked(11, " !")).alias("content"),
        stance_of(doc % 3).alias("stance"),
        ((doc * 37 % 1000) / 1000.0).alias("confidence"),
        ((doc * 91 % 1000) / 1000.0).alias("sarcasm_score"),
        F.when(doc % 2 == 0, "irony").otherwise("non_irony").alias("sarcasm_label"),
    )
    if not timed:
        return rows
    times = comments(spark, sf_dir).select("ord", "reactions", "sub_comments", "ts")
    spelled = F.date_format("ts", "MM/dd/yyyy hh:mm:ss a")
    return rows.join(times, "ord").withColumn("comment_at", spelled)


def annotated(spark: SparkSession, sf_dir: str, complete: bool = True) -> DataFrame:
    """Documents with a predicted and a human stance, those without the latter on request."""
    toxic, quality = F.col("toxic"), F.col("quality")
    human = (
        F.when(toxic == 1, C.CRITICIZES)
        .when(quality == 1, C.NEUTRAL)
        .when(quality.isNotNull(), C.BELIEVES)
    )
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "inner" if complete else "left").select(
        F.col("lang").alias("post_id"),
        "doc_id",
        F.col("text").alias("content"),
        stance_of(F.col("doc_id") % 3).alias("stance"),
        human.alias("validation"),
    )


def annotated_files(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """Documents with their position in their language, as annotation files list them; the ``first`` of each, or all.

    Positions are found without the texts. Of the first ones a task passes on ``first`` ids per language at most.
    """
    ids = table(spark, sf_dir, "documents").select(F.col("lang").alias("post_id"), "doc_id")
    if first is None:
        positions = with_ord(ids, "doc_id")
    else:
        place = F.row_number().over(Window.partitionBy("post_id").orderBy("doc_id"))
        positions = ids.withColumn("place", place).where(F.col("place") <= first).withColumn("ord", F.col("place") - 1)
    return annotated(spark, sf_dir, complete=False).join(positions.select("doc_id", "ord"), "doc_id")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with three logits each from a teacher and a student."""
    doc = F.col("doc_id")

    def three(a: int, b: int, c: int) -> Column:
        return F.array(*[(doc * m % 11 - 5) / 2.0 for m in (a, b, c)])

    return table(spark, sf_dir, "labels").select(
        doc, three(3, 5, 7).alias("teacher"), three(2, 6, 10).alias("student"),
        (doc % 3).cast("int").alias("labels"),
    )


# A stand-in model: plain counting, so that any engine can repeat it.

def counting_detector():
    """Calls a prompt ironic if it has more a's than e's; fails on every thirteenth length."""

    def detect(prompts: list[str]) -> list[tuple[str, float]]:
        answers = []
        for prompt in prompts:
            if len(prompt) % 13 == 0:
                raise ValueError("unreadable")
            ironic = prompt.count("a") > prompt.count("e")
            answers.append(("Irony" if ironic else "Non_irony", 0.5 + len(prompt) % 50 / 100))
        return answers

    return detect
