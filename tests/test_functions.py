from datetime import datetime

import pytest
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.functions import cues, labels, times


def values(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


@pytest.fixture
def written(spark):
    rows = [
        (0, "03/31/2024 02:30:10 AM"), (1, "03/31/2024 12:05:01 AM"), (2, "1/5/2024 12:05:01 PM"),
        (3, "11/09/24 19:04"), (4, "13/40/2024 01:00:00 AM"), (5, "soon"), (6, None),
        (7, "01/23/2024 07:04:10 PM"),
    ]
    return spark.createDataFrame(rows, "i int, c string")


def test_parse_reads_both_spellings_and_voids_the_rest(written):
    parsed = written.withColumn("ts", times.parse_comment_time(F.col("c")))
    assert dict(parsed.dtypes)["ts"] == "timestamp_ntz"
    assert values(parsed, "ts") == [
        datetime(2024, 3, 31, 2, 30, 10), datetime(2024, 3, 31, 0, 5, 1), datetime(2024, 1, 5, 12, 5, 1),
        datetime(2024, 11, 9, 19, 4), None, None, None, datetime(2024, 1, 23, 19, 4, 10),
    ]


def test_compat_parse_ignores_am_pm(written):
    parsed = values(written.withColumn("ts", times.parse_comment_time(F.col("c"), compat=True)), "ts")
    assert parsed[1] == datetime(2024, 3, 31, 12, 5, 1)
    assert parsed[7] == datetime(2024, 1, 23, 7, 4, 10)
    assert parsed[3] is None


def test_times_do_not_depend_on_the_session_zone(spark, written):
    def read():
        parsed = written.withColumn("ts", times.parse_comment_time(F.col("c")))
        start = F.lit("2024-03-30 23:30:00").cast("timestamp_ntz")
        return parsed.select(
            "i", "ts", times.hour_of(F.col("ts")).alias("hour"),
            times.minutes_between(start, F.col("ts")).alias("minutes"),
        ).orderBy("i").collect()

    in_utc = read()
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
    try:
        assert read() == in_utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert in_utc[0]["hour"] == datetime(2024, 3, 31, 2)
    assert in_utc[0]["minutes"] == pytest.approx(180 + 10 / 60)


def test_differences(spark):
    row = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-02 12:00:30.5' b").select(
        times.minutes_between(F.col("a"), F.col("b")), times.hours_between(F.col("a"), F.col("b")),
        times.days_between(F.col("a"), F.col("b")), times.days_between(F.col("b"), F.col("a")),
    ).first()
    assert row[0] == 2160 + 30.5 / 60
    assert row[2] == pytest.approx(1.5 + 30.5 / 86400)
    assert row[3] == -row[2]


def test_text_cues(spark):
    texts = ["I know", "NEVER!", "so 😂", 'he said "x"', "it's", "why?", "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = cues.text_cues(df)
    assert values(got, "has_negation") == [True, True, False, False, False, False, False, None]
    assert values(got, "has_emoji")[:3] == [False, False, True]
    assert values(got, "has_quotes")[3:6] == [True, True, False]
    assert values(got, "has_exclamation")[1] and values(got, "has_question")[5]
    whole = cues.text_cues(df, whole_words=True)
    assert values(whole, "has_negation")[:2] == [False, True]


@pytest.mark.parametrize(
    ("content", "sarcasm", "stance", "confidence", "expected"),
    [
        ("x", 0.71, C.CRITICIZES, 0.49, C.SARCASTIC_CRITICISM),
        ("x?", 0.71, C.BELIEVES, 0.49, C.IRONIC_ENDORSEMENT),
        ("x", 0.71, C.NEUTRAL, 0.49, C.AMBIGUOUS_TONE),
        ("no?", 0.71, "something else", 0.49, None),
        ("no?", 0.71, None, 0.49, None),
        ("why?", 0.7, C.NEUTRAL, 0.4, C.SARCASTIC_QUESTION),
        ("why?", 0.71, C.NEUTRAL, 0.5, C.SARCASTIC_QUESTION),
        ("🙄", 0.61, C.NEUTRAL, 0.55, C.SARCASTIC_EMOJI),
        ("🙄", 0.6, C.NEUTRAL, 0.55, C.NEEDS_REVIEW),
        ("I know", 0.6, C.NEUTRAL, 0.59, C.SKEPTICAL),
        ("I know", 0.6, C.NEUTRAL, 0.6, C.NEEDS_REVIEW),
        ("yes!", 0.39, C.BELIEVES, 0.59, C.STRONG_EMOTION),
        ("yes!", 0.4, C.BELIEVES, 0.59, C.NEEDS_REVIEW),
        ("yes", 0.1, C.BELIEVES, 0.1, C.NEEDS_REVIEW),
    ],
)
def test_explanation(spark, content, sarcasm, stance, confidence, expected):
    df = spark.createDataFrame([(content, sarcasm, stance, confidence)], "t string, s double, l string, c double")
    assert df.select(cues.explanation(F.col("t"), F.col("s"), F.col("l"), F.col("c"))).first()[0] == expected


def test_blank(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \n\t"), (3, " "), (4, " a ")], "i int, t string")
    assert values(df.withColumn("b", cues.is_blank(F.col("t"))), "b") == [True, True, True, True, False]


def test_labels(spark):
    df = spark.createDataFrame(
        [(0, C.NEUTRAL, ["a", "b"], 0.5), (1, "other", [], -0.5), (2, None, None, 0.0)],
        "i int, l string, many array<string>, x double",
    )
    got = df.select(
        "i", labels.encode_label(F.col("l"), C.LABEL_IDS_FROM_ANNOTATIONS).alias("a"),
        labels.encode_label(F.col("l"), C.LABEL_IDS_FROM_GOLD).alias("g"),
        labels.first_label(F.col("many")).alias("first"), labels.direction(F.col("x")).alias("d"),
    )
    assert values(got, "a") == [1, None, None]
    assert values(got, "g") == [2, None, None]
    assert values(got, "first") == ["a", None, None]
    assert values(got, "d") == ["strengthening", "weakening", "balanced"]


def test_top_label_breaks_ties_by_label_order(spark):
    df = spark.createDataFrame(
        [(0, {"a": 0.2, "b": 0.7, "c": 0.1}), (1, {"a": 0.1, "b": 0.45, "c": 0.45}), (2, {"z": 1.0}), (3, None)],
        "i int, m map<string,double>",
    )
    got = df.withColumn("t", labels.top_label(F.col("m"), ["a", "c", "b"]))
    assert [t and (t["label"], t["score"]) for t in values(got, "t")] == [("b", 0.7), ("c", 0.45), None, None]
