from datetime import date, datetime

import pytest

from commentlens import constants as C
from commentlens.operators import impact as I
from commentlens.operators.rows import by_time, complete_rows


@pytest.fixture
def comments(spark):
    d1, d2 = datetime(2024, 1, 1, 23), datetime(2024, 1, 3, 1)
    rows = [
        ("p", 1, "x" * 151, C.BELIEVES, 10, 0, "c", d2, 0.0), ("p", 2, "b", C.CRITICIZES, 5, 4, "c", d1, 1.0),
        ("p", 3, "c", C.NEUTRAL, 10, 4, "c", d1, 0.5), ("p", 4, "d", "unheard of", 10, 4, "c", None, 0.5),
        ("q", 1, "e", C.CRITICIZES, 0, 0, "c", d1, 0.0), ("q", 2, None, C.BELIEVES, 99, 99, "c", d1, 0.0),
    ]
    df = spark.createDataFrame(
        rows, "post_id string, ord int, content string, stance string, reactions long, sub_comments long,"
        " comment_at string, ts timestamp_ntz, sarcasm_score double",
    )
    return complete_rows(df, I.INPUTS)


@pytest.fixture
def scores(comments):
    return I.impact_scores(comments)


def test_scores(scores):
    rows = {(r.post_id, r.ord): r for r in scores.collect()}
    assert len(rows) == 5
    assert rows["p", 1].adjusted_impact == pytest.approx(0.5, abs=1e-6)
    assert rows["p", 2].adjusted_impact == pytest.approx(-0.375, abs=1e-6)
    assert rows["p", 3].adjusted_impact == 0.0
    assert (rows["p", 4].polarity, rows["p", 4].adjusted_impact) == (None, None)
    # The largest counts are the post's own, and nothing is divided by zero.
    assert str(rows["q", 1].adjusted_impact) == "0.0"
    assert rows["p", 1].date == date(2024, 1, 3)


def test_daily(scores):
    days = [(r.post_id, r.date.day, round(r.adjusted_impact, 4), round(r.cumulative_impact, 4))
            for r in I.daily_impact(scores).orderBy("post_id", "date").collect()]
    assert days == [("p", 1, -0.375, -0.375), ("p", 3, 0.5, 0.125), ("q", 1, 0.0, 0.0)]
    total = {r.post_id: r.impact_index for r in I.impact_total(scores).collect()}
    assert total["p"] == pytest.approx(0.125, abs=1e-6)


def test_summary(scores, comments):
    summary = {r.post_id: (r.n_comments, r.direction) for r in I.impact_summary(scores).collect()}
    assert summary == {"p": (4, C.STRENGTHENING), "q": (1, C.BALANCED)}
    compat = I.impact_summary(I.impact_scores(comments, compat=True)).collect()
    assert all(r.impact_index == 0.0 and r.direction == C.BALANCED for r in compat)


def test_by_stance(scores):
    means = {(r.post_id, r.stance): r.mean_adjusted_impact for r in I.impact_by_stance(scores).collect()}
    assert means["p", "unheard of"] is None
    assert means["p", C.BELIEVES] == pytest.approx(0.5, abs=1e-6)


def test_top(scores):
    top = [(r.post_id, r.place, r.ord) for r in I.top_impact(scores, k=2).orderBy("post_id", "place").collect()]
    assert top == [("p", 1, 1), ("p", 2, 3), ("q", 1, 1)]
    weak = [r.ord for r in I.top_impact(scores, weakening=True).where("post_id = 'p'").orderBy("place").collect()]
    assert weak == [2, 3, 1, 4]
    table = I.top_comment_table(I.top_impact(scores, k=1), extra=["ord"]).where("ord = 1").collect()
    assert {r.content for r in table} == {"x" * 150 + "...", "e..."}


def test_by_time(comments):
    assert [(r.post_id, r.ord) for r in by_time(comments).collect()] == [
        ("p", 2), ("p", 3), ("p", 1), ("p", 4), ("q", 1),
    ]


@pytest.mark.parametrize("exact", [True, False])
def test_box(spark, exact):
    xs = [0.0, 0.1, 0.2, 0.3, 0.4, 5.0]
    df = spark.createDataFrame([("p", "s", i, x) for i, x in enumerate(xs)] + [("p", "t", 9, None)],
                               "post_id string, stance string, ord int, adjusted_impact double")
    box, = I.impact_box(df, exact=exact).collect()
    assert (box.n, box.lowest, box.highest) == (6, 0.0, 5.0)
    assert (box.lower_fence, box.upper_fence, box.n_outliers) == (0.0, 0.4, 1)
    if exact:
        assert (box.q1, box.median, box.q3) == pytest.approx((0.125, 0.25, 0.375))
