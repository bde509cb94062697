from datetime import datetime, timedelta

import pytest

from commentlens.operators import dynamics as D

T0 = datetime(2024, 1, 1, 10, 50)
SCHEMA = "post_id string, ord long, author string, reactions long, sub_comments long, ts timestamp_ntz"


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


@pytest.fixture
def comments(spark):
    rows = [
        # The post itself is not the earliest row; two comments come at once; one has no author.
        ("a", 0, "ann", 7, 4, at(3)), ("a", 1, "bob", 1, 0, at(0)), ("a", 2, None, 0, 0, at(0)),
        ("a", 3, "ann", 0, 0, at(1440)),
        # One event only.
        ("b", 0, "ann", 2, 0, at(5)),
        # An undated comment.
        ("c", 1, "eve", 9, 9, at(30)), ("c", 0, "dan", 1, 1, None), ("c", 2, None, 0, 0, at(90)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_post(df):
    return {r.post_id: r for r in df.collect()}


def test_post_metrics(comments):
    m = by_post(D.post_metrics(comments))
    a, b, c = m["a"], m["b"], m["c"]
    assert (a.min_spread_time_minutes, a.max_spread_time_minutes, a.cls_days) == (0.0, 1440.0, 1.0)
    assert (a.views, a.unique_authors, a.growth_rate) == (11, 3, 11.0)
    assert (b.min_spread_time_minutes, b.cls_days, b.growth_rate) == (None, 0.0, None)
    assert (c.min_spread_time_minutes, c.max_spread_time_minutes, c.views, c.unique_authors) == (60.0, 60.0, 2, 3)


def test_comments_without_a_post_are_a_post(spark):
    rows = [(None, 0, "ann", 1, 1, at(0)), (None, 1, "bob", 0, 0, at(2))]
    only, = D.post_metrics(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (only.post_id, only.min_spread_time_minutes, only.views) == (None, 2.0, 2)


def test_post_metrics_compat(comments):
    m = by_post(D.post_metrics(comments, compat=True))
    assert m["b"].growth_rate == float("inf")
    assert m["c"].max_spread_time_minutes is None
    assert m["a"].max_spread_time_minutes == 1440.0


def test_overall(comments):
    o = D.overall_metrics(comments).first()
    assert (o.views, o.unique_authors, o.min_spread_time_minutes, o.cls_days) == (15, 5, 0.0, 1.0)
    assert o.growth_rate == 15.0


def test_overall_compat(comments):
    o = D.overall_metrics(comments, compat=True, last_post="c").first()
    assert (o.views, o.growth_rate, o.min_spread_time_minutes) == (30, 30.0, 60.0)
    with pytest.raises(ValueError, match="last_post"):
        D.overall_metrics(comments, compat=True)


def test_report_and_sketched_authors(comments):
    report = by_post(D.metrics_report(comments, approx_authors=0.01))
    assert set(report) == {"a", "b", "c", D.OVERALL}
    assert report[D.OVERALL].unique_authors == 5


def test_hours(comments):
    hourly = D.hourly_counts(comments)
    counts = {(r.post_id, r.hour): r.n for r in hourly.collect()}
    assert counts == {
        ("a", datetime(2024, 1, 1, 10)): 3, ("a", datetime(2024, 1, 2, 10)): 1,
        ("b", datetime(2024, 1, 1, 10)): 1,
        ("c", datetime(2024, 1, 1, 11)): 1, ("c", datetime(2024, 1, 1, 12)): 1,
    }
    curve = {(r.post_id, r.hours_since_first): r.relative_n for r in D.hourly_curve(hourly).collect()}
    assert curve["a", 0.0] == 1.0 and curve["a", 24.0] == pytest.approx(1 / 3)
    assert curve["c", 1.0] == 1.0


def test_timeline(comments):
    rows = [(r.post_id, r.ord, r.offset_minutes) for r in D.event_timeline(comments).collect()]
    assert rows == [
        ("a", 1, 0.0), ("a", 2, 0.0), ("a", 0, 3.0), ("a", 3, 1440.0),
        ("b", 0, 0.0), ("c", 1, 0.0), ("c", 2, 60.0),
    ]
