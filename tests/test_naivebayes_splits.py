import math
import re
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.operators import naivebayes, splits, stance

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELS = ("good", "bad", "odd")
ROWS = [
    ("lovely sunny day", "good"), ("Lovely SEA, lovely sun", "good"), ("cold rain", "bad"), ("cold, cold wind", "bad"), (None, "bad"), ("", "bad"), ("unlabelled words", None),
    ("other label", "none"), ("cold rain", "bad"),
]


def plain_logs(rows, max_features, smoothing, labels=LABELS):
    rows = [(re.findall(r"\w+", t.lower()), y) for t, y in rows if t is not None and y in labels]
    every = Counter(w for words, _ in rows for w in words)
    top = sorted(every, key=lambda w: (-every[w], w))[:max_features]
    out = {"": [math.log((sum(y == k for _, y in rows) + smoothing) / (len(rows) + smoothing * len(labels))) for k in labels]}
    for w in top:
        n = [sum(words.count(w) for words, y in rows if y == k) for k in labels]
        all_ = [sum(words.count(v) for words, y in rows if y == k for v in top) for k in labels]
        out[w] = [math.log((a + smoothing) / (b + smoothing * len(top))) for a, b in zip(n, all_)]
    return out


@pytest.mark.parametrize(("max_features", "smoothing"), [(5000, 1.0), (3, 0.5)])
def test_weights_and_scores_like_plain_ones(spark, max_features, smoothing):
    df = spark.createDataFrame(ROWS, "text string, label string").repartition(3)
    weights = naivebayes.term_log_odds(df, LABELS, max_features=max_features, smoothing=smoothing)
    want = plain_logs(ROWS, max_features, smoothing)
    got = {r.term: list(r.weights) for r in weights.collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)

    texts = [(1, "cold lovely unseen"), (2, None), (3, ""), (4, "cold cold rain sea"), (None, "lovely"), (5, "nothing known")]
    new = spark.createDataFrame(texts, "id int, content string").withColumns({"term": F.lit("clash"), "weights": F.lit(0)})
    for bounded in (True, False):
        scored = naivebayes.score_by_terms(new, weights, ["id"], LABELS, bounded=bounded)
        rows = {r.id: r.scores for r in scored.collect()}
        for k, text in texts:
            logs = [own + sum(want[w][j] for w in re.findall(r"\w+", (text or "").lower()) if w in want) for j, own in enumerate(want[""])]
            total = sum(map(math.exp, logs))
            assert rows[k] == pytest.approx({y: math.exp(x) / total for y, x in zip(LABELS, logs)})
    best = {k: C.NEUTRAL if not (text or "").strip() else max(LABELS, key=rows[k].__getitem__) for k, text in texts}
    assert {r.id: r.stance for r in stance.label_stance(scored, LABELS).collect()} == best

    batch = stance.score_text(new, naivebayes.as_batch_scorer(weights, LABELS), LABELS)
    assert all(r.scores is None or r.scores == pytest.approx(rows[r.id]) for r in batch.collect())
    assert sum(r.scores is None for r in batch.collect()) == 2  # blank ones are not scored


def test_nothing_to_learn_from(spark):
    weights = naivebayes.term_log_odds(spark.createDataFrame([(None, "good")], "text string, label string"), LABELS)
    (row,) = weights.collect()
    assert row.term == "" and row.weights == pytest.approx([math.log(1 / 3)] * 3)
    scored = naivebayes.score_by_terms(spark.createDataFrame([(1, "a b")], "id int, content string"), weights, ["id"], LABELS)
    assert scored.first().scores == pytest.approx({y: 1 / 3 for y in LABELS})
    with pytest.raises(ValueError, match="smoothing"):
        naivebayes.term_log_odds(scored, smoothing=0)


def test_only_short_rows_are_shuffled(spark):
    texts = spark.range(10).select(F.col("id"), F.concat_ws(" ", F.lit("a b"), "id").alias("content"))
    weights = naivebayes.term_log_odds(spark.createDataFrame(ROWS, "text string, label string"), LABELS)
    plan = naivebayes.score_by_terms(texts, weights, ["id"], LABELS)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin.*__term", plan) and "CartesianProduct" not in plan


def largest_remainder(n, fractions):
    exact = [round(n * f, 6) for f in fractions]
    out = [math.floor(x) for x in exact]
    for k in sorted(range(len(exact)), key=lambda k: (-round(exact[k] - out[k], 6), k))[: n - sum(out)]:
        out[k] += 1
    return out


@pytest.mark.parametrize("fractions", [{"train": 0.8, "test": 0.2}, {"x": 1 / 3, "none": 0.0, "y": 1 / 3, "z": 1 / 3}])
def test_sizes_are_exact(spark, monkeypatch, fractions):
    monkeypatch.setattr(splits, "CELL_BITS", 4)  # many rows in a cell
    df = spark.range(1237).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5).alias("label"), F.lit(0).alias("n"))
    df = df.unionByName(spark.createDataFrame([(5000, 99, 0), (5001, 98, 0), (5002, 98, 0)], "k long, label long, n int"))
    names = list(fractions)
    for by in (None, "label"):
        rows = splits.exact_split(df.repartition(5), ["k"], fractions, by=by).collect()
        assert len(rows) == 1240
        groups = Counter(r[by] if by else "" for r in rows)
        for g, n in groups.items():
            sizes = Counter(r.split for r in rows if (r[by] if by else "") == g)
            assert [sizes[s] for s in names] == largest_remainder(n, list(fractions.values()))
        again = splits.exact_split(df.coalesce(1).orderBy(F.col("k").desc()), ["k"], fractions, by=by)
        assert {(r.k, r.split) for r in again.collect()} == {(r.k, r.split) for r in rows}
    other = splits.exact_split(df, ["k"], fractions, seed=1).collect()
    assert {(r.k, r.split) for r in other} != {(r.k, r.split) for r in splits.exact_split(df, ["k"], fractions).collect()}


def test_odd_splits(spark):
    empty = spark.createDataFrame([], "k long")
    assert splits.exact_split(empty, ["k"], {"a": 0.5, "b": 0.5}).collect() == []
    one = spark.createDataFrame([(1,)], "k long")
    assert [r.split for r in splits.exact_split(one, ["k"], {"a": 0.5, "b": 0.5}).collect()] == ["a"]
    for bad in ({"a": 0.5, "b": 0.6}, {"a": 1.0}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError, match="fractions"):
            splits.exact_split(one, ["k"], bad)


def test_no_window_over_all_rows(spark):
    plan = splits.exact_split(spark.range(100), ["id"], {"a": 0.5, "b": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan
