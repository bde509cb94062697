import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.operators import evaluation as E
from commentlens.operators import rows as R
from commentlens.operators import training as T

B, K, N = C.STANCES


@pytest.fixture
def annotated(spark):
    rows = [("p", 0, "a", B, B), ("p", 1, "b", B, K), ("p", 2, "c", K, None), ("p", 40, "d", N, None),
            ("p", 41, None, N, None), ("q", 39, "e", K, K), ("q", 50, "f", None, None)]
    return spark.createDataFrame(rows, "post_id string, ord int, content string, stance string, validation string")


def test_annotated_rows(annotated):
    assert sorted((r.post_id, r.ord) for r in E.annotated_rows(annotated).collect()) == [
        ("p", 0), ("p", 1), ("p", 2), ("q", 39)]
    assert [r.ord for r in E.missing_validation(annotated).collect()] == [2]
    assert E.gold_labels(annotated).where("text = 'b'").first().stance == K
    assert {r.validation for r in E.validation_values(annotated).collect()} == {B, K, None}


def test_confusion_keeps_every_row(annotated):
    long = E.confusion(E.annotated_rows(annotated))
    assert {(r.predicted, r.actual): r.n for r in long.collect()} == {(B, B): 1, (B, K): 1, (K, None): 1, (K, K): 1}
    wide = {r.predicted: (r[B], r[K], r[N]) for r in E.confusion(annotated, wide=True).collect()}
    assert wide[B] == (1, 1, 0) and wide[N] == (0, 0, 0)
    total = sum(r[B] + r[K] + r[N] + r.other for r in E.confusion(annotated, wide=True).collect())
    assert total == annotated.count()


def matrix(spark, cells):
    return spark.createDataFrame([(p, a, n) for (p, a), n in cells.items()], "predicted string, actual string, n long")


def test_annotation_metrics(spark):
    cells = {(B, B): 7, (B, K): 19, (B, N): 4, (K, B): 20, (K, K): 86, (K, N): 8, (N, B): 13, (N, K): 42, (N, N): 41}
    m = E.annotation_metrics(matrix(spark, cells)).first()
    assert m.false_negative_rate == pytest.approx(19 / 26)
    assert m.false_positive_rate == pytest.approx(20 / 106)
    assert m.accuracy == pytest.approx(93 / 240)
    assert (m.precision, m.recall) == (pytest.approx(7 / 27), pytest.approx(7 / 26))
    assert m.f1 == pytest.approx(2 * (7 / 27) * (7 / 26) / (7 / 27 + 7 / 26))
    assert (m.textbook_precision, m.textbook_recall) == (m.recall, m.precision)
    assert m.textbook_accuracy == pytest.approx(134 / 240)
    empty = E.annotation_metrics(matrix(spark, {(N, N): 1})).first()
    assert empty.precision is None and empty.f1 is None and empty.accuracy == 0.0


def test_class_report(spark):
    report = {r.label: r for r in E.class_report(matrix(spark, {("a", "a"): 3, ("a", "b"): 1, ("b", "a"): 2})).collect()}
    a, b = report["a"], report["b"]
    assert (a.precision, a.recall, a.support) == (0.75, 0.6, 5)
    assert (b.precision, b.recall, b.f1, b.support) == (0.0, 0.0, 0.0, 1)
    assert (report["accuracy"].f1, report["accuracy"].support) == (0.5, 6)
    assert report["macro avg"].precision == 0.375
    assert report["weighted avg"].recall == pytest.approx(0.5)
    # A label that is never predicted still has its line.
    never = {r.label for r in E.class_report(matrix(spark, {("a", "c"): 1})).collect()}
    assert never == {"a", "c", "accuracy", "macro avg", "weighted avg"}


def test_training_sets(annotated, spark):
    a = {(r.post_id, r.ord): (r.stance, r.labels) for r in T.training_set_from_annotations(annotated).collect()}
    assert a == {("p", 0): (B, 0), ("p", 1): (K, 2), ("p", 40): (N, 1), ("q", 39): (K, 2)}
    gold = spark.createDataFrame([("x", B), ("y", "odd"), (None, N), ("z", K), ("w", None)], "text string, stance string")
    assert {(r.text, r.label) for r in T.training_set_from_gold(gold).collect()} == {("x", 0), ("z", 1)}


def test_union_parts(spark):
    one, two = spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([("a", 1)], "y string, x int")
    assert [tuple(r) for r in R.union_parts(one, two).collect()] == [(1, "a"), (1, "a")]
    with pytest.raises(ValueError, match="no part"):
        R.union_parts()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), share=st.sampled_from([0.0, 0.1, 0.5, 0.8, 1.0]))
def test_split_is_complete_disjoint_and_repeatable(spark, seed, share):
    fractions = {"train": share, "test": 1 - share}
    df = spark.range(2000)
    first = {r.id: r.split for r in T.hash_split(df, ["id"], fractions, seed).collect()}
    again = {r.id: r.split for r in T.hash_split(df.repartition(3), ["id"], fractions, seed).collect()}
    assert first == again and len(first) == 2000
    assert sum(s == "train" for s in first.values()) == pytest.approx(2000 * share, abs=120)


def test_split_fractions_must_add_up(spark):
    with pytest.raises(ValueError):
        T.hash_split(spark.range(1), ["id"], {"train": 0.8, "test": 0.1})


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(0, "b a A, b_1 è"), (1, "a " * 20), (2, None), (3, "zzz!")], "i int, text string")
    vocab = T.build_vocabulary(df, size=3)
    assert [(r.token, r.n, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("a", 22, 4), ("b", 1, 5), ("b_1", 1, 6)]
    for lookup in (False, True):
        encoded = T.encode_fixed_length(df, vocab, length=8, lookup=lookup)
        assert encoded.columns == ["i", "input_ids", "attention_mask"]
        rows = {r.i: (r.input_ids, r.attention_mask) for r in encoded.collect()}
        assert rows[0] == ([0, 5, 4, 4, 6, 3, 2, 1], [1] * 7 + [0])
        assert rows[1] == ([0] + [4] * 6 + [2], [1] * 8)
        assert rows[2] == ([0, 2] + [1] * 6, [1, 1] + [0] * 6)
        assert rows[3][0][1] == 3
    assert T.build_vocabulary(df).count() == 5


def test_encoding_does_not_copy_the_table_into_rows(spark):
    df = spark.createDataFrame([(0, "a b")], "i int, text string")
    plan = T.encode_fixed_length(df, T.build_vocabulary(df, size=9), lookup=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "__lookup" not in plan
    assert "Generate" not in plan.split("scalar-subquery")[0]


def test_model_agreement(spark):
    rows = [([1.0, 0.0, -1.0], [0.5, 0.5, 0.0], 0), ([2.0, 1.0, 0.0], [2.0, 1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "teacher array<double>, student array<double>, labels int")
    got = T.model_agreement(df).first()

    def softmax(xs, t):
        es = [math.exp(x / t) for x in xs]
        return [e / sum(es) for e in es]

    kl = [4 * sum(p * math.log(p / q) for p, q in zip(softmax(t, 2), softmax(s, 2))) for t, s, _ in rows]
    ce = [-math.log(softmax(s, 1)[label]) for _, s, label in rows]
    assert got.kl_divergence == pytest.approx(sum(kl) / 2)
    assert got.cross_entropy == pytest.approx(sum(ce) / 2)
    assert got.loss == pytest.approx((got.kl_divergence + got.cross_entropy) / 2)
    assert T.model_agreement(df, by=["labels"]).count() == 2


def test_known_and_distinct(spark):
    df = spark.createDataFrame([(B,), ("odd",), (None,), (B,)], "stance string")
    assert R.known_labels(df, C.STANCES).count() == 2
    assert R.distinct_values(df, "stance").count() == 3
    assert T.override_label(df.withColumns({"ord": F.lit(50), "validation": F.lit(N)})).first().stance == B
