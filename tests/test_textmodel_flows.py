import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens import schemas as S
from commentlens.operators import evaluation, stance, textmodel
from commentlens.plans import flows, queries
from commentlens.sources import readers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def texts(spark):
    good = ["what a lovely sunny day", "sunny day and lovely sea", "such a lovely warm sea"]
    bad = ["terrible cold rain again", "cold rain, terrible wind", "again a cold dark storm"]
    rows = [(t, label) for label, many in (("good", good), ("bad", bad)) for t in many * 4]
    return spark.createDataFrame(rows, "text string, label string")


@pytest.fixture(scope="module")
def model(texts):
    return textmodel.text_model(max_features=50).fit(texts)


def test_model_learns(model, texts):
    predicted = model.transform(texts)
    report = {r.label: r for r in evaluation.class_report(evaluation.confusion(predicted, "predicted", "label")).collect()}
    assert report["accuracy"].f1 == 1.0


def test_weights_are_smoothed_and_unit_length(model, spark):
    row = model.transform(spark.createDataFrame([("lovely cold sea a",)], "text string")).first()
    assert set(row.terms) == {"lovely", "cold", "sea", "lovely cold", "cold sea"}
    assert row.features.norm(2) == pytest.approx(1.0)


@pytest.mark.parametrize("three", [False, True])
def test_certificate_like_plain_gradient(texts, spark, three):
    if three:
        texts = texts.unionByName(spark.createDataFrame([("green tree leaves", "tree"), ("tall tree", "tree"), (None, "tree")], texts.schema))
    fits = [textmodel.text_model(max_features=50, max_iter=n).fit(texts.where("text IS NOT NULL")) for n in (1000, 2)]
    odd = texts.unionByName(spark.createDataFrame([("sunny", "unheard of"), ("sunny", None), (None, "good")], texts.schema))
    rows = [textmodel.certificate(m, odd).first() for m in fits]
    for m, row in zip(fits, rows):
        seen, classifier = m.transform(texts.where("text IS NOT NULL")).collect(), m.stages[-2]
        labels = m.stages[-1].getLabels()
        x = np.array([r.features.toArray() for r in seen])
        p, y = np.array([r.probability.toArray() for r in seen]), np.array([[r.label == k for k in labels] for r in seen], float)
        w = classifier.coefficientMatrix.toArray() if three else classifier.coefficientMatrix.toArray()[[-1]]
        g = ((p - y).T @ x / len(x))[-len(w) :] + w / len(x)
        assert (row.n_rows, row.n_terms) == x.shape
        assert row.gradient == pytest.approx(abs(g).max()) and row.gap == pytest.approx((g**2).sum() * len(x) / 2)
        assert row.intercept_gradient == pytest.approx(abs((p - y).mean(0)[-len(w) :]).max(), abs=1e-12)
        assert row.objective == pytest.approx(-np.log((p * y).sum(1)).mean() + (w**2).sum() / 2 / len(x))
    assert rows[0].gradient < min(3e-3, rows[1].gradient) and rows[0].objective < rows[1].objective
    assert rows[1].objective - rows[1].gap < rows[0].objective


def test_texts_are_split_once(model, texts):
    plan = model.transform(texts).select("prediction")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(text") == 1


def _plain_terms(texts, size):
    counts = Counter()
    for text in texts:
        words = re.findall(r"\b\w\w+\b", text.lower())
        counts.update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    return [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:size]]


@pytest.mark.parametrize("size", [3, 20, 45, 60, 5000])
def test_frequent_terms_like_plain_counts(spark, size):
    draw = np.random.default_rng(7)
    words = [f"w{k}" for k in range(30)] + ["a", "été", "ß_x", "0", "x9"]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = [", ".join(draw.choice(words, draw.integers(0, 40), p=odds / odds.sum())) for _ in range(200)] + ["", "W1", "a - 0", "W1 W0.", " W1\tw0"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    split = textmodel.RegexTokenizer(inputCol="text", outputCol="words", gaps=False, pattern=r"(?U)\w\w+").transform(df)
    assert textmodel.frequent_terms(split, size) == _plain_terms(texts, size)


@pytest.mark.parametrize(("texts", "size"), [(["aa bb cc dd ee ff gg hh"], 3), (["zz aa", "zz aa", "yy", "yy", "bb", "bb", "cc cc"], 2), ([" "], 4)])
def test_frequent_terms_where_many_are_equal(spark, texts, size):
    split = spark.createDataFrame([(t.split(),) for t in texts] + [(None,)], "words array<string>")
    assert textmodel.frequent_terms(split, size) == _plain_terms(texts, size)


def test_pairs_stay_within_their_text(monkeypatch):
    monkeypatch.setattr(textmodel, "_HELD", 2)
    texts = [["b", "a"], [], ["a", "x", "a", "b"], None, ["b"], ["a", "b", "b"], []]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.string()))], ["words"]) for t in (texts[:3], texts[3:], [], [None], [[]])]
    counted = Counter()
    for batch in textmodel._pair_counter(["a", "b"])(iter(batches)):
        for row in batch.to_pylist():
            counted[divmod(row["pair"], 2)] += row["n"]
    assert counted == {(1, 0): 1, (0, 1): 2, (1, 1): 1}
    words = Counter()
    for batch in textmodel._count_words(iter(batches)):
        for row in batch.to_pylist():
            words[row["token"]] += row["n"]
    assert words == {"a": 4, "b": 5, "x": 1}


def test_only_pairs_that_may_count_are_put_together(model, spark):
    row = model.transform(spark.createDataFrame([("rain lovely sea storm cold rain",)], "text string")).first()
    first, second = ({t.split(" ")[k] for t in model.stages[2].vocabulary if " " in t} for k in (0, 1))
    made = [t for t in row.terms if " " not in t or (t.split(" ")[0] in first and t.split(" ")[1] in second)]
    assert row.countable == made and {"lovely sea", "cold rain"} <= set(made) and "sea storm" not in made


def test_report_runs_the_model_once_a_row(spark, tmp_path):
    rows = [(k, f"{'lovely sunny' if k % 3 else 'cold rain'} day {k % 7}", "en" if k % 2 else None, "s", 1) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, k % 3, None if k % 5 == 0 else int(k % 4 == 0)) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    report = queries.text_model_report(spark, str(tmp_path))
    assert "UDF" not in report._jdf.queryExecution().optimizedPlan().toString()
    unseen = queries._labelled_texts(spark, str(tmp_path)).where("split = 'test'")
    seen = [(r.predicted, r.label) for r in queries._fitted(spark, str(tmp_path)).transform(unseen).collect()]
    assert len(seen) > 5
    got = {r.label: (r.recall, r.support) for r in report.collect()}
    for label in {actual for _, actual in seen}:
        own = [p == a for p, a in seen if a == label]
        assert got[label] == (round(sum(own) / len(own), 6), len(own))
    assert got["accuracy"][1] == len(seen)


def test_certificate_without_rows(model, texts):
    row = textmodel.certificate(model, texts.where("false")).first()
    assert row.n_rows == 0 and row.gradient is None


def test_model_as_scorer(model, spark):
    df = spark.createDataFrame([(0, "lovely sea"), (1, "cold storm"), (2, "")], "i int, text string")
    scored = textmodel.as_scorer(model)(df)
    assert scored.columns == ["i", "text", "scores"]
    assert all(sum(r.scores.values()) == pytest.approx(1.0) for r in scored.collect())
    labelled = stance.label_stance(scored, ["bad", "good"], content="text").orderBy("i").collect()
    assert [r.stance for r in labelled] == ["good", "bad", C.NEUTRAL]
    assert "PythonUDF" not in scored._jdf.queryExecution().toString()


HEADER = ",".join(S.POSTS)


def scorer():
    return lambda texts, hypotheses: [[0.5, 0.3, 0.2] if "real" in t else [0.1, 0.2, 0.7] for t in texts]


def detector():
    return lambda prompts: [("irony", 0.95) for _ in prompts]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_from_posts_to_impact(spark, tmp_path, fmt):
    (tmp_path / "posts").mkdir()
    for post in ("1", "2"):
        lines = [HEADER, f"0,,,,the post,,9,0,9,01/02/2024 07:04:10 PM"]
        lines += [f'{i},,,A{i},"it is\nreal {i}",,{i},1,0,01/0{1 + i}/2024 07:04:10 PM' for i in range(1, 6)]
        lines += ["7,,,A1,,,0,1,0,01/02/2024 08:04:10 PM", "8,,,A1,sure,,0,1,0,01/02/2024 08:04:10 PM"]
        (tmp_path / "posts" / f"{post}.csv").write_text("\n".join(lines) + "\n")
    posts, out = str(tmp_path / "posts" / "*.csv"), str(tmp_path / "classified")
    distribution = {(r.post_id, r.stance): r.n for r in flows.classify(spark, posts, out, scorer, fmt).collect()}
    assert distribution == {(p, s): n for p in "12" for s, n in ((C.BELIEVES, 5), (C.NEUTRAL, 2))}

    classified = readers.read_comments(spark, out, S.CLASSIFIED, fmt)
    assert classified.where("content is null").first().confidence == 0.0
    report, suspects = str(tmp_path / "report"), str(tmp_path / "suspects")
    triaged = flows.triage_classified(spark, classified, report, suspects, detector, fmt)
    assert {tuple(r) for r in triaged["counts"].select("post_id", "total", "uncertain", "suspect").collect()} == {
        ("1", 6, 5, 5), ("2", 6, 5, 5)}
    assert triaged["suspects"].count() == 10
    assert readers.read_comments(spark, suspects, S.REPORT, fmt).count() == 10

    impact = flows.measure_impact(readers.read_comments(spark, report, S.REPORT, fmt))
    assert {r.post_id: r.direction for r in impact["summary"].collect()} == {p: C.STRENGTHENING for p in "12"}
    assert impact["daily"].count() == 10
    assert {r.content[:5] for r in impact["strengthening"].collect()} == {"it is"}
    assert all(impact[name].count() for name in impact)

    curves = flows.measure_dynamics(spark, posts, str(tmp_path / "metrics"))
    assert curves["hourly_curve"].where("relative_n = 1").count() >= 2
    assert spark.read.json(str(tmp_path / "metrics")).count() == 3


def test_annotations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [",".join(S.ANNOTATION)] + [f"text {i},1,0,x,{C.STANCES[i % 3]},0.5,{C.STANCES[i % 2] if i < 40 else ''}" for i in range(50)]
    (tmp_path / "in" / "5.csv").write_text("\n".join(lines) + "\n")
    tables = flows.evaluate_annotations(spark, str(tmp_path / "in" / "*.csv"), str(tmp_path / "gold"))
    assert tables["confusion"].agg(F.sum("n")).first()[0] == 40
    assert tables["training_set"].count() == 50
    assert tables["missing"].count() == 0
    assert readers.read_gold(spark, str(tmp_path / "gold")).count() == 40
    assert tables["metrics"].count() == 1 and tables["class_report"].count() == 6
