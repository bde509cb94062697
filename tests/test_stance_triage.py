import sys

import pytest
from pyspark import cloudpickle

from commentlens import constants as C
from commentlens.operators import stance as S
from commentlens.operators import triage as T
from commentlens.operators.rows import complete_rows, drop_post_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def word_scorer():
    def score(texts, hypotheses):
        assert hypotheses == [f"This comment {label}." for label in C.STANCES]
        assert all(t.strip() for t in texts)
        return [[0.6, 0.3, 0.1] if "yes" in t else [0.2, 0.4, 0.4] for t in texts]

    return score


def test_score_stance(spark):
    df = spark.createDataFrame([(0, "yes"), (1, "well"), (2, " \n"), (3, None)], "ord int, content string")
    got = S.score_stance(df, word_scorer).orderBy("ord")
    assert got.columns == ["ord", "content", "stance", "confidence"]
    assert [(r.stance, r.confidence) for r in got.collect()] == [
        (C.BELIEVES, 0.6), (C.CRITICIZES, 0.4), (C.NEUTRAL, 0.0), (C.NEUTRAL, 0.0),
    ]


def test_filter_on_the_score_runs_the_model_once(spark):
    df = spark.createDataFrame([(0, "yes")], "ord int, content string")
    plan = S.score_stance(df, word_scorer).where("confidence > 0.5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stance_distribution(spark):
    rows = [("p", i, s) for i, s in enumerate(["x", "b", "b", "c", None] + ["a"] * 29)]
    df = spark.createDataFrame(rows, "post_id string, ord int, stance string")
    got = S.stance_distribution(drop_post_row(df)).collect()
    assert [(r.stance, r.n) for r in got] == [("a", 29), ("b", 2), ("c", 1)]
    assert got[0].percentage == pytest.approx(87.88) and got[2].percentage == pytest.approx(3.03)
    halves = spark.createDataFrame([("p", 1, "a")] + [("p", 1, "b")] * 31, df.schema)
    assert {r.stance: r.percentage for r in S.stance_distribution(halves).collect()} == {"a": 3.12, "b": 96.88}


def classifier():
    def detect(prompts):
        assert all(p.startswith("detect sarcasm: ") for p in prompts)
        if any("boom" in p for p in prompts):
            raise RuntimeError("boom")
        return [("IRONY" if "haha" in p else "non_irony", 0.9) for p in prompts]

    return detect


def generator():
    return lambda prompts: [" Sarcastic \n" if "haha" in p else "normal" for p in prompts]


def short_answers():
    return lambda prompts: [("irony", 0.9)] if len(prompts) == 1 else []


@pytest.fixture
def asked(spark):
    rows = [(0, "haha"), (1, "plain"), (2, "boom"), (3, "x" * 508 + "haha"), (4, "x" * 509 + "haha")]
    return spark.createDataFrame(rows, "ord int, content string")


def scores(df):
    return [(r.sarcasm_label, pytest.approx(r.sarcasm_score)) for r in df.orderBy("ord").collect()]


def test_sarcasm_of_a_classifier(asked):
    assert scores(T.score_sarcasm(asked, classifier)) == [
        ("irony", 0.9), ("non_irony", 0.1), ("error", 0.0), ("irony", 0.9), ("non_irony", 0.1),
    ]
    assert scores(T.score_sarcasm(asked, classifier, compat=True))[1] == ("non_irony", 0.9)


def test_sarcasm_of_a_generator(asked):
    assert scores(T.score_sarcasm(asked, generator))[:2] == [("sarcastic", 1.0), ("normal", 0.0)]


def test_detector_that_loses_answers_is_asked_one_by_one(asked):
    assert scores(T.score_sarcasm(asked, short_answers)) == [("irony", 0.9)] * 5


@pytest.fixture
def triaged(spark):
    rows = [
        ("p", 1, "a!", C.NEUTRAL, 0.59, 0.71, "irony"), ("p", 2, "b", C.BELIEVES, 0.6, 0.9, "irony"),
        ("p", 3, "c", C.BELIEVES, 0.1, 0.7, "non_irony"), ("p", 4, "d", C.NEUTRAL, 0.3, 0.95, "non_irony"),
        ("p", 5, "e", C.NEUTRAL, 0.2, 0.95, "error"), ("q", 1, "f", C.BELIEVES, 0.9, None, None),
    ]
    return spark.createDataFrame(
        rows, "post_id string, ord int, content string, stance string, confidence double,"
        " sarcasm_score double, sarcasm_label string",
    )


def test_thresholds_are_strict(triaged):
    assert sorted(r.ord for r in T.uncertain(triaged).collect()) == [1, 3, 4, 5]
    assert [r.ord for r in T.suspects(triaged).collect()] == [4, 5, 1]


def test_counts(triaged):
    counts = {r.post_id: (r.total, r.uncertain, r.suspect) for r in T.triage_counts(triaged).collect()}
    assert counts == {"p": (5, 4, 3), "q": (1, 0, 0)}
    labels = [(r.post_id, r.sarcasm_label, r.n) for r in T.sarcasm_counts(triaged).collect()]
    assert labels == [("p", "irony", 2), ("p", "non_irony", 2), ("p", "error", 1)]
    table = T.crosstab(triaged, ["stance"], "sarcasm_label", C.SARCASM_LABELS).orderBy("stance").collect()
    by_stance = {r.stance: (r.irony, r.non_irony, r.other) for r in table}
    assert {k: sum(v) for k, v in by_stance.items()} == {r.stance: r["count"] for r in triaged.groupBy("stance").count().collect()}
    assert by_stance[C.BELIEVES][:2] == by_stance[C.NEUTRAL][:2] == (1, 1)


def test_tables(triaged):
    explained = T.explained(triaged)
    table = T.suspect_table(explained.where(T.is_suspect())).collect()
    assert [r.ord for r in table] == [5, 4, 1]
    assert table[0].explanation == C.AMBIGUOUS_TONE
    scatter = {(r.post_id, r.ord): r for r in T.triage_scatter(explained).collect()}
    assert scatter["p", 2].above_sarcasm and not scatter["p", 2].below_confidence and not scatter["p", 2].is_suspect
    assert scatter["p", 1].is_suspect


def test_complete_rows(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 1.0), ("a", None)], "content string, confidence double")
    assert complete_rows(df, ["content", "confidence"]).count() == 1


def test_a_bad_text_costs_few_calls(spark, tmp_path):
    """The detector notes every call; one of 2,000 texts makes it fail."""
    notes = str(tmp_path / "calls")

    def noting():
        def detect(prompts):
            with open(notes, "a") as f:
                f.write("x")
            if any("bad" in p for p in prompts):
                raise ValueError("unreadable")
            return [("irony", 0.5)] * len(prompts)

        return detect

    df = spark.range(2000).selectExpr("id", "if(id = 1234, 'bad', 'fine') as content").coalesce(1)
    scored = T.score_sarcasm(df, noting).groupBy("sarcasm_label").count().collect()
    assert {r.sarcasm_label: r["count"] for r in scored} == {"irony": 1999, "error": 1}
    assert len(open(notes).read()) < 30
