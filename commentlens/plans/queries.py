"""Every analysis as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.functions.cues import has_negation, is_blank
from commentlens.functions.cues import text_cues as cues
from commentlens.functions.labels import first_label, top_label
from commentlens.functions.times import parse_comment_time
from commentlens.operators import authors, dynamics, evaluation, impact, naivebayes, rows, splits, stance, subwords, textmodel, training, triage
from commentlens.plans import adapters as A
from commentlens.sources.ordinals import with_ord

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(make: Query) -> Query:
    REGISTRY[make.__name__] = make
    return make


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _spaced(df: DataFrame, *names: str) -> DataFrame:
    """Number arrays as text, which every engine compares alike."""
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), " ") for n in names})


# Dynamics


@query
def post_metrics(spark, sf):
    return dynamics.post_metrics(A.comments(spark, sf))


@query
def post_metrics_overall(spark, sf):
    return dynamics.overall_metrics(A.comments(spark, sf))


@query
def post_metrics_overall_compat(spark, sf):
    return dynamics.overall_metrics(A.comments(spark, sf), compat=True, last_post="view")


@query
def metrics_report(spark, sf):
    return dynamics.metrics_report(A.comments(spark, sf))


@query
def authors_by_sketch(spark, sf):
    """Distinct authors per post and overall, from sketches per post and hour."""
    hourly = authors.author_sketches(A.comments(spark, sf))
    overall = authors.merged(hourly).withColumn("post_id", F.lit(dynamics.OVERALL))
    return authors.counted(authors.merged(hourly, ["post_id"]).unionByName(overall))


@query
def authors_shared(spark, sf):
    """Authors that each post shares with the most commented one."""
    comments = A.comments(spark, sf)
    per_post = authors.merged(authors.author_sketches(comments), ["post_id"])
    counts = comments.groupBy("post_id").agg(F.count("*").alias("n"))
    largest = counts.agg(F.max_by("post_id", F.struct("n", "post_id"))).scalar()
    return authors.shared_authors(per_post, per_post.select("post_id", largest.alias("other")))


@query
def hourly_counts(spark, sf):
    return dynamics.hourly_counts(A.comments(spark, sf))


@query
def hourly_curve(spark, sf):
    return dynamics.hourly_curve(dynamics.hourly_counts(A.comments(spark, sf)))


@query
def event_timeline(spark, sf):
    timeline = dynamics.event_timeline(A.comments(spark, sf))
    return timeline.select("post_id", "ord", "ts", "offset_minutes")


@query
def comment_time_parse(spark, sf):
    """Both spellings, and values that are neither; read both ways."""
    spelled = (
        F.when(F.col("ord") % 11 == 0, "n/a")
        .when(F.col("ord") % 5 == 0, F.date_format("ts", "MM/dd/yy HH:mm"))
        .otherwise(F.date_format("ts", "MM/dd/yyyy hh:mm:ss a"))
    )
    return (
        A.comments(spark, sf)
        .select("post_id", "ord", spelled.alias("comment_at"))
        .withColumn("ts", parse_comment_time(F.col("comment_at")))
        .withColumn("ts_compat", parse_comment_time(F.col("comment_at"), compat=True))
    )


@query
def row_ordinals(spark, sf):
    return with_ord(A.comments(spark, sf).select("post_id", F.col("ord").alias("event_id")), "event_id")


@query
def distinct_authors(spark, sf):
    return rows.distinct_values(A.comments(spark, sf), "author")


# Stance


@query
def stance_distribution(spark, sf):
    """Without the leading row of every post."""
    numbered = with_ord(A.scored(spark, sf).select("post_id", "stance", F.col("ord").alias("doc_id")), "doc_id")
    return stance.stance_distribution(rows.drop_post_row(numbered))


def _stance_weights(spark, sf):
    labelled = A.annotated(spark, sf).select(F.col("content").alias("text"), F.col("validation").alias("label"))
    return naivebayes.term_log_odds(labelled)


@query
def stance_term_weights(spark, sf):
    """What naive Bayes learns from the human labels."""
    named = [F.round(F.col("weights")[k], 6).alias(n) for k, n in enumerate(("believes", "criticizes", "neutral"))]
    return _stance_weights(spark, sf).select("term", *named)


@query
def stance_scored(spark, sf):
    """Comments scored by the learned weights, as any batch model scores them."""
    texts = A.scored(spark, sf).select("post_id", "ord", "content")
    scorer = naivebayes.as_batch_scorer(_stance_weights(spark, sf))
    return rounded(stance.score_stance(texts, scorer).drop("content"), "confidence")


@query
def stance_by_terms(spark, sf):
    """The same scores, summed from joined weights."""
    texts = A.scored(spark, sf).select("post_id", "ord", "content")
    scored = naivebayes.score_by_terms(texts, _stance_weights(spark, sf), ["ord"])
    return rounded(stance.label_stance(scored).drop("content"), "confidence")


@query
def top_stance(spark, sf):
    """Best label of given scores, ties included; the first of all labels that reach a half."""
    names = F.array(*[F.lit(s) for s in C.STANCES])
    points = F.array(*[(F.col("ord") * m % 5) / 4.0 for m in (7, 3, 1)])
    scores = F.map_from_arrays(names, points)
    likely = F.filter(names, lambda s: F.try_element_at(scores, s) >= 0.5)
    best = top_label(scores, C.STANCES)
    return A.scored(spark, sf).select(
        "ord", best["label"].alias("stance"), best["score"].alias("confidence"),
        first_label(likely).alias("first_likely"),
    )


# Triage


@query
def text_cues(spark, sf):
    marked = cues(A.scored(spark, sf).select("post_id", "ord", "content"))
    marked = marked.withColumn("has_negation_word", has_negation(F.col("content"), whole_words=True))
    return marked.withColumn("blank", is_blank(F.col("content"))).drop("content")


def _uncertain(spark, sf):
    complete = rows.complete_rows(A.scored(spark, sf), ["content", "stance", "confidence"])
    return triage.explained(triage.uncertain(complete))


@query
def explained(spark, sf):
    return triage.explained(A.scored(spark, sf)).select("post_id", "ord", "stance", "explanation")


@query
def uncertain(spark, sf):
    return _uncertain(spark, sf)


@query
def suspects(spark, sf):
    return triage.suspects(_uncertain(spark, sf))


@query
def suspect_table(spark, sf):
    return triage.suspect_table(_uncertain(spark, sf).where(triage.is_suspect()))


@query
def triage_counts(spark, sf):
    complete = rows.complete_rows(A.scored(spark, sf), ["content", "stance", "confidence"])
    return triage.triage_counts(complete)


@query
def sarcasm_counts(spark, sf):
    return triage.sarcasm_counts(_uncertain(spark, sf))


@query
def stance_sarcasm_crosstab(spark, sf):
    """Every thirteenth comment is one that the detector failed on."""
    failed = F.when(F.col("ord") % 13 == 0, "error").otherwise(F.col("sarcasm_label"))
    judged = _uncertain(spark, sf).withColumn("sarcasm_label", failed)
    return triage.crosstab(judged, ["post_id", "stance"], "sarcasm_label", C.SARCASM_LABELS)


@query
def triage_scatter(spark, sf):
    return triage.triage_scatter(_uncertain(spark, sf))


def _sarcasm(spark, sf, compat):
    asked = triage.uncertain(A.scored(spark, sf)).select("post_id", "ord", "content")
    scored = triage.score_sarcasm(asked, A.counting_detector, compat=compat)
    return rounded(scored.drop("content"), "sarcasm_score")


@query
def sarcasm_scored(spark, sf):
    return _sarcasm(spark, sf, compat=False)


@query
def sarcasm_scored_compat(spark, sf):
    return _sarcasm(spark, sf, compat=True)


# Impact


def _impact(spark, sf, **options):
    return impact.impact_scores(
        rows.complete_rows(A.scored(spark, sf, timed=True), impact.INPUTS), **options
    )


@query
def impact_rows(spark, sf):
    measures = ("reactions_norm", "sub_comments_norm", "impact", "adjusted_impact")
    date = F.col("date").cast("string").alias("date")
    return rounded(
        _impact(spark, sf).select("post_id", "ord", "stance", "polarity", date, *measures), *measures
    )


@query
def comments_by_time(spark, sf):
    return rows.by_time(A.scored(spark, sf, timed=True).select("post_id", "ord", "ts", "stance"))


@query
def impact_daily(spark, sf):
    days = impact.daily_impact(_impact(spark, sf)).withColumn("date", F.col("date").cast("string"))
    return rounded(days, "adjusted_impact", "cumulative_impact")


@query
def impact_by_stance(spark, sf):
    return rounded(impact.impact_by_stance(_impact(spark, sf)), "mean_adjusted_impact")


@query
def impact_total(spark, sf):
    return rounded(impact.impact_total(_impact(spark, sf)), "impact_index")


@query
def impact_summary(spark, sf):
    return rounded(impact.impact_summary(_impact(spark, sf)), "impact_index")


@query
def impact_summary_compat(spark, sf):
    return rounded(impact.impact_summary(_impact(spark, sf, compat=True)), "impact_index")


def _top(spark, sf, weakening):
    # Excerpts are cut first: ranking then moves short rows.
    excerpts = impact.top_comment_table(_impact(spark, sf), extra=["post_id", "ord"])
    return rounded(impact.top_impact(excerpts, weakening=weakening), "adjusted_impact")


@query
def impact_top(spark, sf):
    return _top(spark, sf, weakening=False)


@query
def impact_top_weakening(spark, sf):
    return _top(spark, sf, weakening=True)


BOX = ("lowest", "q1", "median", "q3", "highest", "lower_fence", "upper_fence")


def _box(spark, sf, by):
    # A box takes several passes; the join behind the scores is made for the first one only.
    narrow = _impact(spark, sf).select("post_id", "stance", "ord", "adjusted_impact").persist()
    return rounded(impact.impact_box(narrow, by=by), *BOX)


@query
def impact_box(spark, sf):
    return _box(spark, sf, ["post_id", "stance"])


@query
def impact_box_by_stance(spark, sf):
    """Posts taken together: three groups, each with a third of all rows."""
    return _box(spark, sf, ["stance"])


@query
def impact_scatter(spark, sf):
    return rounded(impact.impact_scatter(_impact(spark, sf)), "adjusted_impact")


# Evaluation


@query
def confusion(spark, sf):
    return evaluation.confusion(A.annotated(spark, sf))


@query
def confusion_wide(spark, sf):
    wide = evaluation.confusion(A.annotated(spark, sf, complete=False), wide=True)
    return wide.withColumnsRenamed(
        {C.BELIEVES: "actual_believes", C.CRITICIZES: "actual_criticizes", C.NEUTRAL: "actual_neutral", "other": "actual_other"}
    )


@query
def annotation_metrics(spark, sf):
    metrics = evaluation.annotation_metrics(evaluation.confusion(A.annotated(spark, sf)))
    return rounded(metrics, *metrics.columns)


@query
def class_report(spark, sf):
    report = evaluation.class_report(evaluation.confusion(A.annotated(spark, sf)))
    return rounded(report, "precision", "recall", "f1")


@query
def validation_values(spark, sf):
    return evaluation.validation_values(A.annotated_files(spark, sf, C.ANNOTATED_ROWS))


@query
def missing_validation(spark, sf):
    return evaluation.missing_validation(A.annotated_files(spark, sf, C.ANNOTATED_ROWS)).select("post_id", "ord", "stance", "content")


@query
def gold_labels(spark, sf):
    return evaluation.gold_labels(A.annotated_files(spark, sf, C.ANNOTATED_ROWS))


# Training sets


@query
def training_set_a(spark, sf):
    return training.training_set_from_annotations(A.annotated_files(spark, sf))


@query
def training_set_b(spark, sf):
    gold = A.annotated(spark, sf, complete=False).select(
        "doc_id", F.col("content").alias("text"), F.col("validation").alias("stance")
    )
    return training.training_set_from_gold(gold, keep=["doc_id"])


@query
def training_parts(spark, sf):
    """Two sources of labelled text, one below the other."""
    annotated = A.annotated(spark, sf)
    human = annotated.select("doc_id", F.col("validation").alias("stance"))
    predicted = annotated.select("doc_id", "stance")
    return rows.union_parts(human, predicted)


@query
def split_counts(spark, sf):
    documents = A.annotated(spark, sf).select("doc_id", "validation")
    split = training.hash_split(documents, ["doc_id"], {"train": 0.8, "test": 0.2})
    return split.groupBy("split", "validation").agg(F.count("*").alias("n"))


@query
def exact_splits(spark, sf):
    """80/20 of all annotated documents, and 90/10 of those of each label."""
    documents = A.annotated(spark, sf).select("doc_id", "validation")
    overall = splits.exact_split(documents.select("doc_id"), ["doc_id"], {"train": 0.8, "test": 0.2}).withColumnRenamed("split", "overall")
    within = splits.exact_split(documents, ["doc_id"], {"train": 0.9, "test": 0.1}, seed=7, by="validation")
    return within.withColumnRenamed("split", "within_label").join(overall, "doc_id")


@query
def vocabulary(spark, sf):
    return training.build_vocabulary(A.table(spark, sf, "documents"))


@query
def fixed_length_encoding(spark, sf):
    documents = A.table(spark, sf, "documents").select("doc_id", "text")
    encoded = training.encode_fixed_length(documents, training.build_vocabulary(documents))
    return _spaced(encoded, "input_ids", "attention_mask")


#: Rounds and pairs a round of the subword queries.
SUBWORD_ROUNDS, SUBWORD_PAIRS = 6, 48


def _subwords(spark, sf):
    documents = A.table(spark, sf, "documents").select("text")
    return subwords.learn_subwords(documents, rounds=SUBWORD_ROUNDS, per_round=SUBWORD_PAIRS)


@query
def subword_vocabulary(spark, sf):
    return _subwords(spark, sf).vocabulary(spark)


@query
def subword_encoding(spark, sf):
    documents = A.table(spark, sf, "documents").select("doc_id", "text")
    return _spaced(subwords.encode_subwords(documents, _subwords(spark, sf)), "input_ids", "attention_mask")


@query
def subword_pair_encoding(spark, sf):
    """Content and human stance of annotated documents, in the short length."""
    annotated = A.annotated(spark, sf).select("doc_id", "content", "validation")
    model = _subwords(spark, sf)
    encoded = subwords.encode_subwords(annotated, model, length=C.ENCODED_LENGTH_SHORT, col="content", pair="validation")
    return _spaced(encoded, "input_ids", "attention_mask")


@query
def model_agreement(spark, sf):
    report = training.model_agreement(A.logits(spark, sf))
    return rounded(report, "cross_entropy", "kl_divergence", "loss")


def _labelled_texts(spark, sf):
    labelled = A.annotated(spark, sf).select(
        "doc_id", F.col("content").alias("text"), F.col("validation").alias("label")
    )
    return training.hash_split(labelled, ["doc_id"], {"train": 0.8, "test": 0.2})


@query
def text_term_weights(spark, sf):
    """TF-IDF weights of the labelled texts, as the text model sees them."""
    texts = A.annotated(spark, sf).select("doc_id", F.col("content").alias("text"))
    return rounded(textmodel.term_weights(texts, ["doc_id"]), "weight")


#: One fit serves all queries over the same tables of a session.
_FITTED: dict[tuple[str, str], PipelineModel] = {}
#: Largest derivatives of the mean loss, by a coefficient and by an intercept, that count as an optimum.
GRADIENT_TOLERANCE, INTERCEPT_TOLERANCE = 5e-3, 2e-2


def _fitted(spark, sf) -> PipelineModel:
    at = (spark.sparkContext.applicationId, sf)
    if at not in _FITTED:
        _FITTED[at] = textmodel.text_model().fit(_labelled_texts(spark, sf).where("split = 'train'"))
    return _FITTED[at]


@query
def text_model_certificate(spark, sf):
    """Whether the fitted coefficients are an optimum for the rows they were fitted to."""
    found = textmodel.certificate(_fitted(spark, sf), _labelled_texts(spark, sf).where("split = 'train'"))
    return found.select("n_rows", "n_terms", ((F.col("gradient") < GRADIENT_TOLERANCE) & (F.col("intercept_gradient") < INTERCEPT_TOLERANCE)).alias("at_optimum"))


@query
def text_model_report(spark, sf):
    """TF-IDF and logistic regression, judged on the part they have not seen."""
    predicted = _fitted(spark, sf).transform(_labelled_texts(spark, sf).where("split = 'test'"))
    confusion = evaluation.confusion(predicted, "predicted", "label")
    # A row for each pair of labels. Left to the optimizer, the report's own filter on them would run the model again, several times a row.
    counted = spark.createDataFrame(confusion.toArrow(), confusion.schema)
    report = evaluation.class_report(counted)
    return rounded(report, "precision", "recall", "f1")


@query
def text_model_stance(spark, sf):
    """The fitted model as scorer: stance and confidence of every document."""
    documents = A.table(spark, sf, "documents").select("doc_id", "text")
    labelled = stance.label_stance(textmodel.as_scorer(_fitted(spark, sf))(documents), content="text")
    return rounded(labelled.drop("text"), "confidence")
