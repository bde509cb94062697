"""TF-IDF and logistic regression on MLlib."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.operators.training import frequent_tokens

#: Words that a task holds before it passes their counts on, and words asked for beyond those needed to find all that are frequent enough.
_HELD, _MORE = 2**21, 2
#: Rows that a task of the regression reads in every iteration, if more than a few tasks a core would be needed else.
_LEARNED = 50_000

#: Words, then pairs of neighbouring ones. As the argument of a lambda function words are split off once wherever the optimizer puts this.
_TERMS = """transform(array(words), w -> concat(w, zip_with(
    slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, size(w)), (a, b) -> concat(a, ' ', b))))[0]"""


def _countable(pairs: Sequence[str]) -> str:
    """Words, then those pairs of neighbouring ones whose words begin and end one of ``pairs``: few of all are ever put together."""
    if not pairs:
        return "words"
    # Words are letters, digits and the like: there is nothing to escape in them.
    first, second = (", ".join(sorted({f"'{p.split(' ')[k]}'" for p in pairs})) for k in (0, 1))
    return f"""transform(array(words), w -> concat(w, array_compact(transform(w, (a, i) ->
        if(a IN ({first}) AND get(w, i + 1) IN ({second}), concat(a, ' ', get(w, i + 1)), NULL)))))[0]"""


def _in_parts(arrays: Iterable, size: int) -> Iterator[list]:
    """The arrays in lists of ``size`` elements or a little more together; the last list may be shorter."""
    held, n = [], 0
    for array in arrays:
        held.append(array)
        n += len(array)
        if n >= size:
            yield held
            held, n = [], 0
    if n:
        yield held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, n for every part of the words."""
    for part in _in_parts((batch.column("words").flatten() for batch in batches), _HELD):
        counts = pc.value_counts(pa.chunked_array(part))
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["token", "n"])


def _pair_counter(words: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts pairs of neighbours that are both in ``words``, as pair (place of the first * number of words + place of the second), n."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = pa.array(words, pa.string())
        for batch in batches:
            texts = batch.column("words")
            found = pc.index_in(texts.flatten().cast(pa.string()), known)
            places = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype("int64")
            both = (places[:-1] >= 0) & (places[1:] >= 0)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
            both[ends[(ends > 0) & (ends < len(places))] - 1] = False  # a text's last word and the next one's first
            yield places[:-1][both] * len(words) + places[1:][both]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(pairs(batches), _HELD):
            pair, n = np.unique(np.concatenate(part), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return count


def frequent_terms(split: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent of words and pairs of neighbouring words, given an array column ``words``; equal ones alphabetically.

    A pair is no more frequent than either of its words, so only pairs of words that are as frequent as the word in place ``size`` are
    counted, by the places of their words. ``_MORE * size`` words at most come to the driver. Where more than these are that frequent,
    all terms are counted as they are.
    """
    spark = split.sparkSession
    texts = split.select("words")  # a batch of texts at a time goes to Python, which is far cheaper than a row a word
    words = texts.mapInArrow(_count_words, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.col("n").desc(), "token").limit(_MORE * size).collect()
    least = top[size - 1].n if len(top) >= size else 1
    if len(top) == _MORE * size and top[-1].n == least:
        return [r.token for r in frequent_tokens(split.selectExpr(f"{_TERMS} AS terms"), F.col("terms"), size).collect()]
    often = [r for r in top if r.n >= least]
    if not often:
        return []
    counter = _pair_counter([r.token for r in often])
    pairs = texts.mapInArrow(counter, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    singles = spark.createDataFrame([(k, r.token, r.n) for k, r in enumerate(often)], "place bigint, token string, n bigint")
    place = F.col("pair") % len(often)
    for name, at in (("second", place), ("first", (F.col("pair") - place) / len(often))):
        named = F.broadcast(singles.select(F.col("place").alias(f"{name}_at"), F.col("token").alias(name)))
        pairs = pairs.withColumn(f"{name}_at", at.cast("bigint")).join(named, f"{name}_at")
    terms = singles.select("token", "n").unionByName(pairs.select(F.concat("first", F.lit(" "), "second").alias("token"), "n"))
    return [r.token for r in terms.orderBy(F.col("n").desc(), "token").limit(size).collect()]


class TextModel(Estimator):
    """Fits a ``PipelineModel`` from ``text`` and a string ``label`` to ``predicted`` and ``probability``.

    Terms are words of two or more characters and pairs of neighbouring ones, the most frequent
    ``max_features`` of them. Inverse document frequencies carry the "+1" that MLlib leaves out.
    """

    def __init__(self, text: str, label: str, max_features: int, max_iter: int):
        super().__init__()
        self.text, self.label = text, label
        self.max_features, self.max_iter = max_features, max_iter

    def features(self, dataset: DataFrame) -> tuple[list, DataFrame, int]:
        """Stages from text to unit TF-IDF vectors, the term counts they rest on (persisted), how many rows.

        Rows are gathered once and kept on disk while their texts are split: for the words, for pairs of the frequent ones, for the counts.
        """
        kept = dataset.storageLevel
        if not (kept.useMemory or kept.useDisk):
            dataset = dataset.persist(StorageLevel.DISK_ONLY)
        # A run of word characters is taken whole, so that it needs no test of its ends.
        words = RegexTokenizer(inputCol=self.text, outputCol="words", gaps=False, toLowercase=True, pattern=r"(?U)\w\w+")
        # At most a few times max_features short strings come to the driver.
        vocabulary = frequent_terms(words.transform(dataset), self.max_features)
        countable = _countable([term for term in vocabulary if " " in term])
        terms = SQLTransformer(statement=f"SELECT *, {_TERMS} AS terms, {countable} AS countable FROM __THIS__")
        counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="countable", outputCol="counts")
        # Narrow and used by two fits; everything wide is left behind. Lost parts are computed again.
        others = [c for c in dataset.columns if c != self.text]
        rows = PipelineModel([words, terms, counter]).transform(dataset).select(*others, "counts").persist()
        idf = IDF(inputCol="counts", outputCol="unused").fit(rows)
        weights = ElementwiseProduct(
            inputCol="counts", outputCol="weighted", scalingVec=DenseVector(idf.idf.toArray() + 1.0)
        )
        unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
        if not (kept.useMemory or kept.useDisk):
            dataset.unpersist()
        return [words, terms, counter, weights, unit], rows, idf.numDocs

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages, rows, n = self.features(dataset.select(self.text, self.label))
        numbered = StringIndexer(
            inputCol=self.label, outputCol="target", stringOrderType="alphabetAsc"
        ).fit(rows)
        training = PipelineModel([numbered, *stages[-2:]]).transform(rows)
        # Every task sends a gradient of all coefficients in every iteration.
        tasks = max(2 * dataset.sparkSession.sparkContext.defaultParallelism, math.ceil(n / _LEARNED))
        classifier = LogisticRegression(
            featuresCol="features", labelCol="target", maxIter=self.max_iter, tol=C.TOLERANCE,
            regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
        ).fit(training.coalesce(tasks))
        rows.unpersist()
        named = IndexToString(inputCol="prediction", outputCol="predicted", labels=numbered.labels)
        return PipelineModel([*stages, classifier, named])


def text_model(
    max_features: int = C.MAX_FEATURES,
    max_iter: int = C.MAX_ITERATIONS,
    text: str = "text",
    label: str = "label",
) -> Estimator:
    return TextModel(text, label, max_features, max_iter)


def term_weights(df: DataFrame, keep: list[str], max_features: int = C.MAX_FEATURES, text: str = "text") -> DataFrame:
    """The TF-IDF weight of every term of every row: ``keep``, term, weight. Rows have unit length."""
    model = TextModel(text, "", max_features, 0)
    stages, rows, _ = model.features(df.select(*keep, text))
    counter = next(s for s in stages if isinstance(s, CountVectorizerModel))
    terms = df.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "at int, term string")  # max_features at most
    vectors = PipelineModel(stages[-2:]).transform(rows)
    each = vectors.select(*keep, F.posexplode(vector_to_array("features")).alias("at", "weight")).where("weight > 0")
    return each.join(terms, "at").select(*keep, "term", "weight")


def as_scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``scores`` (label to probability) without leaving the JVM."""
    labels = next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()

    def score(df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(name) for name in labels])
        scores = F.map_from_arrays(names, vector_to_array("probability"))
        return model.transform(df).select(*df.columns, scores.alias("scores"))

    return score


def certificate(model: PipelineModel, df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """How near a fitted ``text_model`` is to the optimum for the rows it was fitted to: one row.

    n_rows, n_terms, objective (mean loss and penalty), gradient, intercept_gradient (the largest absolute derivative by a coefficient and
    by an intercept), gap (the objective is above the least possible one by this at most, as far as coefficients go). Derivatives are sums of unit
    vectors, weighted by what was predicted and by what is true, gathered in one pass; nothing of the fit is taken for granted but the
    coefficients. Rows without a text or with an unknown label are left out, as by the fit; without rows there is no figure but their number.
    """
    classifier = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    names = next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()
    share, weights = vector_to_array(F.col("probability")), classifier.coefficientMatrix.toArray()
    if len(names) == 2:  # one row of coefficients, that of the second label
        weights = weights[[-1]]
    rows = model.transform(df.where(F.col(text).isNotNull() & F.col(label).isin(names)).select(text, label))
    first = len(names) - len(weights)
    own = sum((F.when(F.col(label) == name, share[k]).otherwise(0.0) for k, name in enumerate(names)), F.lit(0.0))
    every = rows.select("features", own.alias("own"), *[share[k].alias(f"p{k}") for k in range(len(names))], *[(F.col(label) == n).cast("double").alias(f"y{k}") for k, n in enumerate(names)])
    terms = weights.shape[1]
    schema = "n_rows bigint, n_terms bigint, objective double, gradient double, intercept_gradient double, gap double"
    if rows.isEmpty():  # a sum of no vectors has no size
        return df.sparkSession.createDataFrame([(0, terms, None, None, None, None)], schema)
    found = every.agg(
        F.count("*").alias("n"), F.sum(-F.log("own")).alias("loss"),
        *[Summarizer.sum(F.col("features"), F.col(f"{c}{k}")).alias(f"{c}x{k}") for c in "py" for k in range(first, len(names))],
        *[F.sum(f"{c}{k}").alias(f"{c}{k}") for c in "py" for k in range(first, len(names))],
    ).first()
    n = found["n"]
    penalty = classifier.getRegParam()
    slopes = [(found[f"px{k}"].toArray() - found[f"yx{k}"].toArray()) / n + penalty * weights[k - first] for k in range(first, len(names))]
    levels = [abs(found[f"p{k}"] - found[f"y{k}"]) / n for k in range(first, len(names))]
    objective = found["loss"] / n + penalty / 2 * float((weights**2).sum())
    steep = sum(float((s**2).sum()) for s in slopes)
    row = (n, terms, objective, max(float(abs(s).max()) if len(s) else 0.0 for s in slopes), max(levels), steep / (2 * penalty) if penalty else None)
    return df.sparkSession.createDataFrame([row], schema)
