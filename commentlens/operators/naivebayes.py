"""Multinomial naive Bayes in closed form: a table of term weights per label, joined to the terms of texts and summed.

Nothing is iterated or sampled: the same rows give the same weights, whatever their order, and any engine can repeat them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.operators.training import frequent_tokens, tokens

#: The row of ``term_log_odds`` that holds the labels' own weights; no token is empty.
PRIOR = ""


def term_log_odds(
    df: DataFrame, labels: Sequence[str] = C.STANCES, text: str = "text", label: str = "label", max_features: int = C.MAX_FEATURES, smoothing: float = 1.0
) -> DataFrame:
    """term, weights (an array of doubles, one a label): the log probability of a term under each label, ``smoothing`` added to every count.

    The most frequent ``max_features`` tokens count, equal ones alphabetically, and one row more, of term ``PRIOR``, for the labels
    themselves. Rows without text or with another label are not learned from. Without rows all labels weigh the same.
    """
    if smoothing <= 0:
        raise ValueError("smoothing must be above 0")
    rows = df.where(F.col(text).isNotNull() & F.col(label).isin(*labels)).select(F.col(label).alias("label"), tokens(F.col(text)).alias("words"))
    top = frequent_tokens(rows, F.col("words"), max_features).select("token")

    def per_label(n: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("label") == name, n).otherwise(0)) for name in labels])

    used = rows.select("label", F.explode_outer("words").alias("token")).where("token IS NOT NULL").groupBy("label", "token").agg(F.count("*").alias("n"))
    counts = used.join(F.broadcast(top), "token").groupBy("token").agg(per_label(F.col("n")).alias("n"))

    def logs(counted: DataFrame, totals: Column, cells: Column | int) -> DataFrame:
        """Log shares of each label's counts, given how many cells share what is smoothed."""
        sized = counted.withColumns({"__totals": totals, "__cells": cells if isinstance(cells, Column) else F.lit(cells)})
        log = [F.log((F.col("n")[k] + smoothing) / (F.coalesce(F.col("__totals")[k], F.lit(0)) + smoothing * F.col("__cells"))) for k in range(len(labels))]
        return sized.select(F.col("token").alias("term"), F.array(*log).alias("weights"))

    per_term = counts.agg(F.array(*[F.sum(F.col("n")[k]) for k in range(len(labels))])).scalar()
    held = rows.agg(per_label(F.lit(1)).alias("n")).select(F.lit(PRIOR).alias("token"), F.transform("n", lambda x: F.coalesce(x, F.lit(0))).alias("n"))
    all_rows = sum((F.col("n")[k] for k in range(1, len(labels))), F.col("n")[0])
    terms = logs(counts, per_term, counts.agg(F.count("*")).scalar())
    return terms.unionByName(logs(held, F.array_repeat(all_rows, len(labels)), len(labels)))


def _shares(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def score_by_terms(df: DataFrame, weights: DataFrame, key: Sequence[str], labels: Sequence[str] = C.STANCES, content: str = "content", bounded: bool = True) -> DataFrame:
    """Add ``scores``, a map from label to probability, to every row; ``key`` tells rows apart.

    A row's terms meet their weights and are summed again before they are shuffled, so that one short row a text travels. Terms without
    weights don't count; a text without any has the labels' own shares. ``bounded`` says that ``weights`` are as few as a
    ``max_features`` allows and may be broadcast; else they are joined by term. Rows of equal key have all their terms summed: make the key unique.
    Rows that lack a key value have scores, too.
    """
    own = weights.where(F.col("term") == PRIOR).select("weights").scalar()
    known = weights.where(F.col("term") != PRIOR).select(F.col("term").alias("__term"), F.col("weights").alias("__weights"))
    known = F.broadcast(known) if bounded else known
    names = [f"__key{k}" for k in range(len(key))]
    spread = df.select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], F.explode_outer(tokens(F.col(content))).alias("__term"))
    sums = [F.sum(F.col("__weights")[k]).alias(f"__sum{k}") for k in range(len(labels))]
    summed = spread.where("__term IS NOT NULL").join(known, "__term").groupBy(*names).agg(*sums)
    same = F.lit(True)
    for c, n in zip(key, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    total = F.array(*[F.coalesce(F.col(f"__sum{k}"), F.lit(0.0)) for k in range(len(labels))])
    joined = df.join(summed, same, "left").withColumns({"__total": total, "__own": own}).withColumn("__logs", F.zip_with("__total", "__own", lambda x, y: x + y))
    shares = F.map_from_arrays(F.array(*map(F.lit, labels)), _shares(F.col("__logs")))
    return joined.select(*df.columns, shares.alias("scores"))


def as_batch_scorer(weights: DataFrame, labels: Sequence[str] = C.STANCES, template: str = C.HYPOTHESIS_TEMPLATE) -> Callable[[], Callable]:
    """The same model as a scorer for ``stance.score_text``: ``max_features`` rows of weights travel to the tasks."""
    table = {r.term: list(r.weights) for r in weights.collect()}
    places = {template.format(name): k for k, name in enumerate(labels)}

    def factory():
        word = re.compile(r"\w+")

        def score(texts: list[str], hypotheses: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                found = [table[t] for t in word.findall(text.lower()) if t in table]
                logs = [own + math.fsum(w[k] for w in found) for k, own in enumerate(table[PRIOR])]
                powers = [math.exp(x - max(logs)) for x in logs]
                out.append([powers[places[h]] / math.fsum(powers) for h in hypotheses])
            return out

        return score

    return factory
