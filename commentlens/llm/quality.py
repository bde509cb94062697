"""Quality rules: a decision list learned from labelled statistics by sequential covering, with DataFrame functions only.

A rule is a conjunction of thresholds on statistics of a text. It is grown on two thirds of the labelled rows, one condition
at a time by information gain, pruned on the other third, and kept while it is precise there; the rows it covers are set
aside and the next rule is grown. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.llm.common import WORD, settle, words

#: Labelled rows that rules are fitted to at most; of more, an even share by a hash of the id.
MAX_LABELLED = 200_000
#: Thresholds tried for each statistic are quantiles of the rows left, of either class: even steps, and finer ones in the tails.
SHARES = sorted({k / 16 for k in range(1, 16)} | {x for k in range(5, 11) for x in (2.0**-k, 1 - 2.0**-k)})
MIN_PRECISION = 0.95
MIN_COVERED = 3
#: Statistics that rules may use.
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share")

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column, n: int = 5) -> Column:
    """Words in windows of ``n`` words that occur twice or more. Windows are compared by 64-bit hashes within a text."""
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))

    def covered(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def twice(r: Column) -> Column:
            same = lambda x, i, to: F.coalesce(F.get(r, i + to)["g"] == x["g"], F.lit(False))
            at = F.filter(F.transform(r, lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"])), lambda i: i.isNotNull())
            return F.transform(F.array(F.array_sort(at)), lambda p: F.aggregate(
                F.transform(p, lambda i, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - i, F.lit(n)))), F.lit(0), lambda s, x: s + x
            ))[0]

        return F.transform(F.array(ranked), twice)[0]

    distinct = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))
    return F.when(F.size(w) <= n, F.lit(0)).otherwise(F.transform(F.array(grams), distinct)[0])


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    out = docs.drop(*_BASE).withColumn("__words", words(F.col("text"))).withColumn("__lines", lines)
    return out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
        }
    ).drop("__words", "__lines")


def _feature(name: str) -> Column:
    words_ = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words_,
        "symbols_per_word": F.col("n_symbols") / words_,
        "dup_line_share": F.col("n_dup_lines") / words_,
        "repeat_share": F.col("n_repeat_words") / words_,
    }[name]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = _feature(self.feature)
        return value >= self.threshold if self.above else value < self.threshold


Rule = list[Condition]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    found = rows.groupBy("bad").agg(*[F.percentile_approx(_feature(f), SHARES, 10_000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({v for row in found for v in row[f]}) for f in FEATURES}


def _reached(cuts: list[float], value: Column) -> Column:
    """How many of some thresholds a value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Adds the condition of most information gain until only bad rows are covered or nothing gains.

    Each condition leaves fewer good rows covered, so this ends.
    """
    rule: Rule = []
    while True:
        cells = [F.struct(F.lit(f).alias("f"), _reached(cuts[f], _feature(f)).alias("c")) for f in FEATURES]
        counted = rows.where(_all(rule)).select("bad", F.explode(F.array(*cells)).alias("x")).groupBy("x.f", "x.c")
        counts = {(f, c): (p, n) for f, c, p, n in counted.agg(F.sum("bad"), F.sum(1 - F.col("bad"))).collect()}
        total = [sum(v[k] for (f, _), v in counts.items() if f == FEATURES[0]) for k in (0, 1)]
        if not total[0] or not total[1]:
            return rule
        best = (0.0, None)
        for f in FEATURES:
            for k, cut in enumerate(cuts[f]):
                up = [sum(v[i] for (g, c), v in counts.items() if g == f and c > k) for i in (0, 1)]
                for above, (p, n) in ((True, up), (False, [total[0] - up[0], total[1] - up[1]])):
                    if p and n < total[1]:
                        gain = p * (math.log2(p / (p + n)) - math.log2(total[0] / sum(total)))
                        best = max(best, (gain, Condition(f, above, cut)), key=lambda x: x[0])
        if best[1] is None:
            return rule
        rule.append(best[1])


def _prune(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The beginning of a rule that does best on rows it wasn't grown on, with the bad and good rows that it covers there."""
    counts = rows.agg(*[f for k in range(1, len(rule) + 1) for f in (F.count_if(_all(rule[:k]) & (F.col("bad") == 1)), F.count_if(_all(rule[:k]) & (F.col("bad") == 0)))]).first()
    options = [(counts[2 * k], counts[2 * k + 1], k + 1) for k in range(len(rule))]
    p, n, length = max(options, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), x[0]))
    return rule[:length], p, n


def _share(doc_id: Column, share: float) -> Column:
    """Whether an id is in that share of all ids."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < int(share * (1 << 20))


def learn_rules(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules that cover bad rows, from statistics with a label ``bad`` (0 or 1; rows with another or no label are left out).

    Covering ends when a grown rule isn't precise on the rows held back; each rule sets aside MIN_COVERED of them or more. Each
    step counts in Spark and brings some hundred numbers to the driver. No bad or no good rows give no rules. Repeated label
    rows count as often as they occur.
    """
    rows = labelled.where(F.col("bad").isin(0, 1))
    total = rows.count()
    if total > max_labelled:
        rows = rows.where(_share(F.col("doc_id"), max_labelled / total))
    rows = settle(rows.select("bad", *_BASE, (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("held")))
    if rows.select("bad").distinct().count() < 2:
        return []
    rules: list[Rule] = []
    while True:
        rule = _grow(rows.where("not held"), _cuts(rows))
        if not rule:
            break
        rule, p, n = _prune(rule, rows.where("held"))
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        rows = rows.where(~_all(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule), F.lit(k)).otherwise(out)
    return out


def learn_from_labels(statistics: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for documents of quality 0, from statistics and labels of the same doc_id."""
    quality = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("__id"), (1 - F.col("quality")).alias("bad"))
    return learn_rules(statistics.join(quality, F.col("doc_id") == F.col("__id")))


def _to_learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and text of documents with a label, of about ``max_labelled`` ids at most; so many ids fit a broadcast."""
    ids = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    total = ids.count()
    if total > max_labelled:
        ids = ids.where(_share(F.col("__id"), max_labelled / total))
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi")


def judged(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, kept and rule (that covers the row)."""
    out = statistics.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select(*statistics.columns, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list rejects; their columns are unchanged.

    Null or empty texts have no words and are rejected. Labels without a document, and null labels, are not learned from;
    without usable labels only the base rules hold. Repeated rows are judged alike. No rows give no rows.
    """
    held = docs.select(*[F.col(c).alias(f"__doc_{k}") for k, c in enumerate(docs.columns)])
    at = {c: f"__doc_{k}" for k, c in enumerate(docs.columns)}
    with_text = held.withColumns({"text": F.col(at["text"]), "doc_id": F.col(at["doc_id"])})
    rules = learn_from_labels(text_statistics(_to_learn_from(docs, labels)).drop("text"), labels)
    # Statistics pass through a generator, or the filter below would be pushed into them and each computed many times.
    once = F.explode(F.array(F.struct(*_BASE))).alias("__statistics")
    known = text_statistics(with_text).select(*at.values(), once).select(*at.values(), "__statistics.*")
    return judged(known, rules).where("kept").select(*[F.col(v).alias(c) for c, v in at.items()])
