"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import helpers as H
from commentlens.llm import quality
from commentlens.llm.common import words
from commentlens.llm.queries import ORACLES, REGISTRY

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = REGISTRY[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want, key=key)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rules = quality.learn_from_labels(quality.text_statistics(docs).drop("text"), spark.read.parquet(f"{SF}/labels.parquet"))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def good(text):
        n, chars, symbols, dups, repeats = H.statistics(text)
        values = dict(zip(quality.FEATURES, (n, chars / max(n, 1), symbols / max(n, 1), dups / max(n, 1), repeats / max(n, 1)), strict=True))
        rejected = any(all((values[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)
        return n >= 10 and 100 * repeats <= 20 * n and not rejected

    kept, stage_docs = rows, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, stage_docs, SF)
        if name == "source mix":
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        stage_docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "quality rules":
            kept = {i: t for i, t in kept.items() if good(t)}
        elif name == "line dedup":
            left = H.without_recurring_lines(list(kept.items()))
            kept = {i: t for i, t in left.items() if t == kept[i] or len(H.words(t)) >= corpus_pipeline.MIN_WORDS}
        elif name == "n-gram Jaccard join":
            root = H.components(list(kept.items()))
            kept = {i: t for i, t in kept.items() if root[i] == i}
        elif name == "benchmark decontamination":
            kept = {i: t for i, t in kept.items() if not any(H.leaks(t, item) for item in items)}
        assert {r.doc_id: r.text for r in stage_docs.collect()} == kept, name
        assert stage_docs.where(F.length("text") != F.col("n_chars")).isEmpty()
    sizes = {i: len(H.words(t)) for i, t in kept.items()}
    taken = [(r.doc_id, r.size) for r in out.collect()]
    assert all(sizes[i] == n for i, n in taken)
    assert sum(n for _, n in taken) <= 1.5 * sum(sizes.values()) < sum(n for _, n in taken) + max(sizes.values())


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, extra columns: no stage fails, and columns pass."""
    rows = [(i, t, f"s{i % 2}" if i % 5 else None, 0, 1) for i, t in H.ODD] * 2 + [(None, "ten words make up this row without any id today", None, None, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, template int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
    mixed = corpus_pipeline.source_mix(spark, docs, SF)
    assert mixed.count() > 0 and set(docs.columns) < set(mixed.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_keep_one(spark):
    one, two = "a b c d e f g", "h i j k l m"
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(3, one), (1, one), (1, one), (2, two), (2, near), (None, near + " x"), (None, near + " y"), (None, "some text of its own kind")]
    want = {(1, one), (2, two), (2, near), (None, "some text of its own kind"), (5, None), (6, "")}
    docs = spark.createDataFrame([*rows, (5, None), (6, "")], "doc_id long, text string")
    for parts in (1, 3):
        got = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SF).collect()
        assert len(got) == len(want) and {(r.doc_id, r.text) for r in got} == want


def test_emptied_documents_go(spark):
    """Copies of which nothing is left go, and what lost nothing stays, be it short or empty."""
    text = "\n".join(f"line {'abcdefgh'[k] * 3} of this text has just nine words" for k in range(4))
    rows = [(k, text) for k in range(6)] + [(10, "short"), (11, ""), (12, None)] + [(20, text + "\n" + " ".join("own" * k for k in range(1, 13)))]
    got = corpus_pipeline.line_templates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r.doc_id for r in got) == [0, 10, 11, 12, 20]


def test_words_of_a_text(spark):
    rows = [(i, t) for i, t in H.ODD]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", words(F.col("text")).alias("w")).collect()
    assert {r.doc_id: r.w for r in got} == {i: H.words(t) for i, t in rows}
