from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import ODD
from pyspark.sql import functions as F

from commentlens.llm import alignment

FOLDER = Path("/opt/tokenizers")
A, B = str(FOLDER / "byte_bpe_50k.json"), str(FOLDER / "piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tokenizer files here")

TEXTS = [
    *ODD, (60, "a  double   space "), (61, " leading"), (62, "tab\t and\n line\r\n ends  \n"), (63, "<|endoftext|> and </s> [INST] <0x41>"), (64, "ünï 日本語 😂🙄  nbsp 　wide   line"),
    (65, "▁ a▁b ▁▁ c"), (66, "ﬁ ① Å é"), (67, "\x00 \x7f nul"), (68, "it's we'll don't 'tis 12 345 ... --- !!"), (69, " "), (69, "twice here"), (69, "twice here"), (None, "lost id"),
    (70, "日本語" * 4000), (71, "x" * 30_000 + " y"), (72, "same same same same"), (73, "\n\n\n"), (74, "   "),
]


def plain(rows, a, b):
    """Whole texts, token by token."""
    per = []
    for _, text in rows:
        ids = (a.encode([text])[0], b.encode([text])[0]) if text else None
        if not ids or any(b"".join(t.bytes[k] for k in x) != b" " + text.encode() for t, x in zip((a, b), ids)):
            per.append(None)
            continue
        covers = [[k for k in range(len(x)) for _ in range(len(t.bytes[x[k]]))] for t, x in zip((a, b), ids)]
        links = sorted(set(zip(*covers)))  # occurrences that share a byte
        cuts = [n for n in range(1, len(covers[0]) + 1) if all(n == len(c) or c[n] != c[n - 1] for c in covers)]
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[k]) for k in sorted(set(c[start:cut]))) for x, c in zip(ids, covers)))
            start = cut
        per.append((*map(len, ids), len(cuts), [(ids[0][i], ids[1][j]) for i, j in links], hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(pair for x in per if x for pair in set(x[3]))
    top = {}
    for (k, _), n in held.items():
        top[k] = max(top.get(k, 0), n)
    return sorted(
        [
            (i, *x[:3], len(x[3]), sum(held[p] == top[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4]) if x else (i, 0, 0, 0, 0, 0, 0, "")
            for (i, _), x in zip(rows, per)
        ],
        key=str,
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def both():
    return alignment.load(A), alignment.load(B)


def test_like_brute_force(spark, both):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n_a": F.lit("clash"), "slice": F.lit(1), "pair": F.lit(2)}).repartition(4)
    assert rows_of(alignment.align(docs, A, B)) == plain(TEXTS, *both)


def test_no_rows_and_no_tokens(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(alignment.align(docs, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_tokenizer_that_changes_texts(spark):
    docs = spark.createDataFrame([(1, "Upper Case"), (2, "lower case")], "doc_id long, text string")
    assert {r[1:] for r in rows_of(alignment.align(docs, str(FOLDER / "word_bpe_49k.json"), B))} == {(0, 0, 0, 0, 0, 0, "")}


def test_runs_give_the_tokens_of_whole_texts(both):
    aligner = alignment._Aligner(A, B)
    assert aligner.a.cuts and aligner.b.cuts and aligner.a.ranked
    r = random.Random(5)
    alphabet = [" ", " ", "  ", "\n", "\t", " ", "　", "a", "Be", "é", "日", "😂", "12", ".", "'s", "<", "▁", "\x1f", "\u0085", "ﬁ", "é", "</s>", "\x00"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 14)))
        parts = aligner.parts(text)
        assert " ".join(parts) == text
        for t in both:
            assert [k for ids in t.encode(parts) for k in ids] == t.encode([text])[0]
        aligner.a.ranked, fast = None, aligner.a.ranked
        assert aligner.a.encode([text]) == [fast.encode_ordinary(" " + text)]
        aligner.a.ranked = fast


def test_whole_texts_where_nothing_may_be_cut(both):
    cut, whole = alignment._Aligner(A, B), alignment._Aligner(A, B)
    whole.b.cuts = False
    texts = [t for _, t in TEXTS]
    some, other = cut.slice(texts), whole.slice(texts)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        assert some[name].tolist() == other[name].tolist()
    assert some["groups_sha256"] == other["groups_sha256"]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_pieces_of_the_merge(step):
    r = np.random.default_rng(step)
    for n in (1, 2, 5, 60, 400):
        cuts = [np.unique(np.append(r.integers(1, 3 * n + 2, n), 3 * n + 2)) for _ in range(2)]
        a, b = cuts if step % 2 else (cuts[0], cuts[0] if n == 60 else cuts[1])
        i, j = alignment.diagonals(a, b, step)
        assert ((np.diff(i) + np.diff(j))[:-1] == step).all() and (i[-1], j[-1]) == (len(a), len(b))
        ends = np.unique(np.concatenate([a, b]))
        at_a, at_b, closes = alignment.overlaps(a, b, step)
        assert at_a.tolist() == np.searchsorted(a, ends).tolist() and at_b.tolist() == np.searchsorted(b, ends).tolist()
        assert ends[closes].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert [x.tolist() for x in alignment.overlaps(np.empty(0, np.int64), np.empty(0, np.int64), step)] == [[], [], []]


def test_packed_numbers_come_back():
    for x in ([], [0], [5, 3, 3, 2**50, -1], list(range(1000))):
        assert alignment._unpack(alignment._pack(np.array(x, np.int64))).tolist() == x


def test_one_slice_or_many(spark, monkeypatch):
    texts = [(k, f"word{k % 7} and ünï{k % 3} again {k}") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(9)
    assert rows_of(alignment.align(docs, A, B)) == rows_of(alignment.align(docs.coalesce(1), A, B))


def test_clean_runs_go_to_the_tokenizer_as_one_text(both, monkeypatch):
    aligner, calls = alignment._Aligner(A, B), []
    monkeypatch.setattr(aligner.a, "encode", lambda parts: calls.append(parts) or both[0].encode(parts))
    aligner.learn(parts := [f"run{k}" for k in range(50)])
    assert calls == []
    ids, counts = aligner.tokens(np.array([aligner.known[x] for x in parts]), 0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == both[0].encode(parts)
    aligner.learn(odd := ["plain", " begins", "ends ", "more"])
    ids, counts = aligner.tokens(np.array([aligner.known[x] for x in odd]), 0)
    assert calls and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == both[0].encode(odd)


def test_forgotten_runs_are_met_again(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    few, many = alignment._Aligner(A, B), alignment._Aligner(A, B)
    monkeypatch.setattr(many, "forget", None)
    for k in range(4):
        texts = [f"a text of run{k}  and▁x", f" run{k - 1}  twice", None]
        monkeypatch.setattr(alignment, "REMEMBERED", 3)
        some = few.slice(texts)
        monkeypatch.setattr(alignment, "REMEMBERED", 10**6)
        other = many.slice(texts)
        assert some["n_links"].tolist() == other["n_links"].tolist() and some["groups_sha256"] == other["groups_sha256"]
