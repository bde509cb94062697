from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD
from pyspark.sql import functions as F

from commentlens.llm import spelling


def plain_near(a, b):
    """Deleting one letter of either, or the same place of both, makes them equal."""
    cut = lambda w: [w[:k] + w[k + 1 :] for k in range(len(w))]
    return a != b and (b in cut(a) or a in cut(b) or (len(a) == len(b) and any(x == y for x, y in zip(cut(a), cut(b)))))


def plain_forms(counts, ratio=5):
    near = {w: [v for v in counts if plain_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def plain_runs(text):
    out, run = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def answer(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(seed, size, letters="abcdeéÿ"):
    r = random.Random(seed)
    out = {}
    while len(out) < size:
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
        out[w] = r.choice([5, 6, 30, 150, 151, 900])
    return out


@pytest.mark.parametrize("subtrie,visitors", [(32_768, 65_536), (8, 40)])
def test_forms_like_brute_force(spark, monkeypatch, subtrie, visitors):
    monkeypatch.setattr(spelling, "SUBTRIE", subtrie)  # small: all levels of the trie, tiles and portions
    monkeypatch.setattr(spelling, "VISITORS", visitors)
    counts = variants(1, 150) | {"q" * 400: 9, "q" * 401: 90, "日本語です": 5, "日本語でス": 40, "listen": 5, "silent": 7, "tinsel": 8}
    assert answer(spelling.variant_forms(words_of(spark, counts))) == plain_forms(counts)


def test_chains_ties_and_extra_columns(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaaaba": 25, "zzzzzz": 1, "zzzzz": 4}
    rows = words_of(spark, counts).withColumns({"vec": F.lit("x"), "node": F.lit(1), "part": F.lit(2), "form": F.lit("f")})
    got = {r.word: r for r in spelling.variant_forms(rows).collect()}
    assert (got["aaaaaa"].form, got["aaaaaa"].root, got["aaaaaa"].form_n) == ("aaaaab", "aaaabb", 25)  # a tie: the smaller word
    assert (got["zzzzzz"].form, got["zzzzzz"].root, got["zzzzzz"].n_near) == (None, "zzzzzz", 1)  # below five times


def test_no_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variant_forms(empty).collect() == []
    odd = spark.createDataFrame([(None, 5), ("", 6), ("a", 7)], "word string, n long")
    assert answer(spelling.variant_forms(odd.where("word IS NOT NULL"))) == [("", None, "", 6, 0, None), ("a", None, "a", 7, 0, None)]
    with pytest.raises(ValueError):
        spelling.variant_forms(empty, ratio=1)


def test_null_word(spark):
    odd = spark.createDataFrame([(None, 5), ("ab", 6)], "word string, n long")
    assert sorted(map(tuple, spelling.variant_forms(odd).collect()), key=str) == [("ab", None, "ab", 6, 0, None), (None, None, None, 5, 0, None)]


def test_counts_of_odd_texts(spark):
    texts = [*ODD, (50, "Ünïted ÀÿX×y÷z it's A1b2 Ā¿ ñ日本a"), (50, "Ünïted ÀÿX×y÷z it's A1b2 Ā¿ ñ日本a"), (None, "Lost Id"), (51, "É" * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash")).repartition(4)
    for every in (None, 3):
        expected = Counter()
        for i, text in texts:
            for run in plain_runs(text):
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                expected[run[:at] + run[at + 1 :] if every and h % every == 0 else run] += 1
        got = {r.word: r.n for r in spelling.word_counts(docs, slip_every=every).collect()}
        assert got == dict(expected)
    assert spelling.word_counts(docs.where("false")).collect() == []


def test_trie_reaches_all_within_budget():
    r = np.random.default_rng(3)
    members, visitors = (r.integers(0, 3, (n, spelling.GROUPS)).astype(np.int8) for n in (300, 40))
    members[:40] = visitors
    members[:40, 2] += 1
    members = members[np.lexsort(members.T[::-1])]
    found = {(int(v), m) for here, low, high in spelling.reached(members, visitors) for v in here for m in range(low, high)}
    more = visitors[:, None] - members[None]
    fits = (np.maximum(more, 0).sum(2) <= 1) & (np.maximum(-more, 0).sum(2) <= 1)
    assert fits.sum() >= 40 and {(int(a), int(b)) for a, b in np.argwhere(fits)} <= found
    assert (spelling._unpacked(spelling._packed(members)) == members).all()
    assert (spelling._within_budget(spelling._packed(visitors)[:, None], spelling._packed(members)[None]) >= fits).all()
