import random
import re
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.operators import subwords

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXTS = [
    None, "", " .,! ", "low lower lowest newest widest", "low low low new new", "aaaa aaa aa a", "Ünï ünïcode 日本語 日本 _x_ 12 123", "one" * 300, "abab abab ababab bababa", "low lower lowest newest widest",
]


def plain_rounds(texts, rounds, per_round, min_count=2):
    """Rounds worked out on lists, pair by pair in order; a pair is taken if nothing better overlaps it."""
    words = Counter(w for t in texts for w in re.findall(r"\w+", (t or "").lower()))
    split = {w: ["▁" + w[0], *w[1:]] for w in words}
    taken = []
    for _ in range(rounds):
        pairs = Counter()
        for w, n in words.items():
            for k in range(len(split[w]) - 1):
                pairs[split[w][k], split[w][k + 1]] += n
        order = sorted(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        free = []
        for k, (a, b) in enumerate(order):
            if pairs[a, b] >= min_count and a != b and not any(c == b or d == a for c, d in order[:k]):
                free.append((a, b))
        if not free[:per_round]:
            break
        taken.append({p: pairs[p] for p in free[:per_round]})
        for w, s in split.items():
            out, fresh = [], False
            for x in s:
                fresh = bool(out) and not fresh and (out[-1], x) in taken[-1]
                out = [*out[:-1], out[-1] + x] if fresh else [*out, x]
            split[w] = out
    return taken, split


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").repartition(3)


@pytest.mark.parametrize("per_round", [1, 3, 50])
def test_rounds_like_plain_ones(spark, per_round):
    r = random.Random(per_round)
    texts = TEXTS + [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(12)) for _ in range(6)]
    model = subwords.learn_subwords(frame(spark, texts), rounds=5, per_round=per_round)
    taken, split = plain_rounds(texts, 5, per_round)
    assert [list(x.items()) for x in model.rounds] == [list(x.items()) for x in taken]
    assert {w: model.symbols(w) for w in split} == split
    assert all("".join(model.symbols(w)) == "▁" + w for w in [*split, "never", "日本人"])


def test_vocabulary_is_numbered_after_the_marks(spark):
    model = subwords.learn_subwords(frame(spark, TEXTS), rounds=4)
    rows = sorted(model.vocabulary(spark).collect(), key=lambda r: r.token_id)
    assert [r.token_id for r in rows] == list(range(C.UNKNOWN_ID + 1, C.UNKNOWN_ID + 1 + len(rows)))
    assert len({r.token for r in rows}) == len(rows) and [r["round"] for r in rows] == sorted(r["round"] for r in rows)
    assert "▁low" in {r.token for r in rows}


def test_nothing_to_learn(spark):
    model = subwords.learn_subwords(frame(spark, [None, "", "..."]))
    assert model == subwords.Subwords({}, ()) and model.vocabulary(spark).count() == 0
    row = subwords.encode_subwords(frame(spark, ["abc d"]), model, length=8).first()
    assert row.input_ids == [0, 3, 3, 3, 3, 2, 1, 1] and row.attention_mask == [1] * 6 + [0] * 2


def plain_pair(a, b, room):
    """Cut a token at a time from the longer one, from the second if both are as long."""
    a, b = list(a), list(b)
    while len(a) + len(b) > room:
        (a if len(a) > len(b) else b).pop()
    return a, b


@pytest.mark.parametrize("length", [4, 5, 9, 12, 33])
def test_pairs_share_the_cut(spark, length):
    model = subwords.learn_subwords(frame(spark, TEXTS), rounds=3)
    ids = {token: k for token, _, _, k in model.entries()}
    of = lambda t: [ids.get(s, 3) for w in re.findall(r"\w+", (t or "").lower()) for s in model.symbols(w)]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in TEXTS for b in (None, "low", "zebra lower widest newest 日", "one" * 9))]
    pairs = spark.createDataFrame(rows, "id int, content string, stance string").withColumn("__a", F.lit("clash")).repartition(5)
    got = {r.id: r for r in subwords.encode_subwords(pairs, model, length, col="content", pair="stance", keep=["id"]).collect()}
    for k, a, b in rows:
        a, b = plain_pair(of(a), of(b), length - 4)
        want = [0, *a, 2, 2, *b, 2]
        assert got[k].input_ids == want + [1] * (length - len(want))
        assert got[k].attention_mask == [1] * len(want) + [0] * (length - len(want))
    alone = {r.id: r.input_ids for r in subwords.encode_subwords(frame(spark, TEXTS), model, length).collect()}
    for k, t in enumerate(TEXTS):
        want = [0, *of(t)[: length - 2], 2]
        assert alone[k] == want + [1] * (length - len(want))


def test_too_short_for_the_marks(spark):
    with pytest.raises(ValueError, match="length"):
        subwords.encode_subwords(frame(spark, ["a"]), subwords.Subwords({}, ()), 3, pair="text")


def test_encoding_shuffles_nothing(spark):
    plan = subwords.encode_subwords(spark.range(3).select(F.col("id").cast("string").alias("text")), subwords.Subwords({"a": 1}, ()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_pairs_leave_python_counted(spark, monkeypatch):
    words = spark.createDataFrame([("abab", 2), ("ab", 3), ("b", 5)], "word string, n bigint").coalesce(1)
    assert "ArrowEvalPython" not in (plan := subwords._counted(words, subwords.Subwords({}, ()), 2)._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" in plan
    want = {("▁a", "b"): 5, ("b", "a"): 2, ("a", "b"): 2}
    for held in (1, 2, 1000):
        monkeypatch.setattr(subwords, "REMEMBERED", held)
        assert {(r.a, r.b): r.n for r in subwords._counted(words, subwords.Subwords({}, ()), 2).collect()} == want
        assert {r.a: r.n for r in subwords._counted(words, subwords.Subwords({}, ()), 1).collect()} == {"▁a": 5, "b": 7 + 2, "a": 2, "▁b": 5}
