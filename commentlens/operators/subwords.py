"""Subword vocabularies learned from a corpus, and fixed-length encodings with them, of one text or of two.

Learning joins the most frequent neighbouring symbols of words, round by round, on a table of distinct words with their counts. A round
joins several pairs at once: those that no better pair overlaps, so that the order within a round doesn't matter. The pairs learned
are as many as parameters say and travel to the tasks; words and texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlens import constants as C
from commentlens.operators.training import tokens

#: Marks the symbol that begins a word.
START = "▁"
ROUNDS, PAIRS_PER_ROUND = 12, 64
#: Words whose symbols a task remembers, and pairs that it counts before it passes them on.
REMEMBERED = 100_000

Round = dict[tuple[str, str], int]


def letters(word: str) -> list[str]:
    """The symbols that a word begins with: its characters, the first one marked."""
    return [START + word[0], *word[1:]]


def joined(symbols: list[str], pairs: Round) -> list[str]:
    """Symbols with one round's pairs joined; these never overlap."""
    out, k = [], 0
    while k < len(symbols):
        if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) in pairs:
            out.append(symbols[k] + symbols[k + 1])
            k += 2
        else:
            out.append(symbols[k])
            k += 1
    return out


@dataclass(frozen=True)
class Subwords:
    """What was learned: the symbols of single letters with their counts, most frequent first, and the pairs of every round with theirs."""

    alphabet: dict[str, int]
    rounds: tuple[Round, ...]

    def symbols(self, word: str) -> list[str]:
        """A word as the rounds leave it. Of letters that were not there to learn from, each stands alone."""
        out = letters(word)
        for pairs in self.rounds:
            if len(out) == 1:
                break
            out = joined(out, pairs)
        return out

    def entries(self) -> list[tuple[str, int, int, int]]:
        """(token, n, round, token_id): letters first, then what the rounds joined; numbered after the marks.

        A token that several pairs make is numbered where it first comes up.
        """
        every = [(s, n, 0) for s, n in self.alphabet.items()]
        every += [(a + b, n, r) for r, pairs in enumerate(self.rounds, 1) for (a, b), n in pairs.items()]
        first: dict[str, tuple[int, int]] = {}
        for token, n, r in every:
            first.setdefault(token, (n, r))
        return [(token, n, r, C.UNKNOWN_ID + 1 + k) for k, (token, (n, r)) in enumerate(first.items())]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries(), "token string, n bigint, round int, token_id int")


def _counted(words: DataFrame, model: Subwords, width: int) -> DataFrame:
    """How often symbols (``width`` 1: a) or pairs of neighbouring ones (2: a, b) occur in words that each count ``n`` times.

    Words are counted as they are split: what leaves Python is a row for each symbol or pair and ``REMEMBERED`` of them at a time, which is also the most that a
    task holds.
    """
    names = ["a", "b"][:width]
    schema = pa.schema([*[(c, pa.string()) for c in names], ("n", pa.int64())])

    def rows(found: dict[tuple[str, ...], int]) -> pa.RecordBatch:
        columns = zip(*found) if found else [()] * width
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array(found.values(), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, ...], int] = {}
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                symbols = model.symbols(word)
                for key in zip(symbols, symbols[1:]) if width == 2 else zip(symbols):
                    found[key] = found.get(key, 0) + n
                if len(found) >= REMEMBERED:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    counted = words.select("word", "n").mapInArrow(count, ", ".join([*[f"{c} string" for c in names], "n bigint"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("n"))


def learn_subwords(df: DataFrame, col: str = "text", rounds: int = ROUNDS, per_round: int = PAIRS_PER_ROUND, min_count: int = 2) -> Subwords:
    """Learn from the words of a text column, in ``rounds`` rounds of ``per_round`` pairs at most.

    Pairs are ordered by how often they occur, equal ones by their symbols. A round takes, in this order, pairs of ``min_count`` or more
    that overlap no better one: the right symbol of one is never the left symbol of the other. A pair of equal symbols overlaps itself and is
    never joined. Every distinct word is split again in each round; what comes to the driver is the alphabet and the pairs taken.
    Null and empty texts have no words; without words nothing is learned.
    """
    words = (
        df.select(F.explode_outer(tokens(F.col(col))).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).persist()
    )
    try:
        first = _counted(words, Subwords({}, ()), 1)
        alphabet = {r.a: r.n for r in first.orderBy(F.col("n").desc(), "a").toLocalIterator()}
        taken: list[Round] = []
        for _ in range(rounds):
            pairs = _best_pairs(words, Subwords(alphabet, tuple(taken)), per_round, min_count)
            if not pairs:
                break
            taken.append(pairs)
        return Subwords(alphabet, tuple(taken))
    finally:
        words.unpersist()


def _best_pairs(words: DataFrame, model: Subwords, limit: int, min_count: int) -> Round:
    counted = _counted(words, model, 2)
    # A row for each pair of symbols, looked at from three sides; words are split once.
    ranked = counted.select("a", "b", "n", F.struct((-F.col("n")).alias("n"), "a", "b").alias("rank")).persist()
    try:
        left = ranked.groupBy(F.col("a").alias("b")).agg(F.min("rank").alias("rival_left"))
        right = ranked.groupBy(F.col("b").alias("a")).agg(F.min("rank").alias("rival_right"))
        free = ranked.join(left, "b", "left").join(right, "a", "left").where(
            (F.col("n") >= min_count)
            & (F.col("rival_left").isNull() | (F.col("rank") < F.col("rival_left")))
            & (F.col("rival_right").isNull() | (F.col("rank") < F.col("rival_right")))
        )
        return {(r.a, r.b): r.n for r in free.orderBy("rank").limit(limit).select("a", "b", "n").collect()}
    finally:
        ranked.unpersist()


def _numbered(model: Subwords, most: int) -> Column:
    """A column function: the first ``most`` token ids of a list of words."""
    ids = {token: k for token, _, _, k in model.entries()}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(texts: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}

        def of(words: Sequence[str] | None) -> list[int]:
            out: list[int] = []
            for word in () if words is None else words:
                if len(out) >= most:
                    break
                if word not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = [ids.get(s, C.UNKNOWN_ID) for s in model.symbols(word)]
                out += known[word]
            return out[:most]

        return texts.map(of)

    return numbers


def encode_subwords(
    df: DataFrame, model: Subwords, length: int = C.ENCODED_LENGTH, col: str = "text", pair: str | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Replace ``col`` (and ``pair``) by ``input_ids`` and ``attention_mask``, arrays of ``length`` numbers.

    One text stands between a begin and an end mark. Of two, the second follows behind two more end marks: begin, first, end, end, second, end.
    What doesn't fit is cut off; of two texts the longer one is cut until both are equally long, then both, the first keeping the odd place.
    What is missing is padded. Null and empty texts have no tokens. Rows stay where they are: the words that can fit go to
    the task's model, nothing is shuffled.
    """
    marks = 2 if pair is None else 4
    room = length - marks
    if room < 0:
        raise ValueError(f"length must be {marks} at least")
    keep = [c for c in df.columns if c not in (col, pair)] if keep is None else list(keep)
    numbers = _numbered(model, room)

    def ids(name: str) -> Column:
        words = F.slice(F.coalesce(tokens(F.col(name)), F.array().cast("array<string>")), 1, max(room, 1))
        return numbers(words)

    begin, end = F.array(F.lit(C.BEGIN_ID)), F.array(F.lit(C.END_ID))
    found = df.select(*keep, ids(col).alias("__a"), *([] if pair is None else [ids(pair).alias("__b")]))
    if pair is None:
        parts = F.concat(begin, "__a", end)
    else:
        second = F.least(F.size("__b"), F.greatest(F.lit(room) - F.size("__a"), F.lit(room // 2)))
        first = F.least(F.size("__a"), F.lit(room) - second)
        parts = F.concat(begin, F.slice("__a", F.lit(1), first), end, end, F.slice("__b", F.lit(1), second), end)
    used = F.size("__parts")
    padded = F.concat("__parts", F.array_repeat(F.lit(C.PAD_ID), F.lit(length) - used))
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))
    return found.select(*keep, parts.alias("__parts")).select(*keep, padded.alias("input_ids"), mask.alias("attention_mask"))
