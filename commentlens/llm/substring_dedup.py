"""Substring deduplication by recompression.

Rounds replace runs of one symbol and then pairs of symbols by new names. Which pairs merge follows from the two symbols
alone (one bit of each name), so an equal substring gets equal symbols everywhere but for one or two at either end. The
names are 64-bit fingerprints of what they stand for: they are the same all over the corpus without a shuffle to agree on
them, so a task carries out its rounds on its own.

A window of words keeps some interior symbols after the rounds; the one sequence of them with the smallest hash is its
anchor, which follows from the window's words alone. Spark counts anchors over the corpus: a window whose anchor is found
once can't be repeated. The windows of the other anchors are compared by their own fingerprints, grouped by anchor, and all
but the first are removed. A window without interior symbols (long runs) is its own anchor, so nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlens.llm.common import bit_filter, in_filter, settle
from commentlens.llm.words import Words, mix, sequences, signed, slices, u64

WINDOW = 20
ROUNDS = 2
#: Interior symbols that make an anchor.
ANCHOR = 3
#: Bits of the filter of repeated anchors, as a power of two (16 MB), and of the filter of documents that lose words (8 MB).
ANCHOR_BITS, DOC_BITS = 27, 26


def recompress(names: np.ndarray, document: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds, the word each starts at, and for each window start and end the bounds of its interior.

    The bound of a start is the first word of which symbols are sure to be those of every equal window, or len(names) + 1;
    that of an end is the word after the last such, or 0.
    """
    n = len(names)
    symbols, at = names, np.arange(n)
    low, high = np.arange(n + 2), np.arange(n + 1)
    low[n] = n + 1
    if not n:
        return symbols, at, low, high
    for level in range(rounds):
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (document[at[1:]] != document[at[:-1]])
        begin = np.flatnonzero(new)
        length = np.diff(np.r_[begin, len(symbols)])
        run = symbols[begin]
        run = np.where(length > 1, mix(run * u64(0x9E3779B97F4A7C15) + length.astype(np.uint64)), run)
        start = at[begin]
        end = np.r_[start[1:], n]
        left = mix(run + u64(level + 1)) & u64(1) == 1
        next_too = np.zeros(len(run), bool)
        next_too[:-1] = document[start[1:]] == document[start[:-1]]

        # Bounds: the run at the bound may go on outside; the symbol next to it may be merged with it.
        of = np.cumsum(new) - 1
        follows = np.r_[end[1:], n]
        after = np.where(next_too, np.where(np.r_[left[1:], False], end, follows), n + 1)
        up = np.full(n + 2, n + 1)
        up[at] = after[of]
        low = up[low]
        previous_too = np.r_[False, next_too[:-1]]
        before = np.where(previous_too, np.where(np.r_[False, left[:-1]], np.r_[0, start[:-1]], start), 0)
        down = np.zeros(n + 1, np.int64)
        down[np.r_[at[1:], n]] = before[of]
        high = down[high]

        pair = np.zeros(len(run), bool)
        pair[:-1] = left[:-1] & ~left[1:] & next_too[:-1]
        merged = np.where(pair, mix(run * u64(0xD6E8FEB86659FD93) + np.r_[run[1:], run[:1]] * u64(3) + u64(level)), run)
        stay = ~np.r_[False, pair[:-1]]
        symbols, at = merged[stay], start[stay]
    return symbols, at, low, high


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside a text: first word, anchor, and where the anchor is (the same for neighbours that share it)."""
    document = np.repeat(np.arange(len(w.counts)), w.counts)
    symbols, at, low, high = recompress(w.names, document, ROUNDS)
    first = np.flatnonzero(w.whole(window))
    a = np.searchsorted(at, low[first])
    b = np.searchsorted(at, high[first + window])
    many = np.where(high[first + window] > low[first], b - a, 0)
    key, place = np.zeros(len(first), np.uint64), np.full(len(first), -1)
    for k in range(1, ANCHOR):  # few symbols: all of them
        some = many == k
        if some.any():
            key[some], place[some] = sequences(symbols, k)[a[some]], a[some]
    none = many <= 0
    if none.any():
        key[none] = mix(sequences(w.names, window)[first[none]] + u64(1))
    tuples = sequences(symbols, ANCHOR)
    enough = np.flatnonzero(many >= ANCHOR)
    if len(enough):
        best, where = tuples[a[enough]], a[enough].copy()
        for k in range(1, int(many.max()) - ANCHOR + 1):
            more = np.flatnonzero(many[enough] >= ANCHOR + k)
            candidate = tuples[a[enough[more]] + k]
            less = candidate < best[more]
            best[more[less]] = candidate[less]
            where[more[less]] = a[enough[more[less]]] + k
        key[enough], place[enough] = best, where
    return first, key, place


def _count_anchors(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors and in how many places a slice of the corpus has them."""
    for batch in batches:
        for _, data, offsets in slices(batch):
            _, key, place = _anchors(Words(data, offsets), window)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (place[1:] < 0)
            found, counts = np.unique(key[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(np.minimum(counts, 2))], ["key", "n"])


_RUNS = pa.schema({"key": pa.int64(), "doc_id": pa.int64(), "text_key": pa.int64(), "start": pa.int64(), "prints": pa.binary(), "gone": pa.binary()})


def _candidates(window: int, repeated, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring windows of a repeated anchor, with their fingerprints; or windows (gone) that the slice itself has earlier."""
    for batch in batches:
        for rows, data, offsets in slices(batch):
            w = Words(data, offsets)
            first, key, place = _anchors(w, window)
            prints = sequences(w.names, window)[first]
            ids, text_keys = rows.column("doc_id"), rows.column("text_key").to_numpy()
            text = np.searchsorted(w.first, first, "right") - 1
            maybe = np.flatnonzero(in_filter(repeated.value, key))
            # What the slice has in an earlier document or place is gone; the first of each meet windows of other slices.
            order_of = np.empty(rows.num_rows, np.int64)
            filled = ids.fill_null(2**63 - 1).to_numpy()
            order_of[np.lexsort((text_keys, ids.is_null().to_numpy(zero_copy_only=False), filled))] = np.arange(rows.num_rows)
            start = first - w.first[text]
            rank = np.lexsort((first[maybe], order_of[text[maybe]], prints[maybe]))
            ranked = maybe[rank]
            leads = np.r_[True, prints[ranked[1:]] != prints[ranked[:-1]]][: len(ranked)]
            leader = ranked[np.flatnonzero(leads)[np.cumsum(leads) - 1]]
            # Rows equal in doc_id and text are one place: their windows neither remove each other nor need to be shown twice.
            place = [x[text] for x in (filled, ids.is_null().to_numpy(zero_copy_only=False), text_keys)] + [start]
            elsewhere = np.any([x[ranked] != x[leader] for x in place], axis=0)
            out = []
            gone, shown = np.sort(ranked[elsewhere]), np.sort(ranked[leads])
            for part, column in ((shown, "prints"), (gone, "gone")):
                if len(part):
                    cut = np.flatnonzero((np.diff(part) != 1) | (np.diff(text[part]) != 0) | ((np.diff(key[part].view(np.int64)) != 0) if column == "prints" else False)) + 1
                    begins, ends = np.r_[0, cut], np.r_[cut, len(part)]
                    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                        t = int(text[part[b]])
                        value = prints[part[b:e]].tobytes() if column == "prints" else start[part[b:e]].astype(np.int32).tobytes()
                        k = int(key[part[b]].view(np.int64)) if column == "prints" else int(text_keys[t])
                        out.append((k, ids[t].as_py(), int(text_keys[t]), int(start[part[b]]), *((value, None) if column == "prints" else (None, value))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _RUNS, strict=True)], schema=_RUNS)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and place: the windows that an earlier row of the anchor has, by document."""
    last_key, seen, owner = None, np.empty(0, np.uint64), np.empty((0, 3), np.int64)
    for batch in batches:
        done = pa.compute.is_valid(batch.column("gone"))
        passed = batch.filter(done).select(["doc_id", "text_key", "gone"])
        if passed.num_rows:
            yield passed
        batch = batch.filter(pa.compute.invert(done))
        if not batch.num_rows:
            continue
        prints = [np.frombuffer(x, np.uint64) for x in batch.column("prints").to_pylist()]
        size = np.array([len(x) for x in prints])
        row = np.repeat(np.arange(len(size)), size)
        value = np.concatenate(prints)
        ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy()
        key, text_key = batch.column("key").to_numpy(), batch.column("text_key").to_numpy()
        start = batch.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        place = np.column_stack([ids[row], text_key[row], start])
        if last_key is not None and key[0] == last_key:  # the anchor goes on from the batch before
            value, place, row = np.r_[seen, value], np.vstack([owner, place]), np.r_[np.full(len(seen), -1), row]
        _, first, back = np.unique(value, return_index=True, return_inverse=True)
        gone = (place != place[first[back]]).any(axis=1) & (row >= 0)
        last_key = key[-1]
        mine = first[(row[first] < 0) | (key[np.maximum(row[first], 0)] == last_key)]
        if key[0] != last_key:
            mine = mine[row[mine] >= 0]
        seen, owner = value[mine], place[mine]
        of = row[gone]
        cut = np.flatnonzero(np.diff(of)) + 1
        if len(of):
            begins = np.r_[0, cut]
            keys = batch.select(["doc_id", "text_key"]).take(pa.array(of[begins]))
            pieces = [x.astype(np.int32).tobytes() for x in np.split(place[gone, 2], cut)]
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(pieces, pa.binary())], ["doc_id", "text_key", "gone"])


def _picked(losers, want: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column("__doc_key").to_numpy().view(np.uint64)
        kept = batch.filter(pa.array(in_filter(losers.value, key) == want))
        if kept.num_rows:
            yield kept if want else _cut(0, kept)


def _cut(window: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, gone, kept = [], [], []
    lists = batch.column("__gone").to_pylist() if "__gone" in batch.schema.names else [None] * batch.num_rows
    for text, starts in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), lists, strict=True):
        words = (text or b"").split()
        counts.append(len(words))
        if starts:
            at = np.frombuffer(b"".join(starts), np.int32)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            keep = np.cumsum(change)[:-1] == 0
            words = list(compress(words, keep.tolist()))
        gone.append(counts[-1] - len(words))
        kept.append(b" ".join(words).decode())
    columns = {n: batch.column(n) for n in batch.schema.names if not n.startswith("__")}
    columns |= {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())}
    return pa.RecordBatch.from_pydict(columns)


def _cut_all(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _cut(window, batch)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words left, joined by a space.

    A word goes if it lies in a window of ``window`` words that also starts earlier: in a document of a smaller doc_id, or
    earlier in the same. Windows are judged on the whole input texts. A missing doc_id is larger than all others; of
    rows of one doc_id and different texts one counts as earlier, rows equal in both keep the same words. Null and empty texts have no words.
    Columns named like the added ones are replaced, all others passed on. No rows give no rows.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.drop("n_words", "n_removed", "kept")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    counted = keyed.select("text").mapInArrow(partial(_count_anchors, window), "key long, n long")
    twice = counted.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    repeated = context.broadcast(bit_filter(twice, ANCHOR_BITS))

    schema = "key long, doc_id long, text_key long, start long, prints binary, gone binary"
    runs = keyed.mapInArrow(partial(_candidates, window, repeated), schema)
    by_anchor = runs.repartition("key").sortWithinPartitions("key", F.col("doc_id").asc_nulls_last(), "text_key", "start")
    removed = settle(by_anchor.mapInArrow(_later, "doc_id long, text_key long, gone binary"))
    lists = removed.groupBy("doc_id", "text_key").agg(F.collect_list("gone").alias("__gone"))

    id_key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    losers = context.broadcast(bit_filter(removed.select(F.xxhash64("doc_id", "text_key").alias("key")), DOC_BITS))
    marked = docs.withColumn("__doc_key", id_key)
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *added])
    whole = marked.mapInArrow(partial(_picked, losers, False), schema)
    losing = marked.mapInArrow(partial(_picked, losers, True), marked.schema)
    lists = lists.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    joined = losing.join(lists, same, "left").drop("__id", "__key", "__doc_key")
    return whole.unionByName(joined.mapInArrow(partial(_cut_all, window), schema))
