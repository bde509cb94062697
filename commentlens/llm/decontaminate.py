"""Benchmark items inside documents: lookup of short items, size-partitioned MinHash containment search, verified exactly.

An item of up to 16 shingles is looked up by its rarest shingles, one more than a document may lack: one of them is in
every document that holds enough, so no short item is missed.

Longer items are partitioned by size, each with the smallest power of two that holds its shingles. For such a size, a
document is seen as windows of two adjacent blocks of that many shingles, so a passage as long as the item lies in one window
that is at most four times its size, however long the document is. Item and window then have a Jaccard similarity of about a
quarter (0.176 at the lowest containment and the least favourable size), and share one of 64 minima practically always: a miss
has a probability under one in ten million for a whole item (0.75 ** 64), under one in two hundred thousand at the lowest
containment (0.824 ** 64). Window minima of a size come from those of the size below.
Candidates are verified by counting the item's shingles in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.common import union_all
from commentlens.llm.words import Words, mix, one_sequence, signed, slices, u64

PERCENT = 75
SHINGLE_WORDS = 5
HASHES = 64
#: Items of more shingles than this are found by minima, the others by their shingles.
LOOKED_UP = 16
#: Shingles of the smallest block.
BASE = 2 * LOOKED_UP
#: Bytes of item texts that are searched for in one pass over the documents; more items take more passes.
ITEM_BYTES = 16 << 20

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | u64(1)


def _minima(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each block of names, the minimum of every hash function."""
    out = np.empty((HASHES, len(starts)), np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[k] = np.minimum.reduceat(((names * factor) >> u64(32)).astype(np.uint32), starts)
    return out


def _index(ids: list, texts: list, words: int, percent: int) -> dict:
    """What a pass needs of its items: their ids and shingles, and what leads to an item: shingles, or by size its minima.

    Plain arrays, which workers can read without this package.
    """
    data = [(t or "").encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
    w = Words(np.frombuffer(b"".join(data), np.uint8), offsets, lower=True, plain=True)
    grams = w.grams(words)
    shingles: list[np.ndarray] = []
    short: dict[int, list[int]] = {}
    looked_up: list[int] = []
    by_size: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        shingles.append(np.unique(grams[a : max(a, b - words + 1)]))
        if 0 < b - a < words:
            short.setdefault(int(one_sequence(w.names[a:b])), []).append(k)
        elif b > a and len(shingles[k]) <= LOOKED_UP:
            looked_up.append(k)
        elif b > a:
            by_size.setdefault(max(BASE, 1 << (len(shingles[k]) - 1).bit_length()), []).append(k)
    sizes = {}
    for size, members in sorted(by_size.items()):
        lengths = [len(shingles[k]) for k in members]
        minima = _minima(np.concatenate([shingles[k] for k in members]), np.r_[0, np.cumsum(lengths)[:-1]])
        keys = (np.arange(HASHES, dtype=np.uint64)[:, None] << u64(32) | minima).ravel()
        order = np.argsort(keys, kind="stable")
        hint = np.zeros(1 << max(12, (keys.size * 16).bit_length()), bool)
        hint[(minima & np.uint32(hint.size - 1)).ravel()] = True
        sizes[size] = keys[order], np.tile(members, HASHES)[order], hint
    return {"ids": ids, "shingles": shingles, "short": short, "sizes": sizes, "rare": _rare(shingles, looked_up, percent)}


def _rare(shingles: list[np.ndarray], members: list[int], percent: int) -> tuple | None:
    """Of each member as many shingles as a document that holds enough can't lack, those that few members have: sorted, with their items."""
    if not members:
        return None
    known, held = np.unique(np.concatenate([shingles[k] for k in members]), return_counts=True)
    keys, items = [], []
    for k in members:
        n = len(shingles[k])
        needed = max(1, int(-(-percent * n // 100)))
        few = np.argsort(held[np.searchsorted(known, shingles[k])], kind="stable")[: n - needed + 1]
        keys.append(shingles[k][few])
        items.append(np.full(len(few), k))
    keys, items = np.concatenate(keys), np.concatenate(items)
    order = np.argsort(keys, kind="stable")
    hint = np.zeros(1 << max(12, (keys.size * 16).bit_length()), bool)
    hint[keys & u64(hint.size - 1)] = True
    return keys[order], items[order], hint


def _holders(rare: tuple, names: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) pairs that share a rare shingle, once each."""
    keys, items, hint = rare
    at = np.flatnonzero(hint[names & u64(hint.size - 1)])
    low, high = np.searchsorted(keys, names[at], "left"), np.searchsorted(keys, names[at], "right")
    many = high - low
    place = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    pairs = np.unique(np.column_stack([np.repeat(document[at], many), items[place]]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(one_size: tuple, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs that share a minimum."""
    keys, items, hint = one_size
    k, window = np.nonzero(hint[minima & np.uint32(hint.size - 1)])
    found = k.astype(np.uint64) << u64(32) | minima[k, window]
    low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
    many = high - low
    at = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    return np.repeat(window, many), items[at]


_HITS = pa.schema({"doc_id": pa.int64(), "text_key": pa.int64(), "item_id": pa.int64(), "n_item": pa.int64(), "n_found": pa.int64()})


def _search(items, words: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = items.value
    sizes, short = known["sizes"], known["short"]
    for batch in batches:
        for rows, data, offsets in slices(batch):
            w = Words(data, offsets, lower=True, plain=True)
            names = w.grams(words)[w.whole(words)]
            counts = np.maximum(0, w.counts - words + 1)
            first = np.r_[0, np.cumsum(counts)]
            blocks = -(-counts // BASE)
            hits: list[tuple[int, int]] = []
            if len(names) and known["rare"]:
                holder, item = _holders(known["rare"], names, np.repeat(np.arange(len(counts)), counts))
                hits += zip(holder.tolist(), item.tolist(), strict=True)
            if len(names) and sizes:
                document = np.repeat(np.arange(len(counts)), blocks)
                within = np.arange(len(document)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                minima, size = _minima(names, first[document] + within * BASE), BASE
                while True:
                    if size in sizes:
                        windows = minima.copy()
                        next_too = np.flatnonzero(document[1:] == document[:-1])
                        windows[:, next_too] = np.minimum(minima[:, next_too], minima[:, next_too + 1])
                        window, item = _meet(sizes[size], windows)
                        hits += zip(document[window].tolist(), item.tolist(), strict=True)
                    if size >= max(sizes):
                        break
                    even = np.flatnonzero(within % 2 == 0)
                    minima, document, within, size = np.minimum.reduceat(minima, even, axis=1), document[even], within[even] // 2, size * 2
            for t in np.flatnonzero((w.counts > 0) & (w.counts < words)) if short else ():
                hits += [(t, k) for k in short.get(int(one_sequence(w.names[w.first[t] : w.first[t + 1]])), ())]
            out, own = [], (-1, None)
            for t, k in sorted(set(hits)):
                total = found = 1
                if w.counts[t] >= words:
                    own = own if own[0] == t else (t, np.sort(names[first[t] : first[t + 1]]))
                    shingles = known["shingles"][k]
                    at = np.minimum(np.searchsorted(own[1], shingles), len(own[1]) - 1)
                    total, found = len(shingles), int((own[1][at] == shingles).sum())
                if 100 * found >= percent * total:
                    out.append((t, known["ids"][k], total, found))
            keys = rows.select(["doc_id", "text_key"]).take(pa.array([x[0] for x in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))], schema=_HITS)


def contained_items(docs: DataFrame, items: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents that hold at least ``percent`` of an item's distinct ``words``-word shingles.

    Words are in lower case (ASCII) without ASCII punctuation. doc_id, text_key (xxhash64 of the text), item_id, n_item,
    n_found: a row per document row and item row. An item of fewer words than a shingle is found only in documents that
    consist of just these words; items and documents without words (or null) are never found. Items without item_id are
    found, too. Other columns are ignored. No documents or no items give no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    parts = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).toArrow()
        known = docs.sparkSession.sparkContext.broadcast(_index(part["item_id"].to_pylist(), part["text"].to_pylist(), words, percent))
        parts.append(keyed.mapInArrow(partial(_search, known, words, percent), "doc_id long, text_key long, item_id long, n_item long, n_found long"))
    return union_all(parts)


def without_leaks(docs: DataFrame, items: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents in which an item is found."""
    hits = contained_items(docs, items, words, percent).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(hits, same, "left_anti")
