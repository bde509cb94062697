"""Line deduplication with a log-template tree.

A line is parsed along a tree of fixed depth: first by its number of words, then by its leading words, where words with a
digit count as variable; so a leaf is what opens like "7 words: Page <*> of <*> printed on". Lines of one leaf need not be
alike. A leaf is split by what follows: a template is a quarter of the words after the leading ones (or all of them), led by
the line that most documents have, and holds the lines that agree with that line in most words, position by position. A
template that occurs in several documents is boilerplate: its lines are dropped from all of them but the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlens.llm.common import bit_filter, in_filter, settle
from commentlens.llm.words import Words, mix, signed, slices, u64

#: Leading words that are looked at.
DEPTH = 6
#: Documents that make a template recurring.
MIN_DOCS = 5
#: Percentage of the words without digits that a line shares with its template's leading line.
ALIKE = 75
#: Parts of the words after the leading ones; lines are compared if one part is the same.
PARTS = 4

#: Bits of the filter of leaves that have several lines; when it fills up, more lines are looked at, with the same result.
LEAF_BITS = 26
#: Shares that the documents of a line, which may be a third of all, are dealt into when they meet its row.
SALTS = 16

_VARIABLE = u64(0x5BF0A8B1457695F1)
#: Bytes of a word in a line's shape.
_PRINT = 2


class Lines(NamedTuple):
    """Lines with a word: number of the text, newlines before it in all texts, leaf of the tree, name of the whole line (but
    for variable words), how many leading words are not variable, and the shape of the others, 16 bits each, 0 if variable."""

    text: np.ndarray
    newlines: np.ndarray
    leaf: np.ndarray
    line: np.ndarray
    opening: np.ndarray
    shape: pa.Array


def parsed_lines(w: Words, depth: int) -> Lines:
    """Every line of some texts. If the leading words are all variable, no word counts as such."""
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    newlines = np.cumsum(w.data == 10)[w.starts] if len(w.starts) else np.empty(0, np.int64)
    row = newlines + text
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    count = np.diff(np.r_[begin, len(row)])
    digits = np.r_[0, np.cumsum((w.data >= 48) & (w.data <= 57))]
    variable = digits[w.ends] > digits[w.starts]
    known = np.zeros(len(count), bool)
    for k in range(depth):
        has = count > k
        known[has] |= ~variable[begin[has] + k]
    variable &= np.repeat(known, count)
    names = np.where(variable, _VARIABLE, w.names)
    leaf, opening = mix(count.astype(np.uint64)), np.zeros(len(count), np.int32)
    for k in range(depth):
        has = count > k
        opening[has] += ~variable[begin[has] + k]
        leaf[has] = mix(leaf[has] * u64(0x9E3779B97F4A7C15) + names[begin[has] + k])
    place = np.arange(len(row)) - np.repeat(begin, count)
    placed = mix(names ^ mix(place.astype(np.uint64) + u64(1)))
    line = mix(np.add.reduceat(placed, begin) + leaf) if len(begin) else leaf
    short = np.where(variable, 0, np.maximum(w.names >> u64(48), u64(1))).astype("<u2")[place >= depth]
    ends = np.r_[0, np.cumsum(np.maximum(count - depth, 0))].astype(np.int64) * _PRINT
    shape = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(short.tobytes())])
    return Lines(text[begin], newlines[begin], leaf, line, opening, shape)


def _lines(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of each document once."""
    for batch in batches:
        for rows, data, offsets in slices(batch):
            found = parsed_lines(Words(data, offsets), depth)
            order = np.lexsort((found.line, found.text))
            text, line = found.text[order], found.line[order]
            once = order[np.r_[True, (text[1:] != text[:-1]) | (line[1:] != line[:-1])][: len(text)]]
            keys = rows.select(["doc_id", "text_key"]).take(pa.array(found.text[once]))
            numbers = [pa.array(signed(found.leaf[once])), pa.array(signed(found.line[once])), pa.array(found.opening[once])]
            shape = found.shape.take(pa.array(once)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*keys.columns, *numbers, shape], ["doc_id", "text_key", "leaf", "line", "opening", "shape"])


def _in_leaves(table: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose leaf may be in a filter."""
    for batch in batches:
        yield batch.filter(pa.array(in_filter(table, batch.column("leaf").to_numpy().view(np.uint64))))


def _alike(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose ``shape`` and ``lead``, of equal lengths, have that percentage of words in common, the opening included."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2") for c in ("shape", "lead"))
        size = np.array([len(x) // _PRINT for x in batch.column("shape").to_pylist()])
        at = np.r_[0, np.cumsum(size)[:-1]]
        fixed = (a != 0) | (b != 0)
        same = np.add.reduceat((fixed & (a == b)).astype(np.int64), at)
        opening = batch.column("opening").to_numpy()
        alike = 100 * (same + opening) >= percent * (np.add.reduceat(fixed.astype(np.int64), at) + opening)
        yield batch.select(["template", "line", "docs"]).filter(pa.array(alike))


def _templates(lines: DataFrame, percent: int, min_docs: int) -> DataFrame:
    """(template, line, docs) of the distinct ``lines`` (leaf, line, opening, shape, docs, first), for templates that may recur.

    A line that enough documents have is a template. A leaf of one line has no other; in the rest, lines with the same part are
    compared with the one that most documents have.
    """
    alone = lines.where(F.col("docs") >= min_docs).select(F.xxhash64("leaf", "line").alias("template"), "line", "docs")
    longer = lines.where(F.length("shape") > 0)
    several = (F.sum("docs") >= min_docs) & (F.count("*") > 1)
    leaves = longer.groupBy("leaf").agg(several.alias("several")).where("several").select("leaf")
    looked_at = longer.mapInArrow(partial(_in_leaves, bit_filter(leaves, LEAF_BITS)), lines.schema)

    tail = F.length("shape") / _PRINT
    edge = lambda k: _PRINT * F.floor(tail * k / PARTS).cast("int")
    part = lambda k: F.col("shape").substr(edge(k) + 1, edge(k + 1) - edge(k))
    filled = lambda k: F.when(edge(k + 1) > edge(k), F.xxhash64("leaf", F.lit(k), part(k)))
    keys = F.array_compact(F.array(*[filled(k) for k in range(PARTS)]))
    keyed = looked_at.select(F.explode(keys).alias("template"), "line", "docs", "first")
    rank = F.struct("docs", -F.coalesce("first", F.lit(2**63 - 1)), "line")
    leads = keyed.groupBy("template").agg(F.max(rank)["line"].alias("leading"), several.alias("several")).where("several").drop("several")
    pairs = settle(keyed.select("template", "line", "docs").join(leads, "template"))
    shapes = looked_at.select("line", "opening", "shape")
    leading = pairs.select("template", "leading").distinct().join(shapes.select(F.col("line").alias("leading"), F.col("shape").alias("lead")), "leading")
    compared = pairs.drop("leading").join(shapes, "line").join(leading.select("template", "lead"), "template")
    alike = compared.mapInArrow(partial(_alike, percent), pairs.drop("leading").schema)
    return alone.unionByName(alike)


def _without(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their listed lines cut out, and how many lines there were and went."""
    for batch in batches:
        for rows, data, offsets in slices(batch):
            text, newlines, _, line, *_ = parsed_lines(Words(data, offsets), depth)
            first = np.searchsorted(text, np.arange(rows.num_rows + 1))
            lists = rows.column("__lines")
            kept, gone = rows.column("text").to_pylist(), np.zeros(rows.num_rows, np.int64)
            before = np.r_[0, np.cumsum(data == 10)]
            for t in np.flatnonzero(np.asarray(lists.is_valid())):
                mine = slice(first[t], first[t + 1])
                drop = np.isin(signed(line[mine]), lists[int(t)].values.to_numpy())
                out = set((newlines[mine][drop] - before[offsets[t]]).tolist())
                gone[t] = len(out)
                kept[t] = "\n".join(x for k, x in enumerate(kept[t].split("\n")) if k not in out)
            columns = {n: rows.column(n) for n in rows.schema.names if n != "__lines"}
            columns |= {"text": pa.array(kept, pa.string()), "n_lines": pa.array(np.diff(first)), "n_dropped": pa.array(gone)}
            yield pa.RecordBatch.from_pydict(columns)


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, alike: int = ALIKE) -> DataFrame:
    """``docs`` without the lines of templates that at least ``min_docs`` documents have; adds n_lines and n_dropped.

    Lines of a template share number of words, leading words, and ``alike`` percent of the words without digits with its
    leading line, position by position. Lines that are equal but for words with digits always share a template. The
    document of the smallest doc_id keeps its lines of a template (documents without doc_id never do), unless they go
    by another template, of which a document of a smaller one keeps its own. Lines without a word are no template; they stay,
    as do all lines of a document in which nothing recurs, byte for byte. A null text stays null. Every row is a document of its own, repeated rows too; rows of one doc_id and text get the same result. All
    other columns are passed on; columns named n_lines or n_dropped are replaced. No rows give no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = keyed.mapInArrow(partial(_lines, depth), "doc_id long, text_key long, leaf long, line long, opening int, shape binary")
    # Lines are counted before leaves, so that a leaf in every document is a few counts.
    lines = settle(found.groupBy("leaf", "line", "opening", "shape").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")))
    members = settle(_templates(lines, alike, min_docs))
    reach = members.groupBy("template").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    members = members.drop("docs").join(reach.select("template"), "template", "left_semi")

    # A document with several lines of a template counts once; rows that are equal count each.
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
    rows = found.groupBy("doc_id", "text_key", "line").agg(F.count("*").alias("rows")).select("*", salt)
    held = settle(rows.join(members.select("*", salts), ["line", "salt"]))
    each = held.groupBy("template", "doc_id", "text_key").agg(F.max("rows").alias("rows"))
    recurring = each.groupBy("template").agg(F.sum("rows").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    # A document keeps a line if it is the first one of all its templates.
    firsts = members.join(recurring, "template").groupBy("line").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.count_if(F.col("first").isNull()).alias("none"))
    stays = (F.col("doc_id") == F.col("first")) & (F.col("first") == F.col("last")) & (F.col("none") == 0)
    later = held.join(firsts.select("*", salts), ["line", "salt"]).where(~F.coalesce(stays, F.lit(False)))
    lists = later.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("line").alias("__lines"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    marked = docs.join(lists, same, "left").drop("__id", "__key")
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return marked.mapInArrow(partial(_without, depth), T.StructType([*docs.schema.fields, *counts]))
