"""Secret scans with a trigram inverted index.

From each rule's regular expression follow trigrams that every match must contain, as a Boolean query: of each clause one
alternative, all of its trigrams. The index is partitioned by document, as the corpus is: a slice of a few megabytes has
posting lists of the documents that contain a trigram. Lists are intersected and united as the queries say, and only the
documents left are searched with the expression. A rule without mandatory trigrams (a run of hex digits) scans everything.
Nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from re import _constants as C
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.llm.words import slices


class Rule(NamedTuple):
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The rules.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
)

#: A clause is a set of alternatives, an alternative a set of trigrams; a query is a list of clauses that must all hold.
Clause = frozenset[frozenset[str]]
#: Strings that a part of an expression is followed through as; beyond, it is cut.
_MOST = 64


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


class _Query:
    """Literal strings that the part of an expression read last stands for, and clauses gained before."""

    def __init__(self) -> None:
        self.exact: set[str] = {""}
        self.clauses: list[Clause] = []

    def cut(self) -> None:
        alternatives = frozenset(_grams(x) for x in self.exact)
        if all(alternatives):
            self.clauses.append(alternatives)
        self.exact = {""}

    def add(self, strings: set[str]) -> None:
        if len(self.exact) * len(strings) > _MOST:
            self.cut()
        self.exact = {a + b for a in self.exact for b in strings} if len(strings) <= _MOST else {""}

    def read(self, parts) -> None:
        for op, value in parts:
            if op is C.LITERAL:
                self.add({chr(value).lower()})
            elif op is C.IN and all(o is C.LITERAL for o, _ in value) and len(value) <= 8:
                self.add({chr(v).lower() for _, v in value})
            elif op is C.SUBPATTERN:
                self.read(value[-1])
            elif op is C.BRANCH:
                self.branch(value[1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, inner = value
                once = _Query()
                once.read(inner)
                if not once.clauses and "" not in once.exact and high == 1:
                    self.add(once.exact | {""} if low == 0 else once.exact)
                else:
                    self.cut()
                    if low:
                        once.cut()
                        self.clauses += once.clauses
            elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):
                self.cut()

    def branch(self, branches) -> None:
        read = [_Query() for _ in branches]
        for q, part in zip(read, branches, strict=True):
            q.read(part)
        if any(q.clauses for q in read):
            self.cut()
            for q in read:
                q.cut()
            if all(q.clauses for q in read):
                self.clauses.append(frozenset(a for q in read for a in q.clauses[0]))
        else:
            self.add(set().union(*[q.exact for q in read]))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses over trigrams of the text in lower case (ASCII); none if a match needs no trigram."""
    query = _Query()
    query.read(parser.parse(pattern))
    query.cut()
    return query.clauses


def _fold(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)


def _postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Documents of the slice, ascending, by trigram; only of trigrams that a query asks for."""
    low = _fold(data)
    codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.empty(0, np.uint32)
    at = np.flatnonzero(wanted[codes])
    document = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[document + 1]
    pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | document[inside])
    code, document = pairs >> 32, pairs & (2**32 - 1)
    cut = np.flatnonzero(np.diff(code)) + 1
    return dict(zip(code[np.r_[0, cut]].tolist() if len(code) else [], np.split(document, cut), strict=False))


def _code(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 16 | b << 8 | c


def _candidates(query: list[list[list[int]]], postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Documents that may match: lists intersected in an alternative and over clauses, united over alternatives."""
    none = np.empty(0, np.int64)
    out = np.arange(n)
    for clause in query:
        found = [reduce(np.intersect1d, [postings.get(g, none) for g in grams]) for grams in clause]
        out = np.intersect1d(out, reduce(np.union1d, found))
    return out


def _scan(rules: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled = [(k, re.compile(pattern), group, least, query) for k, (_, pattern, group, least, query) in enumerate(rules)]
    wanted = np.zeros(1 << 24, bool)
    wanted[[g for *_, query in compiled for clause in query for grams in clause for g in grams]] = True
    kinds = [r[0] for r in rules]
    for batch in batches:
        for rows, data, offsets in slices(batch):
            postings = _postings(data, offsets, wanted)
            texts = rows.column("text")
            found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            for k, expression, group, least, query in compiled:
                for t in _candidates(query, postings, rows.num_rows).tolist():
                    for m in expression.finditer(texts[t].as_py() or ""):
                        if m.end(group) - m.start(group) >= least:
                            found[t].append({"start": m.start(), "rule": k, "end": m.end(), "kind": kinds[k]})
            spans = pa.array(found, pa.list_(pa.struct({"start": pa.int32(), "rule": pa.int32(), "end": pa.int32(), "kind": pa.string()})))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), spans], ["doc_id", "text_key", "secrets"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), secrets: array of (start, rule, end, kind) in order, for every row.

    Spans are of whole matches in code points, end exclusive; matches of a rule don't overlap, those of different rules may.
    A null or empty text has none. Other columns are ignored. No rows give no rows.
    """
    told = [(r.kind, r.pattern, r.group, r.least, [[sorted(map(_code, a)) for a in c] for c in trigram_query(r.pattern)]) for r in rules]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id long, text_key long, secrets array<struct<start: int, rule: int, end: int, kind: string>>"
    return keyed.mapInArrow(partial(_scan, told), schema).withColumn("secrets", F.array_sort("secrets"))


def as_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
