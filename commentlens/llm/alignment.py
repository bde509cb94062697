"""Alignment of two tokenizers' tokens: which cover the same bytes, and how often each pair of ids does so in the corpus.

Both tokenizers cut the same bytes, so the ends of their tokens are two ascending lists. Merging them gives everything: between two
neighbouring ends lies one overlap of an A and a B token, and where both lists have the same end a group of tokens ends. The
merge is divided along its path: binary searches on diagonals find where pieces of equal work begin in either list, every piece emits
its overlaps by itself, and an end that two pieces share is stitched.

Texts are cut before single spaces, where both tokenizers are known to begin a token; a slice of texts aligns each of its distinct runs
once. What a slice holds of each id pair is summed over the corpus by Spark, and the sums that a slice needs come back to it by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.common import settle
from commentlens.llm.words import slices

#: Steps of the merge in one piece.
PIECE = 1 << 16
#: Runs whose tokens a worker remembers, and those given to a tokenizer at once.
REMEMBERED, AT_ONCE = 500_000, 4096
#: How sentencepiece writes a space, also one that is in the text itself.
_SPACE = "▁"
#: A space that stands alone begins a run.
_CUT = re.compile(rf" (?<=[^ {_SPACE}] )(?=[^\s{_SPACE}])")
#: Fixed value: how a byte-level tokenizer cuts a text in words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """A tokenizer file of the tokenizers library. Control strings inside texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        # Its pattern keeps a single space with what follows it, so nothing crosses a cut.
        split = said.get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not said.get("normalizer")

        self.ranked = _ranked(said, self.bytes) if self.cuts else None
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, parts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(" " + x) for x in parts]
        return [e.ids for e in self.tokenizer.encode_batch([" " + x for x in parts], add_special_tokens=False)]

    def flat(self, parts: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of runs, of which each ends after so many bytes, and how many each run has. Runs that make a text cut between them go as one."""
        if self.ranked:
            text = " ".join(parts)
            if len(_CUT.split(text)) == len(parts):
                ids = self.ranked.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
                upto = np.cumsum(self.sizes[ids])
                last = np.searchsorted(upto, ends)
                if len(ids) and last[-1] == len(ids) - 1 and (upto[last] == ends).all():
                    return ids, np.diff(last, prepend=-1)
        return _flat(self.encode(parts))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def _ranked(said: dict, tokens: list[bytes]):
    """The same tokenizer in a library that is several times as fast, if ids follow the order of merges; else None."""
    import tiktoken

    model = said["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get("".join(m), -1) for m in merges]
    single = [len(x) == 1 for x in tokens]
    in_order = all(x < y for x, y in zip(ids, ids[1:])) and set(ids).isdisjoint({-1}) and sum(single) == 256 and len(ids) + 256 == len(model["vocab"])
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not in_order or not plain:
        return None
    ranks = {tokens[k]: k for k in model["vocab"].values()}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class PieceTokens:
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        # No piece holds a space after something else, and spaces are kept as they are, so nothing crosses a cut.
        whole = all(b"".join(self.bytes[k] for k in ids) == b" " + x.encode() for x in ("a  b", "  a", "a ", "a \n b") for ids in [self.model.encode(x)])
        self.cuts = whole and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1)

    def flat(self, parts: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.encode(parts))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def load(path: str) -> ByteTokens | PieceTokens:
    return PieceTokens(path) if path.endswith(".model") else ByteTokens(path)


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending lists stands after 0, ``step``, 2 * ``step`` ... steps: elements taken of ``a``, and of ``b``.

    Of equal elements that of ``a`` goes first. All binary searches run side by side, one on each diagonal.
    """
    at = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(at), bool)
        first[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, at - low


def _piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of one piece in order, and which are in both lists."""
    merged = np.empty(len(a) + len(b), np.int64)
    merged[np.arange(len(a)) + np.searchsorted(b, a, "left")] = a
    merged[np.arange(len(b)) + np.searchsorted(a, b, "right")] = b
    new = np.concatenate([[True], merged[1:] != merged[:-1]])[: len(merged)]
    ends = merged[new]
    both = np.diff(np.append(np.flatnonzero(new), len(merged))) > 1
    return ends, both


def overlaps(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in a, index in b, whether a group ends here) for every overlap of tokens that end at ``a`` and ``b``, in order."""
    i, j = diagonals(a, b, step)
    found: list[list[np.ndarray]] = []
    last = None
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        ends, both = _piece(a[i0:i1], b[j0:j1])
        if len(ends) and ends[0] == last:  # the end in a is the last of one piece, that in b the first of the next
            found[-1][2][-1] = True
            ends, both = ends[1:], both[1:]
        if len(ends):
            last = ends[-1]
            found.append([i0 + np.searchsorted(a[i0:i1], ends), j0 + np.searchsorted(b[j0:j1], ends), both])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class _Aligner:
    """Both tokenizers of one worker, and the tokens of the runs that it has met."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = load(path_a), load(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.bytes_a, self.bytes_b = (_objects(t.bytes) for t in (self.a, self.b))
        # Ids as they are written, before the next token of a group, and as the last one of theirs.
        self.text_a = np.array([f"{k}{c}" for c in ",|" for k in range(len(self.a.bytes))], object)
        self.text_b = np.array([f"{k}{c}" for c in ",;" for k in range(len(self.b.bytes))], object)
        self.forget()

    def forget(self) -> None:
        # The place of a run among those met, -1 if it doesn't come back; their tokens lie one behind the other.
        self.known: dict[str, int] = {}
        self.ids = [np.empty(0, np.int32)] * 2
        self.first = [np.zeros(1, np.int64)] * 2

    def parts(self, text: str) -> list[str]:
        """The text cut in runs, each without the space that begins it."""
        return _CUT.split(text) if self.a.cuts and self.b.cuts else [text]

    def learn(self, parts: list[str], forget: bool = True) -> None:
        """Tokens of runs; none for a run whose bytes either tokenizer changes."""
        if forget and len(self.known) > REMEMBERED:
            self.forget()
        new = [x for x in parts if x not in self.known]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        n = len(self.first[0]) - 1
        for k in range(0, len(new), AT_ONCE):
            some = new[k : k + AT_ONCE]
            runs = [b" " + x.encode() for x in some]
            ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
            both = [self.a.flat(some, ends), self.b.flat(some, ends)]
            if self._come_back(both, b"".join(runs), ends):
                self.known.update(zip(some, range(n, n + len(some)), strict=True))
            else:
                for x, run in zip(some, runs, strict=True):
                    own = np.array([len(run)])
                    alone = [self.a.flat([x], own), self.b.flat([x], own)]
                    fits = self._come_back(alone, run, own)
                    self.known[x] = n if fits else -1
                    if fits:
                        n += 1
                        for tokens, one in zip(found, alone, strict=True):
                            tokens.append(one)
                continue
            n += len(some)
            for tokens, of_some in zip(found, both, strict=True):
                tokens.append(of_some)
        for k, more in enumerate(found):
            if more:
                self.ids[k] = np.concatenate([self.ids[k], *[ids.astype(np.int32) for ids, _ in more]])
                self.first[k] = np.append(self.first[k], self.first[k][-1] + np.cumsum(np.concatenate([n for _, n in more])))

    def _come_back(self, both: list[tuple[np.ndarray, np.ndarray]], want: bytes, ends: np.ndarray) -> bool:
        """Whether both tokenizers give every run back. Together they do if each has its length."""
        for (ids, counts), sizes, spelled in zip(both, (self.size_a, self.size_b), (self.bytes_a, self.bytes_b), strict=True):
            upto = np.concatenate([[0], np.cumsum(sizes[ids])])
            if not np.array_equal(upto[np.cumsum(counts)], ends) or b"".join(spelled[ids].tolist()) != want:
                return False
        return True

    def tokens(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs at their places, those of A (``k`` = 0) or of B, and how many each has."""
        n = np.where(at < 0, 0, self.first[k][at + 1] - self.first[k][at])
        begin = np.cumsum(n) - n
        return self.ids[k][np.repeat(self.first[k][at] - begin, n) + np.arange(n.sum())].astype(np.int64), n

    def slice(self, texts: list[str | None]) -> dict:
        """Figures of every text, and what the texts hold of each run and pair."""
        cut = [self.parts(t) if t else [] for t in texts]
        place = {x: k for k, x in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        runs = [list(map(place.__getitem__, here)) for here in cut]
        self.learn(list(place))
        odd = np.fromiter((self.known[x] < 0 for x in place), bool, len(place))
        if odd.any():  # a run that doesn't come back may do so in its whole text
            touched = [k for k, here in enumerate(runs) if odd[here].any()]
            whole = {k: place.setdefault(texts[k], len(place)) for k in touched}
            self.learn([texts[k] for k in touched], forget=False)
            for k in touched:
                runs[k] = [whole[k]] if self.known[texts[k]] >= 0 else []
        at = np.fromiter(map(self.known.__getitem__, place), np.int64, len(place))
        (a, n_a), (b, n_b) = self.tokens(at, 0), self.tokens(at, 1)
        at_a, at_b, closes = overlaps(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        run_of = np.repeat(np.arange(len(at)), n_a)[at_a]
        n_links, n_groups = np.bincount(run_of, minlength=len(at)), np.bincount(run_of[closes], minlength=len(at))
        written = self._written(a, b, at_a[closes], at_b[closes], n_a + n_b)
        docs = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
        flat = np.fromiter(chain.from_iterable(runs), np.int64, len(docs))
        total = lambda x: np.bincount(docs, x[flat], len(texts)).astype(np.int64)
        sums = {"n_a": total(n_a), "n_b": total(n_b), "n_groups": total(n_groups), "n_links": total(n_links)}
        sums["groups_sha256"] = [hashlib.sha256("".join([written[k] for k in r])[:-1].encode()).hexdigest() if r else "" for r in runs]
        # What the slice holds: runs of a text, pairs of a run, and how many texts hold each pair.
        entries, times = np.unique(docs * len(at) + flat, return_counts=True)
        doc, run = np.divmod(entries, max(1, len(at)))
        pairs, pair = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
        first = np.concatenate([[0], np.cumsum(n_links)])
        count = n_links[run]
        link = np.repeat(first[run] - np.cumsum(count) + count, count) + np.arange(count.sum())
        held = np.unique(np.repeat(doc, count) * max(1, len(pairs)) + pair[link]) % max(1, len(pairs))
        return sums | {"packed": [_pack(x) for x in (doc, run, times, n_links, pair, pairs, np.bincount(held, minlength=len(pairs)))]}

    def _written(self, a, b, last_a, last_b, size) -> list[str]:
        """``a1,a2|b1;`` and so on of every run: A tokens of a group come before its B tokens."""
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        before_b, upto_a = np.concatenate([[0], last_b + 1]), last_a + 1
        out = np.empty(len(a) + len(b), object)
        ends = np.zeros(len(a), np.int64)
        ends[last_a] = len(self.a.bytes)
        out[np.arange(len(a)) + before_b[group_a]] = self.text_a[a + ends]
        ends = np.zeros(len(b), np.int64)
        ends[last_b] = len(self.b.bytes)
        out[np.arange(len(b)) + upto_a[group_b]] = self.text_b[b + ends]
        cuts, out = [0, *np.cumsum(size).tolist()], out.tolist()
        return ["".join(out[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


_ALIGNERS: dict[tuple[str, str], _Aligner] = {}


def _aligner(path_a: str, path_b: str) -> _Aligner:
    """Loaded once a worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = _Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed steps from one to the next."""
    steps = np.diff(x, prepend=0).astype("<i8")
    narrow = steps.astype("<i4") if not len(steps) or abs(steps).max() < 2**31 else steps
    raw = narrow.tobytes()
    return narrow.dtype.itemsize.to_bytes(1, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True) if int.from_bytes(data[1:9], "little") else b""
    return np.cumsum(np.frombuffer(raw, f"<i{data[0]}").astype(np.int64))


_SUMS = ["n_a", "n_b", "n_groups", "n_links"]
_FIGURES = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _SUMS], ("groups_sha256", pa.string())])
_SLICE = pa.schema([("slice", pa.int64()), *[(f.name, pa.list_(f.type)) for f in _FIGURES], ("packed", pa.list_(pa.binary()))])
_HELD = pa.schema([("slice", pa.int64()), ("pair", pa.int64()), ("held", pa.int64())])
_OUT = pa.schema([*_FIGURES, ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} " + (f"array<{kinds[f.type.value_type]}>" if pa.types.is_list(f.type) else kinds[f.type]) for f in schema)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, packed in zip(batch.column("slice").to_pylist(), batch.column("packed"), strict=True):
            pairs, held = (_unpack(packed[k].as_py()) for k in (5, 6))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), key)), pa.array(pairs), pa.array(held)], schema=_HELD)


def _figures(key, rows: pa.Table, counts: pa.Table) -> pa.Table:
    """A slice's rows, its pairs' counts having come back."""
    if not len(rows):
        return _OUT.empty_table()
    doc, run, times, n_links, pair, pairs, _ = (_unpack(x.as_py()) for x in rows["packed"][0])
    figures = {f.name: rows[f.name][0].values for f in _FIGURES}
    at = np.searchsorted(pairs, counts["pair"].to_numpy())
    first = np.concatenate([[0], np.cumsum(n_links)])
    for name in ("n_best", "count_sum"):
        value = np.zeros(len(pairs), np.int64)
        value[at] = counts[name].to_numpy()
        upto = np.concatenate([[0], np.cumsum(value[pair])])
        each = times * (upto[first[1:]] - upto[first[:-1]])[run]
        out = np.zeros(len(figures["doc_id"]), np.int64)
        np.add.at(out, doc, each)
        figures[name] = pa.array(out)
    return pa.Table.from_arrays([figures[f.name] for f in _OUT], schema=_OUT)


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 for every row of ``docs``.

    ``path_a`` is a byte-level file of the tokenizers library, ``path_b`` a sentencepiece model, both found on every executor. A gets the text
    after a space, B puts it there itself. Texts that are null, empty, or not given back by either tokenizer have no
    tokens: zeros and an empty digest. A pair's count is how many rows hold it linked, repeated rows each for itself; n_best counts links whose
    count no other pair of the same A id exceeds. No rows give no rows; extra columns are dropped.
    """

    def tokens(batches):
        part, n = TaskContext.get().partitionId(), 0
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for rows, _, _ in slices(batch):
                found = aligner.slice(rows.column("text").to_pylist())
                row = {"slice": part << 32 | n, "doc_id": rows.column("doc_id").to_pylist()} | found
                yield pa.RecordBatch.from_pylist([{k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in row.items()}], _SLICE)
                n += 1

    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    cut = settle(named.mapInArrow(tokens, _sql(_SLICE)))
    held = cut.select("slice", "packed").mapInArrow(_held, _sql(_HELD))
    counts = held.groupBy("pair").agg(F.sum("held").alias("count_sum"))
    a_id = F.shiftright("pair", 32)
    counts = settle(counts)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("count_sum").alias("most"))
    # A row for each id of A's vocabulary at most.
    judged = counts.join(F.broadcast(best), a_id == F.col("a")).select("pair", "count_sum", (F.col("count_sum") == F.col("most")).cast("bigint").alias("n_best"))
    answers = held.select(F.col("slice").alias("at"), "pair").join(judged, "pair").select("at", "pair", "count_sum", "n_best")
    figures = cut.groupBy("slice").cogroup(answers.groupBy("at")).applyInArrow(_figures, _sql(_OUT))
    return figures.select("doc_id", *_SUMS, "n_best", "count_sum", "groups_sha256")
