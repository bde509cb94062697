"""Groups of spelling variants: words one letter apart, found in a trie of letter-group counts.

Letters fall into ``GROUPS`` groups by their code point; a word's vector holds how many of its letters are in each. The words are
arranged in a trie by the successive counts. Words one inserted, deleted or replaced letter apart have vectors with a surplus of at most one
and a deficit of at most one in all, so a word searches the trie depth-first and spends that budget on the way down; the words of a
leaf that it reaches are compared letter by letter.

The upper levels of the trie are a table: words go down ``STEP`` levels at a time by joins with the nodes that exist, and a node is
handed to one task as soon as it has ``SUBTRIE`` words or fewer, small ones together. Words that all share every count are dealt out
in tiles, and the visitors of a task's nodes in portions, so that no task gets an unbounded group.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.llm.common import settle, union_all
from commentlens.llm.words import Words, lower_case, slices

GROUPS = 16
STEP = 2
SUBTRIE = 65_536
VISITORS = 65_536
#: A range of the trie with so many words or fewer is a leaf.
LEAF = 32
#: So many pairs of vectors are compared at once.
PAIRS = 1 << 18
#: Words of so many letters or fewer are compared as rows of a matrix.
WIDE = 24
#: Letters at either end of a word; one edit in a word of twice as many changes those at one end only.
EDGE = 3
_WORD, _NEAR = "word string, n bigint, vec bigint", "word string, n_near bigint, best struct<lost:bigint,word:string>"


def _in_run(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 are in a run: a-z, and À-ÿ, which are the two-byte letters that begin with C3."""
    long = data == 0xC3
    after = np.concatenate([[False], long[:-1]])
    return ((data >= 97) & (data <= 122)) | long | (after & (data >= 0x80) & (data < 0xC0))


def _checksums(w: Words, before: np.ndarray) -> np.ndarray:
    """crc32 of every run, continued from ``before``, the checksum of what comes before it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out, size = ~before, w.ends - w.starts
    todo, k = np.arange(len(size)), 0
    while todo.size:
        out[todo] = table[(out[todo] ^ w.data[w.starts[todo] + k]) & 255] ^ (out[todo] >> 8)
        k += 1
        todo = todo[size[todo] > k]
    return ~out


def _counted(slip_every: int | None):
    def count(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                lower = lower_case(data)
                w = Words(lower, offsets, inside=_in_run(lower))
                plain, slipped = np.ones(len(w.names), bool), Counter()
                if slip_every:
                    start = [zlib.crc32(f"{'' if key is None else key}:".encode()) for key in rows.column("id").to_pylist()]
                    h = _checksums(w, np.repeat(np.array(start, np.uint32), w.counts))
                    plain = h % slip_every != 0
                    for k in np.flatnonzero(~plain):
                        run = lower[w.starts[k] : w.ends[k]].tobytes().decode()
                        at = int(h[k]) % len(run)
                        slipped[run[:at] + run[at + 1 :]] += 1
                _, at, n = np.unique(w.names[plain], return_index=True, return_counts=True)
                starts, ends = w.starts[plain][at], w.ends[plain][at]
                edges = np.concatenate([[0], np.cumsum(ends - starts)])
                letters = lower[np.repeat(starts - edges[:-1], ends - starts) + np.arange(edges[-1])]
                words = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(letters))
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(list(slipped), pa.string()), pa.array(list(slipped.values()), pa.int64())], ["word", "n"])

    return count


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip_every: int | None = None) -> DataFrame:
    """(word, n): the runs of letters a-z and À-ÿ of whole texts, A-Z in lower case, and how often each occurs.

    ``slip_every`` plants variants to try the operator on: a run loses a letter where that number divides the crc32 of
    ``<doc_id>:<run>``; the checksum also says which. A null id is empty there. Runs are counted by slice of texts, under 64-bit names, before
    anything is shuffled. A null text has no runs; without runs there are no rows.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counted(slip_every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # bisect for the first difference
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low:] == b[low + 1 :] if len(a) < len(b) else a[low + 1 :] == b[low + 1 :]


def count_vectors(words: list[str]) -> np.ndarray:
    """Letters of every word in each group, one row a word."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    cells = np.bincount(owner * GROUPS + points % GROUPS, minlength=len(words) * GROUPS)
    return cells.reshape(len(words), GROUPS).astype(np.int32)


#: A vector as one number has four bits a group, the highest of them free to hold what a subtraction borrows.
_BITS, _MOST = 4, 7
_FREE, _ONES = np.uint64(0x8888888888888888), np.uint64(0x1111111111111111)
_SHIFTS = np.arange(GROUPS, dtype=np.uint64) * np.uint64(_BITS)


def _packed(vectors: np.ndarray) -> np.ndarray:
    """Vectors as numbers. Counts above 7 count as 7, which only brings vectors nearer to each other."""
    return (np.minimum(vectors, _MOST).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def _unpacked(numbers: np.ndarray) -> np.ndarray:
    return ((numbers[:, None] >> _SHIFTS) & np.uint64(_MOST)).astype(np.int8)


def _with_vectors(batches):
    for batch in batches:
        packed = _packed(count_vectors(batch.column("word").to_pylist())).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(packed)], ["word", "n", "vec"])


def reached(members: np.ndarray, visitors: np.ndarray):
    """(visitor, first, last) for every leaf that visitors reach; ``members`` are vectors in lexical order.

    Depth-first: a node is a range of members with a common beginning; visitors whose surplus or deficit would exceed one stay behind.
    """
    none = np.zeros(len(visitors), np.int64)
    stack = [(0, 0, len(members), np.arange(len(visitors)), none, none)]
    while stack:
        depth, low, high, here, surplus, deficit = stack.pop()
        if high - low <= LEAF or depth == GROUPS:
            yield here, low, high
            continue
        column = members[low:high, depth]
        cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1), high - low]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            more = visitors[here, depth] - column[a]
            over, under = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
            fits = (over <= 1) & (under <= 1)
            if fits.any():
                stack.append((depth + 1, low + a, low + b, here[fits], over[fits], under[fits]))


def _within_budget(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which packed vectors differ by one more in one group at most, and one less in one group at most."""
    x = ((a | _FREE) - b) ^ _FREE  # in each group 0 where equal, 1 for one more, 15 for one less
    less = (x >> np.uint64(3)) & _ONES
    low = x & _ONES
    more = low & ~less
    small = (((x >> np.uint64(1)) & _ONES) == less) & (((x >> np.uint64(2)) & _ONES) == less) & ((less & ~low) == 0)
    return small & ((more & (more - np.uint64(1))) == 0) & ((less & (less - np.uint64(1))) == 0)


class _Letters:
    """Words as rows of code points, from the left and from the right; longer words than ``WIDE`` have none there."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        fits = self.size <= WIDE
        points = np.frombuffer("".join(w for w in words if len(w) <= WIDE).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.flatnonzero(fits), self.size[fits])
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.size[fits]) - self.size[fits], self.size[fits])
        self.left, self.right = np.zeros((len(words), WIDE), np.uint32), np.zeros((len(words), WIDE), np.uint32)
        self.left[owner, place] = points
        self.right[owner, self.size[owner] - 1 - place] = points
        self.start, self.end = self._edge(self.left), self._edge(self.right)

    @staticmethod
    def _edge(letters: np.ndarray) -> np.ndarray:
        return sum(letters[:, k].astype(np.int64) << (21 * k) for k in range(EDGE))

    def near(self, mine: np.ndarray, other: _Letters, theirs: np.ndarray) -> np.ndarray:
        """Which pairs are exactly one edit apart: what they share at both ends leaves at most one letter, and they differ."""
        a, b = self.size[mine], other.size[theirs]
        out = (self.start[mine] == other.start[theirs]) | (self.end[mine] == other.end[theirs]) | (np.minimum(a, b) < 2 * EDGE)
        out &= np.abs(a - b) <= 1
        long = out & ((a > WIDE) | (b > WIDE))
        for k in np.flatnonzero(long):
            out[k] = one_edit_apart(self.words[mine[k]], other.words[theirs[k]])
        todo = np.flatnonzero(out & ~long)
        mine, theirs, a, b = mine[todo], theirs[todo], a[todo], b[todo]
        shared = np.zeros(len(todo), np.int64)
        for x, y in ((self.left, other.left), (self.right, other.right)):
            differ = x[mine] != y[theirs]
            first = np.where(differ.any(1), differ.argmax(1), WIDE)
            same = first >= np.maximum(a, b)
            shared += np.where(same, -2 * WIDE, np.minimum(first, np.minimum(a, b)))
        out[todo] = shared >= np.maximum(a, b) - 1
        return out


def _search(key, members: pa.Table, visitors: pa.Table) -> pa.Table:
    """What every visitor finds in one part of the trie: how many near words, and of those the one of largest n, then smallest."""

    if not len(members) or not len(visitors):
        return _SCHEMA.empty_table()
    packed, their_packed = visitors["sought"].to_numpy().view(np.uint64), members["vec"].to_numpy().view(np.uint64)
    theirs, mine = _unpacked(their_packed), _unpacked(packed)
    order = np.lexsort(theirs.T[::-1])
    theirs, their_packed, members = theirs[order], their_packed[order], members.take(order)
    words, n, seekers = _Letters(members["word"].to_pylist()), members["n"].to_numpy(), _Letters(visitors["seeker"].to_pylist())
    found_by, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for here, low, high in reached(theirs, mine):
        step = max(1, PAIRS // (high - low))
        for start in range(0, len(here), step):
            some = here[start : start + step]
            v, m = np.nonzero(_within_budget(packed[some, None], their_packed[None, low:high]))
            v, m = some[v], low + m
            near = seekers.near(v, words, m)
            found_by.append(v[near])
            found.append(m[near])
    v, m = np.concatenate(found_by), np.concatenate(found)
    rank = np.empty(len(n), np.int64)
    rank[sorted(range(len(n)), key=words.words.__getitem__)] = np.arange(len(n))
    by = np.lexsort((rank[m], -n[m], v))
    v, m = v[by], m[by]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    best = pa.StructArray.from_arrays([pa.array(-n[m[first]]), pa.array([words.words[k] for k in m[first]], pa.string())], ["lost", "word"])
    near = np.diff(np.append(first, len(v)))
    return pa.Table.from_arrays([pa.array([seekers.words[k] for k in v[first]], pa.string()), pa.array(near, pa.int64()), best], schema=_SCHEMA)


_SCHEMA = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("lost", pa.int64()), ("word", pa.string())]))])


def _moves(depth: int) -> Column:
    """Ways to spend of the budget on the ``STEP`` levels above ``depth``: what to take from a vector, the level of its surplus, and the cost."""
    levels = range(depth - STEP, depth)
    ways = [(over, under) for over in (None, *levels) for under in (None, *levels) if over is None or over != under]

    def way(over: int | None, under: int | None) -> Column:
        take = sum(sign << (_BITS * k) for sign, k in ((1, over), (-1, under)) if k is not None)
        return F.struct(
            F.lit(take).cast("bigint").alias("take"), F.lit(_BITS * (over or 0)).alias("at"),
            F.lit(int(over is not None)).alias("over"), F.lit(int(under is not None)).alias("under"),
        )

    return F.array(*[way(*w) for w in ways])


def _node(vec: Column, depth: int) -> Column:
    """The node that holds a vector: its counts down to ``depth``."""
    return vec.bitwiseAND(F.lit((1 << (_BITS * depth)) - 1).cast("bigint"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of every word that has near words; ``words`` are distinct words with their n.

    best.word is the near word of largest n = -best.lost, of equal ones the smallest in code-point order.
    """
    rooted = settle(words.select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(_with_vectors, _WORD))
    members, visits = [], []
    down = rooted.withColumn("node", F.lit(0).cast("bigint"))
    # Vectors travel, not words: many words share one. spent is what has been taken from the vector so far.
    frontier = rooted.select("vec").distinct().withColumns({"spent": F.lit(0).cast("bigint"), "over": F.lit(0), "under": F.lit(0)})
    for depth in range(STEP, GROUPS + 1, STEP):
        down = down.withColumn("node", _node(F.col("vec"), depth))
        nodes = down.groupBy("node").agg(F.count("*").alias("size"))
        tiles = F.ceil(F.col("size") / SUBTRIE) if depth == GROUPS else F.when(F.col("size") <= SUBTRIE, 1)
        nodes = settle(nodes.select("node", tiles.cast("int").alias("tiles")))  # no tiles: to be divided further down
        tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
        down = down.join(nodes, "node")
        members.append(down.where("tiles IS NOT NULL").select("word", "n", "vec", "node", tile.alias("tile")))
        spread = frontier.withColumn("move", F.explode(_moves(depth))).where(
            "over + move.over <= 1 AND under + move.under <= 1 AND (move.over = 0 OR (shiftright(vec, move.at) & 15) > 0)"
        )
        spread = spread.selectExpr("vec", "spent + move.take AS spent", "over + move.over AS over", "under + move.under AS under")
        frontier = settle(spread.withColumn("node", _node(F.col("vec") - F.col("spent"), depth)).join(nodes, "node"))
        ended = frontier.where("tiles IS NOT NULL")
        visits.append(ended.select("vec", "node", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")))
        if nodes.where("tiles IS NULL").isEmpty():
            break
        down, frontier = down.where("tiles IS NULL").drop("tiles"), frontier.where("tiles IS NULL").drop("tiles", "node")
    have, seek = union_all(members), union_all(visits)
    # A part holds several small nodes; a visitor of any of them searches it once.
    parts = max(1, math.ceil(rooted.count() / SUBTRIE))
    part = F.pmod(F.xxhash64("node", "tile"), F.lit(parts)).cast("int").alias("part")
    seek = seek.select("vec", part).distinct().join(rooted.select("word", "vec"), "vec")
    load = seek.groupBy("part").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("portions"))
    have = have.select("word", "n", "vec", part).join(load, "part").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    # Both sides come from the same words: new names tell their columns apart.
    portion = F.pmod(F.xxhash64("word"), F.col("portions")).cast("int").alias("at_portion")
    seek = seek.join(load, "part").select(F.col("word").alias("seeker"), F.col("vec").alias("sought"), F.col("part").alias("at_part"), portion)
    found = have.groupBy("part", "portion").cogroup(seek.groupBy("at_part", "at_portion")).applyInArrow(_search, _NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variant_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; distinct words, extra columns are dropped).

    A word's form is the near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times its own, else
    null; its root is the last word that forms lead to, itself without a form. ``ratio`` is above 1, so forms never lead back.
    Null and empty words have no near words. No words give no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = settle(words.select("word", F.col("n").cast("bigint").alias("n")))
    near = near_words(words.where("word != ''"))
    form_n = -F.col("best.lost")
    formed = F.when(form_n >= ratio * F.col("n"), F.struct(F.col("best.word").alias("word"), form_n.alias("n")))
    judged = settle(
        words.join(near, "word", "left")
        .withColumn("form", formed)
        .select("word", F.col("form.word").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("form.n").alias("form_n"))
    )
    # Pointers are doubled until all end at a root; a path is as long as the logarithm of the largest n at most.
    path = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        up = path.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = settle(path.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        path = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    rooted = judged.join(path, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rooted.select("word", "form", "root", "n", "n_near", "form_n")
