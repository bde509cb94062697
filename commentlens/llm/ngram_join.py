"""Exact Jaccard join on word shingles: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Documents with equal shingle sets become one node, named by a 64-bit digest of the set.
2. Every node lists a prefix of its shingles, rare ones first: two sets of Jaccard similarity t or more share a
   shingle of both prefixes, whatever the order, as long as all use the same. How common a shingle is comes from
   counts inside slices of the corpus, kept in a table of fixed size; it shapes the order, never the result.
3. Nodes that meet in a prefix shingle come into the group of that shingle's hub, the node that meets most others. A group
   is dealt into tiles of bounded size. In a tile, sets are compared along bands of sizes, and pairs are dropped when hashed
   bitmaps prove too small an overlap: a bit that only one of them has set is an element that the other lacks.
4. Arrays are fetched for the sets that keep a partner. In the same tiles, sorted arrays are intersected, first with the
   hub, then between sets that no link has joined yet, so thousands of near copies aren't compared pair by pair.
5. Links give connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.common import bit_filter, in_filter, settle
from commentlens.llm.components import components
from commentlens.llm.words import Words, mix, shingles, signed, slices, u64

PERCENT = 75
SHINGLE_WORDS = 5
#: Entries of the table that tells how common a shingle is (one byte each), as a power of two.
ORDER_BITS = 22
#: Bits of the filters that pick the documents whose arrays are needed, as a power of two (8 MB).
PICK_BITS = 26
#: Shingles that are counted together while a task looks for common ones.
COUNTED = 2_000_000
#: Members of one of the two blocks of a tile.
TILE = 512


def _node(s: np.ndarray) -> np.uint64:
    return mix(mix(s).sum(keepdims=True) + u64(len(s)))[0]


def _bitmap(s: np.ndarray) -> bytes:
    """Hashed bits of a set: as many bits as elements, rounded up to a power of two."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    set_bits = np.zeros(width, np.uint8)
    set_bits[(s & u64(width - 1)).astype(np.int64)] = 1
    return np.packbits(set_bits, bitorder="little").tobytes()


_SCAN = pa.schema({"doc_id": pa.int64(), "is_doc": pa.bool_(), "n": pa.int64(), "node": pa.int64(), "bits": pa.binary(), "shingles": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())})


def _scan(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of shingles that a few megabytes of the corpus hold more than once."""

    def common() -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        keep = counts > 1
        row = {"is_doc": False, "shingles": signed(found[keep]).tolist(), "counts": counts[keep].tolist()}
        return pa.RecordBatch.from_pylist([row], _SCAN)

    held: list[np.ndarray] = []
    for batch in batches:
        for rows, data, offsets in slices(batch):
            sets = list(shingles(Words(data, offsets, lower=True), words))
            out = [
                {"doc_id": i, "is_doc": True, "n": len(s), "node": int(_node(s).view(np.int64)), "bits": _bitmap(s)} if len(s) else {"doc_id": i, "is_doc": True, "n": 0}
                for i, s in zip(rows.column("doc_id").to_pylist(), sets, strict=True)
            ]
            yield pa.RecordBatch.from_pylist(out, _SCAN)
            held += sets
            if sum(map(len, held)) > COUNTED:
                yield common()
    if held:
        yield common()


def _order(scan: DataFrame) -> np.ndarray:
    """log2 of how often shingles were counted, by the low bits of the shingle; 0 for those below 8."""
    each = scan.where("not is_doc").select(F.explode(F.arrays_zip("shingles", "counts")).alias("x"))
    totals = each.groupBy(F.col("x.shingles").alias("s")).agg(F.sum("x.counts").alias("n")).where("n >= 8")
    cells = (
        totals.groupBy(F.col("s").bitwiseAND(F.lit((1 << ORDER_BITS) - 1)).alias("cell"))
        .agg(F.floor(F.log2(F.max("n"))).cast("int").alias("level"))
        .toArrow()
    )
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    out[cells["cell"].to_numpy()] = cells["level"].to_numpy()
    return out


def _prefixes(words: int, percent: int, order, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix of every distinct set of the task, a row for each shingle."""
    seen: set[int] = set()
    level = order.value
    for batch in batches:
        for _, data, offsets in slices(batch):
            tokens, nodes, sizes = [], [], []
            for s in shingles(Words(data, offsets, lower=True), words):
                if not len(s) or (node := int(_node(s).view(np.int64))) in seen:
                    continue
                seen.add(node)
                rank = level[(s & u64(len(level) - 1)).astype(np.int64)]
                if rank.any():
                    s = s[np.argsort(rank, kind="stable")]
                s = s[: len(s) - -(-percent * len(s) // 100) + 1]
                tokens.append(s)
                nodes.append(np.full(len(s), node))
                sizes.append(np.full(len(s), rank.size))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], ["token", "node", "n"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, size and node, each node once, those whose token has two nodes or more."""
    last, met = None, False  # the row before, and whether it has been emitted
    for batch in batches:
        x = np.column_stack([c.to_numpy() for c in batch.columns])
        if last is not None:
            x = np.vstack([last, x])
        new = np.r_[True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])]
        x = x[new]
        same = x[1:, 0] == x[:-1, 0]
        keep = np.r_[False, same] | np.r_[same, False]
        end = bool(keep[-1])
        keep[0] &= not met or last is None
        met = end if len(x) > 1 or last is None else met
        last = x[-1:]
        x = x[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], batch.schema.names)


def _plausible(sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of some sets in ascending order of size, the larger ones that bit counts don't rule out.

    A bit that only one of two sets has set is an element that the other lacks.
    """
    width = np.array([len(b) for b in bitmaps])
    at_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(width):
        all_bits = np.zeros((len(bitmaps), w), np.uint64)
        for k in np.flatnonzero((width == w) | (width == 2 * w)):
            all_bits[k] = bitmaps[k] if width[k] == w else bitmaps[k][:w] | bitmaps[k][w:]
        at_width[w] = all_bits, np.bitwise_count(all_bits).sum(axis=1, dtype=np.int64)
    ends = np.searchsorted(sizes * percent, sizes * 100, "right")
    for i in range(len(sizes) - 1):
        bits, counts = at_width[width[i]]
        others = slice(i + 1, ends[i])
        both = np.bitwise_count(bits[i] & bits[others]).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[i] - counts[i] + both, sizes[others] - counts[others] + both)
        fits = most * (100 + percent) >= percent * (sizes[i] + sizes[others])
        if fits.any():
            yield i, i + 1 + np.flatnonzero(fits)


def _in_tiles(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Deals the members of each hub (hub, node) into tiles of about ``2 * TILE`` members, so that any two share one.

    A tile is the union of two blocks, or one block. The payload of a node joins when its tiles are known, so it is
    shuffled only once more; rows come out sorted by tile.
    """
    blocks = members.groupBy("hub").count().select("hub", F.ceil(F.col("count") / TILE).cast("int").alias("k"))
    dealt = members.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    other = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = other.withColumn("i", F.least("block", "x")).withColumn("j", F.greatest("block", "x")).drop("k", "x")
    return rows.join(payload, "node").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def _each_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in ("hub", "i", "j")):
                yield {k: [x[k] for x in held] for k in held[0]}
                held = []
            held.append(row)
    if held:
        yield {k: [x[k] for x in held] for k in held[0]}


def _prune(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a tile that have a partner by size and bit counts."""
    for tile in _each_tile(batches):
        order = np.argsort(tile["n"], kind="stable")
        node, block = np.array(tile["node"])[order], np.array(tile["block"])[order]
        keep = np.zeros(len(node), bool)
        bitmaps = [np.frombuffer(tile["bits"][k], np.uint64) for k in order]
        for i, others in _plausible(np.array(tile["n"])[order], bitmaps, percent):
            if tile["i"][0] != tile["j"][0]:
                others = others[block[others] != block[i]]
            keep[others] = True
            keep[i] |= len(others) > 0
        found = pa.array(node[keep])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), tile["hub"][0])), found], ["hub", "node"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _exact(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a tile. Two sets that earlier links of the tile have joined aren't compared again."""
    for tile in _each_tile(batches):
        arrays = [np.frombuffer(x, np.uint64) for x in tile["array"]]
        order = np.argsort([len(x) for x in arrays], kind="stable")
        arrays = [arrays[k] for k in order]
        node, block = [tile["node"][k] for k in order], np.array(tile["block"])[order]
        part = np.arange(len(node))
        links = []

        def link(i: int, j: int, node=node, arrays=arrays, part=part, links=links) -> None:
            if part[i] != part[j] and _linked(arrays[i], arrays[j], percent):
                links.append((node[i], node[j]))
                part[part == part[j]] = part[i]

        sizes = np.array([len(x) for x in arrays])
        pairs = list(_plausible(sizes, [np.frombuffer(_bitmap(x), np.uint64) for x in arrays], percent))
        center = node.index(tile["hub"][0]) if tile["hub"][0] in node else -1
        for i, others in pairs:  # the hub links most of a group of near copies, which then needn't be compared
            for j in others if i == center else others[others == center]:
                link(i, j)
        for i, others in pairs:
            across = others[part[others] != part[i]]
            for j in across if tile["i"][0] == tile["j"][0] else across[block[across] != block[i]]:
                link(i, j)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _arrays(words: int, ids, nodes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle arrays of the picked nodes, once in a task. Only texts whose id is picked are read into words."""
    seen: set[int] = set()
    for batch in batches:
        key = batch.column("key").to_numpy().view(np.uint64)
        for rows, data, offsets in slices(batch.filter(pa.array(in_filter(ids.value, key)))):
            out = []
            for s in shingles(Words(data, offsets, lower=True), words):
                if len(s) and in_filter(nodes.value, _node(s).reshape(1))[0] and (node := int(_node(s).view(np.int64))) not in seen:
                    seen.add(node)
                    out.append((node, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], ["node", "array"])


def _tiles_of_hubs(shared: DataFrame) -> DataFrame:
    """(hub, node): for every shingle that several nodes list, all of them with the one that meets most others.

    Near copies meet in many shingles and mostly at the same hub, their original, so a node is in few groups.
    """
    counts = shared.groupBy("token").agg(F.count("*").alias("c"))
    score = shared.join(counts, "token").groupBy("node").agg(F.sum("c").alias("score"))
    scored = shared.join(score, "node")
    hubs = scored.groupBy("token").agg(F.max(F.struct("score", "node")).alias("x")).select("token", F.col("x.node").alias("hub"))
    return shared.join(hubs, "token").select("hub", "node").distinct()


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles, ASCII
    letters in lower case. component_id is the smallest doc_id that links lead to.

    A document without words (null or empty text, white space) has no set, no link and its own id. A shorter text than a
    shingle is one shingle. Rows of equal text are one component; so are rows that share a doc_id. A missing doc_id stays
    missing, and names a component only where no row has an id. Other columns are ignored. No rows give no rows.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = settle(texts.mapInArrow(partial(_scan, words), "doc_id long, is_doc boolean, n long, node long, bits binary, shingles array<long>, counts array<long>"))
    rows = scan.where("is_doc").select("doc_id", "n", "node")
    nodes = settle(scan.where("is_doc and n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("rep")))

    order = context.broadcast(_order(scan))
    prefixes = texts.select("text").mapInArrow(partial(_prefixes, words, percent, order), "token long, node long, n long")
    by_token = prefixes.repartition("token").sortWithinPartitions("token", "n", "node")
    shared = settle(by_token.mapInArrow(_meetings, "token long, node long, n long"))

    members = _in_tiles(_tiles_of_hubs(shared), nodes.select("node", "n", "bits"))
    left = settle(members.mapInArrow(partial(_prune, percent), "hub long, node long").distinct())
    needed = settle(left.select("node").distinct().join(nodes.select("node", "rep"), "node"))
    ids = context.broadcast(bit_filter(needed.select(F.xxhash64("rep").alias("key")), PICK_BITS))
    picked = context.broadcast(bit_filter(needed.select("node"), PICK_BITS))
    keyed = texts.select(F.xxhash64("doc_id").alias("key"), "text")
    arrays = keyed.mapInArrow(partial(_arrays, words, ids, picked), "node long, array binary").dropDuplicates(["node"])
    links = settle(_in_tiles(left, arrays).mapInArrow(partial(_exact, percent), "a long, b long").distinct())
    labels = components(links)

    # Rows of one doc_id are one document, whatever their texts.
    same = rows.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    same = same.where("a != b")
    if not same.isEmpty():
        hub = rows.join(same.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
        labels = components(links.union(hub))
    marked = rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = marked.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return marked.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )
