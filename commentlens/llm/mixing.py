"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents are drawn in a shuffled order, the whole source again when it is used up. A draw finishes at the
source's cumulative words divided by its target, so every source reaches its target at virtual time 1 whatever its size.
Draws ordered by finish time are taken until the total budget is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens.llm.common import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
TIMES = 2
#: A source is summed up in this many slices of the shuffled order, so no task holds a whole source.
SLICES = 4096
#: Draws at the cut that one task may order.
CUT_ROWS = 10_000
CELLS = 4096


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(renamed, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]).drop(*[f"__{k}" for k in keys])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = TIMES) -> tuple[DataFrame, float]:
    """(source, rank, source_size, target) and the total budget, ``share`` times all words.

    Sources by code point, null last, weigh ``weights`` in turn and share the budget; what a source can't give, being
    drawn ``times`` times at most, goes to the others by weight. A source is one row here, documents are summed before.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = settle(sums.withColumn("rank", rank))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("double")
    most = F.col("source_size") * F.lit(float(times))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rest, free, full = budget, sources.agg(F.sum(weight)).first()[0] or 1.0, 0
    while True:
        capped = (weight * F.lit(rest)) / F.lit(free) > most
        now = sources.agg(F.count_if(capped), F.sum(F.when(capped, most)), F.sum(F.when(~capped, weight))).first()
        if now[0] == full or not now[2]:
            break
        full, rest, free = now[0], budget - now[1], now[2]
    capped = (weight * F.lit(rest)) / F.lit(free) > most
    return sources.withColumn("target", F.when(capped, most).otherwise((weight * F.lit(rest)) / F.lit(free))), budget


def _order_key(doc_id: Column) -> Column:
    """The shuffled order: 60 bits of a digest of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _queued(docs: DataFrame, sources: DataFrame, cells: DataFrame) -> DataFrame:
    """``docs`` with cumulative words of the source, in slices of the shuffled order."""
    placed = _null_safe(docs, cells, ["source", "slice"])
    within = Window.partitionBy("source", "slice").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("cumulative", F.col("before") + F.sum("size").over(within))


def _draw(time: int) -> Column:
    """Sort key of the ``time``-th draw of a document: finish time, then rank of the source and shuffled order."""
    finish = F.try_divide(F.lit(time) * F.col("source_size") + F.col("cumulative"), F.col("target"))
    return F.struct(finish.alias("finish"), F.col("rank").cast("int").alias("rank"), F.lit(time).alias("time"), "order_key", "doc_id", "size")


def _cut(draws: DataFrame, budget: float) -> dict:
    """The last draw that the budget covers. Cells of finish time are summed, then the cell of the cut, until few are left."""
    low, high, used = 0.0, 2.0, 0
    while True:
        inside = draws.where((F.col("d.finish") >= low) & (F.col("d.finish") < high)) if high > low else draws.where(F.col("d.finish") == low)
        cell = F.floor((F.col("d.finish") - low) / max(high - low, 1e-300) * CELLS)
        cells = sorted(inside.groupBy(cell.alias("c")).agg(F.sum("size"), F.count("*")).collect())
        at = 0
        while at < len(cells) and used + cells[at][1] <= budget:
            used += cells[at][1]
            at += 1
        if at == len(cells):
            if high >= 1e300 or high < 2.0:
                return {"below": high, "row": None}
            low, high = high, float("inf")
            inside, few = draws.where(F.col("d.finish") >= low), True
        else:
            width = (high - low) / CELLS
            low, high = low + cells[at][0] * width, low + (cells[at][0] + 1) * width
            inside = draws.where((F.col("d.finish") >= low) & (F.col("d.finish") < high))
            few = cells[at][2] <= CUT_ROWS or width < 1e-13
        if few:
            upto = F.sum("size").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
            row = inside.withColumn("upto", upto + used).where(F.col("upto") <= budget).agg(F.max("d")).first()[0]
            return {"below": low, "row": row}


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """``docs`` (doc_id, source, size and any other columns) with source_size, target, times_taken, finish (of each time taken).

    Draws never exceed the budget, ``share`` of all sizes; a source ends within a document or two of its target, and no
    document is drawn more than ``times`` times. Documents of size 0 or null, or of a source without words, are never
    drawn. Missing sources are one source; missing ids are ordered by size. Equal rows are documents of their own, of
    which it doesn't matter which is drawn. Columns named like the added ones are replaced. No rows give no rows.
    """
    docs = docs.drop("source_size", "target", "times_taken", "finish", "order_key", "slice", "before", "rank", "cumulative")
    size = F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")
    narrow = docs.select("doc_id", "source", size)
    order_key = _order_key(F.col("doc_id"))
    slice_ = F.floor(order_key / F.lit((1 << 60) // SLICES)).cast("int")
    keyed = settle(narrow.withColumn("order_key", order_key).withColumn("slice", slice_))
    sources, budget = source_targets(keyed, weights, share, times)
    sources = settle(sources)
    sums = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    cells = settle(_null_safe(sums.withColumn("before", before).drop("slice_size"), sources, ["source"]))

    queued = settle(_queued(keyed.where("size > 0"), sources, cells).where("target > 0"))
    draws = queued.select("size", F.explode(F.array(*[_draw(t) for t in range(times)])).alias("d"))
    cut = _cut(draws, budget)

    def taken(time: int) -> Column:
        d = _draw(time)
        below = d["finish"] < F.lit(cut["below"])
        row = cut["row"]
        if row is not None:
            kinds = {"finish": "double", "rank": "int", "time": "int", "order_key": "long", "doc_id": docs.schema["doc_id"].dataType, "size": "long"}
            last = F.struct(*[F.lit(row[n]).cast(kind).alias(n) for n, kind in kinds.items()])
            below = below | (d <= last)
        return below & (F.col("size") > 0) & (F.col("target") > 0)

    full = _queued(docs.withColumn("size", size).withColumn("order_key", order_key).withColumn("slice", slice_), sources, cells)
    finishes = F.filter(F.array(*[F.when(taken(t), _draw(t)["finish"]) for t in range(times)]), lambda x: x.isNotNull())
    out = full.withColumn("finish", finishes).withColumn("times_taken", F.size("finish"))
    return out.drop("order_key", "slice", "before", "rank", "cumulative")


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw, ordered by finish time over all partitions."""
    draws = mixed.select(*[c for c in mixed.columns if c not in ("finish", "times_taken")], F.posexplode("finish").alias("time", "finish"))
    return draws.orderBy("finish", "source", "doc_id", "time")
