"""CSV files whose quoted fields hold line breaks, read by many tasks.

Whether a line begins inside a quoted field follows from how many quotes stand before it in its file. Each split counts its own; a
running total over the table of splits says how each begins, and with that every line knows its record. Only lines of records of several
lines come together again, record by record; records are then parsed by Spark's CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, START, SPLIT = "__file", "__start", "__split"
_LINE = f"{FILE} string, {START} bigint, {SPLIT} string, name string, value string, line bigint, odd boolean, open boolean, outside bigint, inside bigint"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append to each line: its place in its split, whether its quotes are odd in number, whether they are before it in the split, and how
    many records have begun up to it if the split begins outside of a quoted field, or inside of one.

    A task reads its splits one after the other, lines in order; what is remembered between batches is four numbers.
    """
    current, state = None, (0, 0, 0, 0)
    for batch in batches:
        split = pc.run_end_encode(batch.column(SPLIT))
        ends, names = split.run_ends.to_numpy(), split.values.to_pylist()
        value = batch.column("value")
        quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        # An empty line outside of quotes is no record.
        full = pc.greater(pc.binary_length(pc.utf8_rtrim(value, "\r")), 0).to_numpy(zero_copy_only=False)
        columns = []
        for a, b, name in zip([0, *ends[:-1]], ends, names, strict=True):
            line, before, outside, inside = state if name == current else (0, 0, 0, 0)
            upto = before + np.cumsum(quotes[a:b])
            odd_before = (upto - quotes[a:b]) % 2 == 1
            from_outside = outside + np.cumsum(~odd_before & full[a:b])
            from_inside = inside + np.cumsum(odd_before & full[a:b])
            columns.append((line + np.arange(b - a), quotes[a:b] % 2 == 1, odd_before, from_outside, from_inside))
            current, state = name, (line + int(b - a), int(upto[-1]), int(from_outside[-1]), int(from_inside[-1]))
        added = [np.concatenate(x) for x in zip(*columns, strict=True)] if columns else [np.empty(0, t) for t in (np.int64, bool, bool, np.int64, np.int64)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], [*batch.schema.names, "line", "odd", "open", "outside", "inside"])


def read_records(spark: SparkSession, glob: str, name: Column) -> DataFrame:
    """name, ord (-1 for the header), record (text) of every record of the files; ``name`` is made of their ``_metadata``.

    Quotes must stand around fields, and doubled within: a quote in an unquoted field turns the meaning of all that follows in its file.
    Lines end in \\n or \\r\\n; empty ones between records are skipped. In a file whose first line ends in \\r\\n, those within fields become \\n.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(glob)
    lines = lines.select(file.alias(FILE), start.alias(START), F.concat_ws(":", file, start).alias(SPLIT), name.alias("name"), "value")
    placed = lines.mapInArrow(_placed, _LINE)
    sums = placed.groupBy(FILE, START, SPLIT).agg(
        F.max(F.struct("line", F.col("open") != F.col("odd"))).alias("end"), F.max("outside").alias("outside"), F.max("inside").alias("inside"),
        F.max((F.col("line") == 0) & (F.col(START) == 0) & F.col("value").endswith("\r")).alias("crlf"),
    )
    # One row for each split.
    earlier = Window.partitionBy(FILE).orderBy(START).rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("inside_first", F.coalesce(F.sum(F.col("end").getField("col2").cast("int")).over(earlier), F.lit(0)) % 2 == 1)
    own = F.when(F.col("inside_first"), F.col("inside")).otherwise(F.col("outside"))
    crlf = F.max("crlf").over(Window.partitionBy(FILE)).alias("crlf")
    begun = begun.select(SPLIT, "inside_first", crlf, F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("records"))
    known = placed.join(begun, SPLIT)
    inside = F.col("open") != F.col("inside_first")
    record = F.col("records") + F.when(F.col("inside_first"), F.col("inside")).otherwise(F.col("outside")) - 2
    known = known.select(FILE, START, "line", "name", "value", "odd", "crlf", inside.alias("within"), record.alias("ord"))
    whole = known.where("NOT within AND NOT odd AND rtrim('\r', value) != ''").select("name", "ord", "value")
    parts = known.where("within OR odd").groupBy(FILE, "name", "ord", "crlf").agg(F.sort_array(F.collect_list(F.struct(START, "line", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    joined = parts.select("name", "ord", F.when(F.col("crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text).alias("value"))
    return whole.unionByName(joined).select("name", "ord", F.expr("rtrim('\r', value)").alias("record"))


def read_csv(spark: SparkSession, glob: str, header: tuple[str, ...], name: Column) -> DataFrame:
    """name, ord and a struct ``row`` of text fields. A file whose header differs is an error."""
    records = read_records(spark, glob, name)
    plain = F.regexp_replace("record", '["﻿]', "")
    wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the schema: "), plain)).cast("boolean")
    checked = records.where(F.when(F.col("ord") >= 0, True).when(plain == ",".join(header), False).otherwise(wrong))
    schema = ", ".join(f"`{h}` string" for h in header)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return checked.select("name", "ord", F.from_csv("record", schema, options).alias("row"))
