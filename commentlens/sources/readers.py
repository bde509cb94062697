"""Readers: many files of one kind become one DataFrame.

``post_id`` is the file's name without extension and stage suffix, ``ord`` the row's
position in its file, from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlens import schemas as S
from commentlens.sources import split_csv

FILE, START, SPLIT = "__file", "__start", "__split"


def _typed(name: str, kind: str) -> Column:
    """Text to number; a whole number may be spelled with a fraction of zeros."""
    text = F.col(name)
    if kind == "bigint":
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return text.try_cast(kind) if kind != "string" else text


def _number_within_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the row's position among the rows of its split.

    A task reads its splits one after the other, so rows of a split arrive together and
    in order; all that is remembered between batches is the split and a count.
    """
    current, seen = None, 0
    for batch in batches:
        runs = pc.run_end_encode(batch.column(SPLIT))
        ends = runs.run_ends.to_numpy()
        starts = np.concatenate(([0], ends[:-1]))
        offset = -starts
        if len(ends) and runs.values[0].as_py() == current:
            offset[0] += seen
        position = np.arange(batch.num_rows, dtype="int64") + np.repeat(offset, ends - starts)
        if len(ends):
            current, seen = runs.values[-1].as_py(), int(position[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(position, pa.int64())], [*batch.schema.names, "ord"]
        )


def _with_ord(rows: DataFrame, splittable: bool) -> DataFrame:
    """Number the rows of every file in file order, without sorting or gathering a file's rows.

    A file read in one piece is numbered where it is read. One read in splits also needs, for
    each split, the number of rows before it: a table of one row per split.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("ord", T.LongType())])
    numbered = rows.mapInArrow(_number_within_splits, schema)
    if splittable:
        before = Window.partitionBy(FILE).orderBy(START).rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            rows.groupBy(FILE, START, SPLIT)
            .agg(F.count("*").alias("rows"))
            .select(SPLIT, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
        )
        numbered = numbered.join(offsets, SPLIT).withColumn("ord", F.col("ord") + F.col("before"))
    return numbered


def _post_id() -> Column:
    # The metadata column is URL-encoded, save for plus signs.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    suffixes = "|".join(S.FILE_SUFFIXES)
    return F.regexp_replace(name, rf"(?:{suffixes})?\.[^.]*$", "")


def _csv(spark: SparkSession, glob: str, header: tuple[str, ...], multi_line: bool) -> DataFrame:
    """Quoted fields may hold line breaks and doubled quotes; short rows end in missing fields.

    A file whose header differs is an error rather than shifted columns.
    """
    return (
        spark.read.schema(S.text_schema(header))
        .options(header=True, quote='"', escape='"', multiLine=multi_line)
        .options(mode="PERMISSIVE", enforceSchema=False)
        .csv(glob)
    )


def _read_comments(
    spark: SparkSession, glob: str, header: tuple[str, ...], multi_line: bool, in_splits: bool
) -> DataFrame:
    columns = {h: S.COLUMNS[h] for h in header if h in S.COLUMNS}
    if multi_line and in_splits:
        texts = split_csv.read_csv(spark, glob, header, _post_id()).select(F.col("name").alias("post_id"), "ord", "row.*")
        return texts.select("post_id", "ord", *[_typed(h, kind).alias(name) for h, (name, kind) in columns.items()])
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = _csv(spark, glob, header, multi_line).select(
        *columns, _post_id().alias("post_id"), file.alias(FILE), start.alias(START),
        F.concat_ws(":", file, start).alias(SPLIT),
    )
    typed = [_typed(h, kind).alias(name) for h, (name, kind) in columns.items()]
    return _with_ord(rows, splittable=not multi_line).select("post_id", "ord", *typed)


def read_posts(spark: SparkSession, glob: str, multi_line: bool = True, in_splits: bool = False) -> DataFrame:
    """Posts with their comments. ``multi_line=False``, for files whose fields hold no line
    breaks, lets several tasks read one large file; ``in_splits`` does so for files with such fields, in which quotes
    stand around fields only."""
    return _read_comments(spark, glob, S.POSTS, multi_line, in_splits)


def read_classified(spark: SparkSession, glob: str, multi_line: bool = True, in_splits: bool = False) -> DataFrame:
    return _read_comments(spark, glob, S.CLASSIFIED, multi_line, in_splits)


def read_report(spark: SparkSession, glob: str, multi_line: bool = True, in_splits: bool = False) -> DataFrame:
    """Uncertainty reports and suspect reports, which share one layout."""
    return _read_comments(spark, glob, S.REPORT, multi_line, in_splits)


def read_annotations(spark: SparkSession, glob: str, multi_line: bool = True, in_splits: bool = False) -> DataFrame:
    return _read_comments(spark, glob, S.ANNOTATION, multi_line, in_splits)


def read_gold(spark: SparkSession, path: str, fmt: str = "csv", header: tuple[str, ...] = S.GOLD) -> DataFrame:
    """Labelled texts, by default ``text`` and ``stance``."""
    if fmt == "csv":
        return _csv(spark, path, header, multi_line=True)
    return spark.read.schema(S.text_schema(header)).format(fmt).load(path)


def read_comments(
    spark: SparkSession, path: str, header: tuple[str, ...] = S.REPORT, fmt: str = "parquet"
) -> DataFrame:
    """Comments written by ``write_comments`` from files with this header."""
    if fmt != "csv":
        return spark.read.schema(S.comment_schema(header)).format(fmt).load(path)
    columns = {h: S.COLUMNS[h] for h in header if h in S.COLUMNS}
    rows = (
        spark.read.schema(S.text_schema(("ord", *columns, "post_id")))
        .options(header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)
        .csv(path)
    )
    typed = [_typed(h, kind).alias(name) for h, (name, kind) in columns.items()]
    return rows.select("post_id", _typed("ord", "bigint").alias("ord"), *typed)
