"""What the operators share: tables, kept intermediate results, bounded bit filters."""

from __future__ import annotations

import tempfile
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error, since executors
    do not see each other's local folders.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, where it outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A one-hash Bloom filter over the long column of ``keys``: 2 ** ``bits`` bits, whatever the number of keys.

    Spark sets the bits, 64 to a long; what reaches the driver and the tasks is at most 2 ** (bits - 3) bytes.
    False positives cost work downstream, never a result.
    """
    (name,) = keys.columns
    at = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    cells = (
        keys.select(F.shiftright(at, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(`{name}` & 63 AS int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("set"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells["cell"].to_numpy()] = cells["set"].to_numpy()
    return out.view(np.uint64)


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``keys`` may be in a ``bit_filter``."""
    at = keys & np.uint64(table.size * 64 - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
