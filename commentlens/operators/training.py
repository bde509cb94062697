"""Training sets: labels, splits, fixed-length encoding, and model agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens import constants as C
from commentlens.functions.labels import encode_label
from commentlens.operators.rows import complete_rows, known_labels

# A token is a run of letters, digits and underscores.
TOKEN = r"[\p{L}\p{N}_]+"
LOOKUP_BUCKETS = 8192
SPLIT_STEPS = 2**32


def override_label(df: DataFrame, n: int = C.ANNOTATED_ROWS, ord: str = "ord") -> DataFrame:
    """Human label on the leading ``n`` rows, even where it is missing; predicted label after."""
    return df.withColumn("stance", F.when(F.col(ord) < n, F.col("validation")).otherwise(F.col("stance")))


def training_set_from_annotations(
    df: DataFrame,
    mapping: Mapping[str, int] = C.LABEL_IDS_FROM_ANNOTATIONS,
    n: int = C.ANNOTATED_ROWS,
    keep: Sequence[str] = ("post_id", "ord"),
) -> DataFrame:
    """``text``, ``stance`` and ``labels`` of every row that has both."""
    rows = complete_rows(override_label(df, n), ["content", "stance"])
    return rows.select(
        *keep, F.col("content").alias("text"), "stance",
        encode_label(F.col("stance"), mapping).alias("labels"),
    )


def training_set_from_gold(
    df: DataFrame, mapping: Mapping[str, int] = C.LABEL_IDS_FROM_GOLD, keep: Sequence[str] = ()
) -> DataFrame:
    """``text`` and ``label`` of every row with a text and a listed stance."""
    rows = known_labels(complete_rows(df, ["text", "stance"]), list(mapping))
    return rows.select(*keep, "text", encode_label(F.col("stance"), mapping).alias("label"))


def hash_split(
    df: DataFrame, key: Sequence[str], fractions: Mapping[str, float], seed: int = 42
) -> DataFrame:
    """Add ``split``, drawn from an MD5 of ``seed`` and ``key``.

    The draw depends on nothing else: not on partitioning, row order or retries, and any other
    program can repeat it. Sizes come close to ``fractions`` but are not exact.
    """
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("fractions must add up to 1")
    digest = F.md5(F.concat_ws(":", F.lit(seed), *key))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    *first, last = fractions
    split, bound = None, 0.0
    for name in first:
        bound += fractions[name]
        below = draw < round(bound * SPLIT_STEPS)
        split = F.when(below, name) if split is None else split.when(below, name)
    return df.withColumn("split", F.lit(last) if split is None else split.otherwise(last))


#: Characters at the beginning of a token by which those of one count are dealt out to be numbered.
CELL_PREFIX = 3


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def frequent_tokens(df: DataFrame, words: Column, size: int) -> DataFrame:
    """The ``size`` most frequent elements of an array column, with their counts, in order.

    Equally frequent ones are taken alphabetically. Counting is combined before the shuffle;
    every task then passes on ``size`` rows at most.
    """
    # A plain explode would first filter on the array, and split the text once more for that.
    return (
        df.select(F.explode_outer(words).alias("token"))
        .where("token is not null")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "token")
        .limit(size)
    )


def build_vocabulary(df: DataFrame, col: str = "text", size: int | None = None) -> DataFrame:
    """Every token with its count and id, most frequent first, equal ones alphabetically; numbered after the marks.

    Tokens are numbered within cells of one count and one beginning; what comes before a cell is a running total over the
    table of cells, so tokens never come together in one task. ``size`` keeps the first ones only.
    """
    counted = (
        df.select(F.explode_outer(tokens(F.col(col))).alias("token"))
        .where("token is not null")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .withColumn("__start", F.substring("token", 1, CELL_PREFIX))
    )
    earlier = Window.orderBy(F.col("n").desc(), "__start").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy("n", "__start").agg(F.count("*").alias("__size"))
    before = cells.select("n", "__start", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("n", "__start").orderBy("token"))
    numbered = counted.withColumn("__place", place).join(before, ["n", "__start"])
    token_id = (F.col("__before") + F.col("__place") + C.UNKNOWN_ID).cast("int").alias("token_id")
    vocab = numbered.select("token", "n", token_id)
    return vocab if size is None else vocab.where(F.col("token_id") <= size + C.UNKNOWN_ID)


def _lookup_table(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one array of small maps, indexed by a hash of the token.

    A Spark map is searched from end to end; spread over many maps a search stays short.
    """
    bucket = F.pmod(F.xxhash64("token"), F.lit(LOOKUP_BUCKETS)).alias("id")
    filled = vocab.groupBy(bucket).agg(F.collect_list(F.struct("token", "token_id")).alias("entries"))
    entries = "array<struct<token:string,token_id:int>>"
    every = (
        vocab.sparkSession.range(LOOKUP_BUCKETS)
        .join(filled, "id", "left")
        .select("id", F.coalesce("entries", F.array().cast(entries)).alias("entries"))
    )
    in_order = F.sort_array(F.collect_list(F.struct("id", "entries")))
    return every.agg(in_order.alias("all")).select(
        F.transform("all", lambda b: F.map_from_entries(b["entries"])).alias("lookup")
    )


def encode_fixed_length(
    df: DataFrame,
    vocab: DataFrame,
    length: int = C.ENCODED_LENGTH,
    col: str = "text",
    keep: Sequence[str] | None = None,
    lookup: bool = False,
) -> DataFrame:
    """Replace ``col`` by ``input_ids`` and ``attention_mask``, arrays of ``length`` numbers.

    Tokens stand between a begin and an end mark; what does not fit is cut off, what is missing is padded. The tokens
    that fit are joined with the vocabulary, whatever its size, and gathered again by row. With ``lookup``, meant for a
    vocabulary of a stated size, it reaches the tasks as one value instead, and texts are neither exploded nor shuffled.
    """
    keep = [c for c in df.columns if c not in (col, "stance")] if keep is None else list(keep)
    words = F.slice(F.coalesce(tokens(F.col(col)), F.array().cast("array<string>")), 1, length - 2)
    if lookup:

        def token_id(word: Column) -> Column:
            bucket = F.pmod(F.xxhash64(word), F.lit(LOOKUP_BUCKETS)).cast("int")
            return F.coalesce(F.try_element_at(F.col("__lookup")[bucket], word), F.lit(C.UNKNOWN_ID))

        # Used in one place only, the table is folded into that expression instead of becoming a
        # column of every row.
        found = df.withColumn("__lookup", _lookup_table(vocab).scalar()).select(
            *keep, F.transform(words, token_id).alias("__ids")
        )
    else:
        rows = df.select(*keep, F.monotonically_increasing_id().alias("__row"), words.alias("__words"))
        placed = rows.select("__row", *keep, F.posexplode_outer("__words").alias("__at", "token"))
        ids = placed.join(vocab.select("token", "token_id"), "token", "left").withColumn(
            "__id", F.when(F.col("token").isNotNull(), F.struct("__at", F.coalesce("token_id", F.lit(C.UNKNOWN_ID)).alias("id")))
        )
        in_order = F.sort_array(F.collect_list("__id"))
        kept_once = [F.first(c).alias(c) for c in keep]
        found = ids.groupBy("__row").agg(*kept_once, in_order.alias("__placed")).select(
            *keep, F.transform("__placed", lambda x: x["id"]).alias("__ids")
        )
    used = F.size("__ids") + 2
    ids = F.concat(
        F.array(F.lit(C.BEGIN_ID)),
        F.col("__ids"),
        F.array(F.lit(C.END_ID)),
        F.array_repeat(F.lit(C.PAD_ID), F.lit(length) - used),
    )
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))
    return found.select(*keep, ids.alias("input_ids"), mask.alias("attention_mask"))


def _log_softmax(logits: Column, temperature: float) -> Column:
    scaled = F.transform(logits, lambda x: x / F.lit(float(temperature)))
    top = F.array_max(scaled)
    total = F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(scaled, lambda x: x - top - F.log(total))


def model_agreement(
    df: DataFrame,
    teacher: str = "teacher",
    student: str = "student",
    label: str = "labels",
    temperature: float = C.DISTILL_TEMPERATURE,
    alpha: float = C.DISTILL_ALPHA,
    by: Sequence[str] = (),
) -> DataFrame:
    """How far a student's logits are from a teacher's and from the labels, averaged over rows."""
    t, s = _log_softmax(F.col(teacher), temperature), _log_softmax(F.col(student), temperature)
    parts = F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b))
    divergence = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) * temperature**2
    plain = F.try_element_at(_log_softmax(F.col(student), 1.0), F.col(label) + 1)
    return (
        df.select(*by, divergence.alias("kl"), (-plain).alias("ce"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.avg("ce").alias("cross_entropy"),
            F.avg("kl").alias("kl_divergence"),
            F.avg((1.0 - alpha) * F.col("ce") + alpha * F.col("kl")).alias("loss"),
        )
    )
