"""First, last and best rows per key, top lists and pages.

Every per-key pick is a `row_number() <= n` filter. Spark runs it once before the shuffle (WindowGroupLimit), so a
hot key reaches its task as at most n rows per upstream task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 100
DEFAULT_PAGE = 20
# Buckets in which keys are counted to find those that occur once, one bit each.
BUCKETS = 1 << 27


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows per key in `order`; `rank` names a column for the position, if wanted."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """All rows with their position within the key. For keys whose groups are known to be short."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_seen(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Keep the first row per key in reading order."""
    return top_per_key(df, keys, [F.asc(c) for c in position], 1)


def latest_wins(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Keep the last row per key; `sequence` must order the rows of a key completely."""
    return top_per_key(df, keys, [F.desc_nulls_last(c) for c in sequence], 1)


def crowded_buckets(keys: DataFrame) -> DataFrame:
    """The hash buckets that hold two rows of `keys` or more, as bitmaps (`_word`, `_bits`).

    There are 2^27 buckets, so this is 16 MB at most, whatever the table has. Store it before `with_single` reads it more than once.
    """
    bucket = _bucket(*keys.columns)
    place = {"_word": F.bitmap_bucket_number(bucket), "_bit": F.bitmap_bit_position(bucket)}
    counts = keys.select(*[c.alias(name) for name, c in place.items()]).groupBy(*place).count().filter(F.col("count") > 1)
    # few of them are left, which meet by word; bitmaps of single tasks would travel in full
    return counts.repartition("_word").groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def with_single(df: DataFrame, keys: Sequence[str], crowded: DataFrame, name: str = "_single") -> DataFrame:
    """The rows with a mark for those whose key occurs once among the rows that `crowded` was made of.

    No row moves for it. A key without the mark may still occur once, as others can share its bucket.
    """
    word, bit = F.bitmap_bucket_number(_bucket(*keys)), F.bitmap_bit_position(_bucket(*keys))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.get(F.array(*[byte.bitwiseAND(F.lit(1 << i)) > 0 for i in range(8)]), F.pmod(bit, F.lit(8)).cast("int"))
    marked = df.withColumn("_word", word).join(F.broadcast(crowded), "_word", "left")
    return marked.withColumn(name, F.col("_bits").isNull() | ~is_set).drop("_word", "_bits")


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) + 1


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first `n` rows in `order`, which must include a tie key. Runs as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


def newest_first(df: DataFrame, n: int, time: str = "fetched_at", tie: str = "id") -> DataFrame:
    return top_n(df, n, F.desc_nulls_last(time), F.asc(tie))


def page(df: DataFrame, number: int | None = None, limit: int | None = None, time: str = "created_at", tie: str = "id") -> DataFrame:
    """One page, newest first, rows without a time last. Page at least 1, size within 1..100, 20 by default.

    However deep the page, only the rows of its own days, and of these its own seconds, are sorted: counts per day and second tell
    which these are and how many rows stand before them. `time` is a date or timestamp.
    """
    number = max(1, 1 if number is None else number)
    limit = min(MAX_PAGE, max(1, DEFAULT_PAGE if limit is None else limit))
    skipped = (number - 1) * limit
    for unit in ("day", "second"):
        if not skipped:
            break  # the first rows are found without counts
        df, skipped = _touched(df, F.date_trunc(unit, time), time, unit, skipped, limit)
    return df.orderBy(F.desc_nulls_last(time), F.asc(tie)).offset(skipped).limit(limit)


def _touched(df: DataFrame, bucket: Column, time: str, unit: str, skipped: int, limit: int) -> tuple[DataFrame, int]:
    """The rows of the buckets of time that hold the rows from `skipped` on, and how many of these are to be skipped."""
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    newer = Window.orderBy(F.desc_nulls_last("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    # each holds a row of the page, so there are no more than its rows
    found = counts.filter((F.col("before") < skipped + limit) & (F.col("before") + F.col("n") > skipped)).collect()
    if not found:
        return df.limit(0), 0
    known = [row["bucket"] for row in found if row["bucket"] is not None]
    inside = F.col(time).isNull() if len(known) < len(found) else F.lit(False)
    if known:
        end = F.lit(max(known)) + (F.make_dt_interval(days=F.lit(1)) if unit == "day" else F.make_dt_interval(secs=F.lit(1)))
        inside = inside | ((F.col(time) >= F.lit(min(known))) & (F.col(time) < end))
    return df.filter(inside), skipped - min(row["before"] for row in found)


def page_totals(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Total rows and number of pages for `page`."""
    limit = min(MAX_PAGE, max(1, DEFAULT_PAGE if limit is None else limit))
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / F.lit(limit)).cast("bigint").alias("pages"))


def head_and_tail(df: DataFrame, keys: Sequence[str], order: Sequence[Column], reverse: Sequence[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """First `n` rows per key, and last `n` of the keys that have more than `n`.

    Both are limited before the shuffle; whether a key has more than `n` rows is told by its first `n + 1`.
    """
    first = top_per_key(df, keys, order, n + 1, rank="_position")
    enough = first.filter(F.col("_position") > n).select(*keys)
    last = top_per_key(df, keys, reverse, n).join(enough, list(keys), "left_semi")
    return first.filter(F.col("_position") <= n).drop("_position"), last
