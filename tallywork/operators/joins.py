"""Joins that hold when one key carries a large share of the rows, and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with this many rows on the many side is spread over several tasks.
HOT_ROWS = 1_000_000
# At most this many keys are spread; further ones stay unsalted, which is slower but not wrong.
HOT_KEYS = 10_000
SALTS = 32
# A side proven to have at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 100_000


def hot_key_join(
    many: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str,
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose `many` side may have hot or null keys.

    Hot keys are found with one map-side-combined count over the key columns. Their rows on the `many` side are
    spread by a hash of the `spread` columns (deterministic, so a retried task salts alike) and only their rows on
    the `lookup` side are copied once per salt. Everything else joins as usual. `how` is one of inner, left,
    left_semi, left_anti.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"hot_key_join cannot do a {how} join")
    hot = (
        many.select(*keys)
        .dropna(subset=keys)
        .groupBy(*keys)
        .count()
        .filter(F.col("count") >= hot_rows)
        .orderBy(F.desc("count"))
        .limit(HOT_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    hot = F.broadcast(hot)  # HOT_KEYS rows at most
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    salted = many.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot") | no_key, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"),
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.drop("_hot").join(copied, [*keys, "_salt"], how).drop("_salt")


def row_bound(df: DataFrame, at_most: int = BROADCAST_ROWS) -> int | None:
    """The number of rows if it is at most `at_most`, else None. Stops reading once there are more."""
    rows = df.limit(at_most + 1).count()
    return rows if rows <= at_most else None


def bounded_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str, small_rows: int | None) -> DataFrame:
    """Join with `small` broadcast when its row bound is known and low; otherwise the engine picks from statistics."""
    if small_rows is not None and small_rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def existing_only(rows: DataFrame, parents: DataFrame, on: str, spread: Sequence[str]) -> DataFrame:
    """Foreign-key check: keep rows whose parent exists."""
    return hot_key_join(rows, parents.select(on), on, "left_semi", spread)


def cascade_delete(children: DataFrame, deleted: DataFrame, on: str, spread: Sequence[str]) -> DataFrame:
    """Drop the children of deleted parents."""
    return hot_key_join(children, deleted.select(on).distinct(), on, "left_anti", spread)


def lookup_ids(table: DataFrame, ids: Sequence[object], column: str = "id") -> DataFrame:
    """Rows with one of the given ids: a pushed-down filter, as the ids are few enough to be typed in."""
    return table.filter(F.col(column).isin(list(ids)))


def point_lookup(table: DataFrame, value: object, column: str = "id") -> DataFrame:
    return table.filter(F.col(column) == F.lit(value))
