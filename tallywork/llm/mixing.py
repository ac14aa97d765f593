"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies. Within its source the documents stand in a fixed order, their expected
copies are summed up, one random offset per source is added, and a document is taken once for every whole number that the
sum crosses at it. The order goes by size, so that the words taken come near the target as well as the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Documents of a source are dealt into this many groups per class of sizes. A source has at most 8 classes per doubling of
# the size, so the groups of a source are bounded, and the documents of a group are what one task sorts.
GROUPS = 256
CLASSES_PER_DOUBLING = 8
# Expected copies are counted in billionths, as whole numbers, so that sums are exact whatever their order.
BILLION = 1_000_000_000


def _drawn(value: Column) -> Column:
    """A whole number below 2^32 from the MD5 of a text."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`source`, `source_size`, `target` from `source`, `source_size` (one row per source, nulls allowed).

    Sources in code point order, null last, have the weights in turn. They share `share` times all sizes by weight; a target
    stops at `most` times its source's size and what is above is shared again by weight. That is one level of words per
    weight: a source stops exactly if its stop per weight is at most the level among the sources from its own stop upwards.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_weight", F.element_at(turn, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_stop", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    lower = Window.orderBy(F.col("_stop") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    words = F.sum("source_size").over(everything) * F.lit(float(share))
    left = words - F.coalesce(F.sum("_stop").over(lower), F.lit(0.0))
    weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(lower), F.lit(0.0))
    level = F.max("_level").over(everything)
    ranked = ranked.withColumn("_level", left / weight)
    return ranked.select("source", "source_size", F.least(F.col("_stop"), F.col("_weight") * level).alias("target"))


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    keys = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(right, keys).drop(*[f"_r_{c}" for c in on])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How often each document is taken: `doc_id`, `source`, `size`, `source_size`, `target`, `copies`, `taken`, `row_hash`.

    Reads doc_id, text and source. Null texts and texts of white space have size 0 and give no words; a source without words
    has target 0 and no copies. Null sources are one source. Repeated rows stand next to each other and are sampled one by
    one. `row_hash` tells rows of one doc_id apart. The offset is a hash of seed and source, so a rerun takes the same rows.
    """
    rows = docs.select(
        "doc_id", "source", word_count(docs["text"]).alias("size"), F.xxhash64("doc_id", "text", "source").alias("row_hash")
    )
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by_source = by_source.withColumn("_expected", F.floor(ratio * BILLION))

    doubling = F.floor(F.log2(F.col("size") + 1) * CLASSES_PER_DOUBLING).cast("int")
    group = _drawn(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}"))) % GROUPS
    rows = rows.withColumn("_class", doubling).withColumn("_group", group)
    place = ["source", "_class", "_group"]
    # documents before a group: those of lower classes of the source, then those of earlier groups of the class
    counts = rows.groupBy(*place).agg(F.count("*").alias("_rows"))
    classes = counts.groupBy("source", "_class").agg(F.sum("_rows").alias("_rows"))
    lower = Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_lower", F.coalesce(F.sum("_rows").over(lower), F.lit(0))).drop("_rows")
    classes = _null_safe_join(classes, by_source, ["source"])
    earlier = Window.partitionBy("source", "_class").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    counts = _null_safe_join(counts, classes, ["source", "_class"])

    inside = Window.partitionBy(*place).orderBy("doc_id", "size", "row_hash")
    rows = rows.withColumn("_place", F.row_number().over(inside))
    rows = _null_safe_join(rows, counts, place)

    # billionths of copies of the documents up to this one, all of a source being equal, and the source's offset
    rows = rows.withColumn("_rank", (F.col("_lower") + F.col("_earlier") + F.col("_place")).cast("decimal(20,0)"))
    rows = rows.withColumn("_offset", (_drawn(F.concat(F.coalesce("source", F.lit("")), F.lit(f"/{seed}"))) % BILLION))
    rows = rows.withColumns({c: F.col(c).cast("decimal(11,0)") for c in ("_expected", "_offset")})
    copies = F.expr(f"(_rank * _expected + _offset) div {BILLION} - ((_rank - 1) * _expected + _offset) div {BILLION}")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row_hash"
    )


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken, with its columns unchanged.

    Only keys and counts are shuffled before the texts are fetched by doc_id and hash.
    """
    taken = mix(docs, **parameters).filter(F.col("copies") > 0)
    # repeated rows share a key: their copies are added up and dealt out to the repeats in turn
    taken = taken.groupBy("row_hash", F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_copies"))
    repeats = Window.partitionBy("_hash")
    whole = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    keyed = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64("doc_id", "text", "source").alias("_hash"), whole.alias("_row"))
    keyed = keyed.withColumn("_repeat", F.row_number().over(repeats.orderBy("doc_id"))).withColumn("_repeats", F.count("*").over(repeats))
    same = F.coalesce(F.col("doc_id") == F.col("_id"), F.col("doc_id").isNull() & F.col("_id").isNull())
    found = keyed.join(taken, (keyed["_hash"] == taken["row_hash"]) & same)
    own = F.expr("CAST(_copies div _repeats AS INT) + CAST(_repeat <= _copies % _repeats AS INT)")
    copies = found.withColumn("_own", own).filter("_own > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own"))))
    return copies.select(*[F.col(f"_row.c{i}").alias(name) for i, name in enumerate(docs.columns)])
