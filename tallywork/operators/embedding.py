"""Embedding a text column with a user's function, behind a content-addressed cache table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tallywork import constants as K
from tallywork.operators.joins import hot_key_join
from tallywork.operators.ranking import crowded_buckets, latest_wins, with_single

# list of texts → list of vectors; runs inside tasks, one call per batch
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
# rows and a name → the same rows, written once and read back
Keep = Callable[[DataFrame, str], DataFrame]


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def query_text(text: Column, prefix: str = "query: ") -> Column:
    """Questions and passages may carry different prefixes for models that expect them."""
    return F.concat(F.lit(prefix), text)


def passage_text(text: Column, prefix: str = "passage: ") -> Column:
    return F.concat(F.lit(prefix), text)


def _embed_batches(embedder: Embedder, dim: int, batch: int, text: str, kept: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            # texts and vectors are Python objects for one call at a time, whatever a batch holds
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                vectors = embedder(part.column(text).to_pylist())
                wrong = [len(v) for v in vectors if len(v) != dim]
                if wrong or len(vectors) != part.num_rows:
                    raise ValueError(f"embedder returned {len(vectors)} vectors for {part.num_rows} texts, widths {wrong[:3]}")
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, kept), pa.array(vectors, pa.list_(pa.float32()))], names=[*kept, "embedding"]
                )

    return run


def embed_texts(
    texts: DataFrame, embedder: Embedder, dim: int = K.EMBEDDING_DIM, batch: int = 64, tasks: int | None = None
) -> DataFrame:
    """(text_hash, embedding) for a (text_hash, text) table; vectors of another width fail the task.

    `tasks` spreads the texts over that many tasks: a model call costs far more than its bytes, by which partitions
    would otherwise be sized, and a rate-limited model wants few callers.
    """
    rows = texts.select("text_hash", "text")
    if tasks is not None:
        rows = rows.repartition(tasks, "text_hash")
    return rows.mapInArrow(
        _embed_batches(embedder, dim, batch, "text", ["text_hash"]), "text_hash string, embedding array<float>"
    )


def embed_rows(
    rows: DataFrame, text: str, embedder: Embedder, dim: int = K.EMBEDDING_DIM, batch: int = 64, tasks: int | None = None
) -> DataFrame:
    """The rows, which have a `text_hash`, with the `embedding` of their text, where they are unless `tasks` spreads them."""
    if tasks is not None:
        rows = rows.repartition(tasks, "text_hash")
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return rows.mapInArrow(_embed_batches(embedder, dim, batch, text, rows.columns), schema)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, now: Column, days: int = K.EMBEDDING_CACHE_DAYS) -> DataFrame:
    """Distinct (text_hash, text) without a fresh cached vector of this model."""
    fresh = fresh_entries(cache, model, now, days).select("text_hash")
    distinct = texts.select(text_key(F.col("text")).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    return distinct.join(fresh, "text_hash", "left_anti")


def fresh_entries(cache: DataFrame, model: str, now: Column, days: int = K.EMBEDDING_CACHE_DAYS) -> DataFrame:
    """The newest cached vector per text that is younger than `days`."""
    recent = cache.filter((F.col("model") == model) & (F.col("cached_at") > now - F.make_dt_interval(F.lit(days))))
    return latest_wins(recent, ["text_hash"], ["cached_at"]).select("text_hash", "embedding")


def attach_embeddings(df: DataFrame, text: str, vectors: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Join vectors back by content. Boilerplate text repeated in a third of the rows is spread over tasks."""
    keyed = df.withColumn("text_hash", text_key(F.col(text)))
    return hot_key_join(keyed, vectors.select("text_hash", "embedding"), "text_hash", "left", spread).drop("text_hash")


def embed_column(
    df: DataFrame,
    text: str,
    embedder: Embedder,
    model: str,
    spread: Sequence[str],
    dim: int = K.EMBEDDING_DIM,
    cache: DataFrame | None = None,
    now: Column | None = None,
    store: Callable[[DataFrame], DataFrame] | None = None,
    tasks: int | None = None,
    keep: Keep | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(df with `embedding`, new cache rows). Each distinct text without a fresh cache entry is embedded once.

    `store` writes the new vectors and returns them as read back, so that a lost executor or a second use does
    not call the model again. With `keep`, texts that occur once and are not cached are embedded where they are, and kept with
    their vectors; only the others travel to meet their like.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    alone, crowded = None, None
    if keep is not None:
        keyed = df.withColumn("text_hash", text_key(F.col(text)))
        hashes = keyed.select("text_hash").filter(F.col("text_hash").isNotNull())
        if cache is not None:
            hashes = hashes.unionAll(fresh_entries(cache, model, now).select("text_hash"))
        crowded = keep(crowded_buckets(hashes), "crowded_texts")
        marked = with_single(keyed, ["text_hash"], crowded)
        single = F.col("_single") & F.col("text_hash").isNotNull()
        alone = keep(embed_rows(marked.filter(single).drop("_single"), text, embedder, dim, tasks=tasks), "single_texts")
        df = marked.filter(~single).drop("_single", "text_hash")
    texts = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    if cache is None:
        misses = texts.select(text_key(F.col("text")).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    else:
        # the cache is cut to the wanted texts before its vectors are read
        wanted = texts.select(text_key(F.col("text")).alias("text_hash")).distinct()
        cache = cache.join(wanted, "text_hash", "left_semi")
        misses = cache_misses(texts, cache, model, now)
    fresh = embed_texts(misses, embedder, dim, tasks=tasks).select(
        "text_hash", F.lit(model).alias("model"), "embedding", now.alias("cached_at")
    )
    if alone is not None:
        fresh = fresh.unionByName(alone.select("text_hash", F.lit(model).alias("model"), "embedding", now.alias("cached_at")))
    if store is not None:
        fresh = store(fresh)
    known = fresh.select("text_hash", "embedding")
    if alone is not None:
        known = with_single(known, ["text_hash"], crowded).filter(~F.col("_single")).drop("_single")
    if cache is not None:
        known = known.unionByName(fresh_entries(cache, model, now))
    found = attach_embeddings(df, text, known, spread)
    return (found if alone is None else found.unionByName(alone.drop("text_hash"))), fresh
