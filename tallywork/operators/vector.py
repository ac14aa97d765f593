"""Exact cosine search.

Chunks are scored block by block: an Arrow batch of embeddings is one matrix, the questions are another, and their
product gives all similarities. Only each question's best rows leave a task, so neither a cross join nor its pairs
ever exist. The questions travel to the tasks while they are few; beyond that, both sides are cut into cells of
bounded size and shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.operators.joins import bounded_join, hot_key_join, row_bound
from tallywork.operators.ranking import top_per_key

# Similarities are compared and ranked at this many decimals, so that ties are ties on every engine.
SIMILARITY_DIGITS = 9
MAX_BLOCK_QUERIES = 1_024
MAX_BLOCK_BYTES = 64 * 1024 * 1024
CELL_ROWS = 16_384
_ROWS_PER_PRODUCT = 4_096


# ---- row-wise expressions ------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Row-wise cosine similarity; null where a vector is missing or zero."""
    return F.round(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), SIMILARITY_DIGITS)


# ---- block scoring -------------------------------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix with unit rows; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = pc.min_max(pc.list_value_length(column)).as_py()
    if widths["min"] != widths["max"]:
        raise ValueError("embeddings of different width in one column")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best(ids: np.ndarray, scores: np.ndarray, floor: float, k: int) -> np.ndarray:
    """Positions of the k best scores at or above `floor`, ties by id."""
    hits = np.flatnonzero(scores >= floor)
    if len(hits) > k:
        kth = np.partition(scores[hits], len(hits) - k)[len(hits) - k]
        hits = hits[scores[hits] >= kth]
        order = np.lexsort((ids[hits], -scores[hits]))
        hits = hits[order[:k]]
    return hits


def _score_block(chunk_ids, vectors: np.ndarray, query_vectors: np.ndarray, floors: np.ndarray, k: int):
    """(query position, chunk position, score) of the candidates of one block; raises `floors` as k-th bests appear."""
    found = []
    for start in range(0, len(vectors), _ROWS_PER_PRODUCT):
        stop = start + _ROWS_PER_PRODUCT
        scores = np.round(vectors[start:stop] @ query_vectors.T, SIMILARITY_DIGITS)
        # a zero vector is similar to nothing, whatever the threshold
        scores[~vectors[start:stop].any(axis=1)] = np.nan
        scores[:, ~query_vectors.any(axis=1)] = np.nan
        ids = chunk_ids[start:stop]
        for q in np.flatnonzero((scores >= floors).any(axis=0)):
            column = np.ascontiguousarray(scores[:, q])
            hits = _best(ids, column, floors[q], k)
            if len(hits) == k:
                floors[q] = max(floors[q], column[hits].min())
            found.append((np.full(len(hits), q), hits + start, column[hits]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _broadcast_scorer(query_ids: pa.Array, query_vectors: np.ndarray, k: int, threshold: float) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.full(len(query_vectors), threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            q, c, s = _score_block(
                ids.to_numpy(zero_copy_only=False), _matrix(batch.column(1)), query_vectors, floors, k
            )
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(q)), ids.take(pa.array(c)), pa.array(s, pa.float64())],
                names=["query_id", "chunk_id", "similarity"],
            )

    return score


def _cell_scorer(k: int, threshold: float) -> Callable:
    def score(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "similarity"]
        ids, query_ids = chunks.column("chunk_id").combine_chunks(), queries.column("query_id").combine_chunks()
        if not len(ids) or not len(query_ids):
            return pa.table([query_ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=names)
        q, c, s = _score_block(
            ids.to_numpy(zero_copy_only=False),
            _matrix(chunks.column("embedding")),
            _matrix(queries.column("vector")),
            np.full(len(query_ids), threshold),
            k,
        )
        return pa.table([query_ids.take(pa.array(q)), ids.take(pa.array(c)), pa.array(s, pa.float64())], names=names)

    return score


def vector_top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = K.RETRIEVAL_CHUNKS,
    threshold: float = K.SIMILARITY_THRESHOLD,
    max_block_queries: int = MAX_BLOCK_QUERIES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): each question's k most similar chunks at or above the threshold.

    `chunks` needs chunk_id and embedding, `queries` query_id and vector. Chunks without an embedding are skipped.
    """
    narrow = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    asked = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
    types = {"q": queries.schema["query_id"].dataType, "c": chunks.schema["chunk_id"].dataType}
    schema = f"query_id {types['q'].simpleString()}, chunk_id {types['c'].simpleString()}, similarity double"

    # Never more than one block of rows comes to the driver, whatever the number of questions.
    block = asked.limit(max_block_queries + 1).toArrow()
    if block.num_rows <= max_block_queries and block.nbytes <= MAX_BLOCK_BYTES:
        if not block.num_rows:
            empty = narrow.sparkSession.createDataFrame([], schema)
            return empty.withColumn("rank", F.lit(0))
        scorer = _broadcast_scorer(
            block.column("query_id").combine_chunks(), _matrix(block.column("vector")), k, threshold
        )
        candidates = narrow.mapInArrow(scorer, schema)
    else:
        shards = max(1, math.ceil(asked.count() / max_block_queries))
        cells = max(1, math.ceil(narrow.count() / cell_rows))
        left = narrow.withColumn("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(cells))).withColumn(
            "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
        )
        right = asked.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards))).withColumn(
            "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint")))
        )
        candidates = (
            left.groupBy("cell", "shard")
            .cogroup(right.groupBy("cell", "shard"))
            .applyInArrow(_cell_scorer(k, threshold), schema)
        )
    return top_per_key(candidates, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k, rank="rank")


def vector_rank_within(
    chunks: DataFrame, queries: DataFrame, pairs: DataFrame, bound: int | None = None
) -> DataFrame:
    """(query_id, job_id, chunk_id, similarity) for every chunk of the named (query_id, job_id) pairs.

    No threshold and no limit. While the pairs are few they go to the chunks, which are not shuffled; otherwise both meet
    on the posting. `bound` is the number of questions, if known to be small.
    """
    narrow = chunks.filter(F.col("embedding").isNotNull()).select("job_id", "chunk_id", "embedding")
    wanted = pairs.select("query_id", "job_id").distinct()
    few = row_bound(wanted)
    if few is not None:
        with_chunks = bounded_join(narrow, wanted, "job_id", "inner", few)
    else:
        with_chunks = hot_key_join(wanted, narrow, "job_id", "inner", ["query_id"])
    asked = queries.select("query_id", "vector")
    if bound is not None:
        scored = bounded_join(with_chunks, asked, "query_id", "inner", bound)
    else:
        scored = hot_key_join(with_chunks, asked, "query_id", "inner", ["chunk_id"])
    rows = scored.select("query_id", "job_id", "chunk_id", "embedding", "vector")
    return rows.mapInArrow(_score_pairs, rows.select("query_id", "job_id", "chunk_id", F.lit(0.0).alias("similarity")).schema)


def _score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine similarity of the two vectors of each row, a few thousand rows at a time; null where one is missing or zero."""
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS_PER_PRODUCT):
            batch = whole.slice(start, _ROWS_PER_PRODUCT)
            known = pc.and_(pc.is_valid(batch.column("embedding")), pc.is_valid(batch.column("vector"))).to_numpy(zero_copy_only=False)
            scores = np.full(batch.num_rows, np.nan)
            if known.any():
                both = batch.filter(pa.array(known))
                left, right = _matrix(both.column("embedding")), _matrix(both.column("vector"))
                found = np.round(np.einsum("ij,ij->i", left, right), SIMILARITY_DIGITS)
                found[~left.any(axis=1) | ~right.any(axis=1)] = np.nan
                scores[known] = found
            similarity = pa.array(scores, pa.float64(), mask=np.isnan(scores))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], similarity], names=["query_id", "job_id", "chunk_id", "similarity"])
