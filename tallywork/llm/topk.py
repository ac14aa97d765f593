"""Exact top-k search by distributed histogram selection.

Every pair of a query and a candidate is scored, block by block, in each of a few passes. A pass counts scores per query in bins
of equal width; the global counts tell in which bin the query's kth highest score lies, and the next pass counts inside that bin
alone, until a bin holds a single value. That value is the threshold: pairs above it are all taken, pairs equal to it by the
smaller id. No pass sorts scores or sends more than a few bins per query and block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import release, settings, staged

# Candidates and queries of a block, the work of one task at a time.
CANDIDATES = 4096
QUERIES = 1024
# Bins a pass divides a query's interval into.
BINS = 2048
_BLOCK = ["dim", "candidates", "queries"]


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The `k` highest scores of each query: `query_id`, `rank` from 1, `vec_id`, `score`.

    Both inputs have `vec_id` and `vector`, an array of doubles with whole values (products and sums below 2^53 are exact). Every row
    of `vectors` but the query's own, one of its id and vector, is a candidate, fewer than `k` if there are no more. Ties go to the
    smaller id. Rows with a null id or vector take no part, nor do pairs of different lengths. A repeated row is a candidate of its
    own, and a query of its own with ranks from 1. Other columns are not read.
    """
    settings(vectors.sparkSession)
    vectors = vectors.select("vec_id", "vector").dropna().withColumn("dim", F.size("vector"))
    queries = queries.select("vec_id", "vector").dropna().withColumn("dim", F.size("vector"))
    vectors = staged(vectors, "topk-vectors")
    # queries are told apart by number, as ids may repeat; numbered once, on disk
    queries = staged(queries.withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    shards = vectors.count() // CANDIDATES + 1
    groups = queries.count() // QUERIES + 1

    # a block is a shard of the candidates with a group of the queries; each side is copied to its blocks
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")
    left = vectors.select("dim", shard.alias("candidates"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("queries"), "vec_id", "vector")
    right = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("candidates"), group.alias("queries"), "query", "vec_id", "vector")

    # no score lies beyond the product of the lengths; the interval [low, low + span) holds every score of a query
    longest = vectors.groupBy("dim").agg(F.max(_squares()).alias("longest"))
    reach = F.ceil(F.sqrt(F.col("longest") * _squares())) + 1
    span = (2 * reach + 1).cast("bigint")
    state = queries.join(longest, "dim").select(
        "query",
        (-reach).cast("bigint").alias("low"),
        span.alias("span"),
        F.ceil(span / BINS).cast("bigint").alias("width"),
        F.lit(k).cast("bigint").alias("missing"),
    )
    state = staged(state, "topk-state")
    while state.filter("width > 0").limit(1).count():
        found = _narrowed(left, right, state.filter("width > 0"), k)
        state = staged(found.unionByName(state.filter("width = 0")), "topk-state")
    hits = _blocks(left, right, state, lambda scores, ids, low, span, width: _reaching(scores, ids, low, k), "query BIGINT, vec_id BIGINT, score BIGINT")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    asked = queries.select("query", F.col("vec_id").alias("query_id"))
    return ranked.join(asked, "query").select("query_id", "rank", "vec_id", "score")


def _squares() -> Column:
    return F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)


def _narrowed(left: DataFrame, right: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """One pass: the bin of each query that holds its kth score, as the next interval, with how many are still to be found there.

    A query with fewer than `k` candidates ends at the lowest bin counted, so that all are taken.
    """
    counts = _blocks(left, right, state, lambda scores, ids, low, span, width: _histogram(scores, low, span, width, k), "query BIGINT, bin BIGINT, n BIGINT")
    counts = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("query").orderBy(F.desc("bin"))
    counts = counts.withColumn("up_to", F.sum("n").over(above)).withColumn("last", F.min("bin").over(Window.partitionBy("query")))
    joined = counts.join(state, "query")
    holds = (F.col("up_to") >= F.col("missing")) & (F.col("up_to") - F.col("n") < F.col("missing"))
    short = (F.col("up_to") < F.col("missing")) & (F.col("bin") == F.col("last"))
    found = joined.filter(holds | short)
    # a bin of one value is done: its width becomes 0 and its low bound the threshold
    low = F.col("low") + F.col("bin") * F.col("width")
    width = F.when(F.col("width") == 1, F.lit(0)).otherwise(F.ceil(F.col("width") / BINS)).cast("bigint")
    # those short of candidates take every score, whatever their interval
    return found.select(
        "query",
        F.when(short, F.lit(-(1 << 62))).otherwise(low).alias("low"),
        F.col("width").alias("span"),
        F.when(short, F.lit(0)).otherwise(width).alias("width"),
        (F.col("missing") - F.col("up_to") + F.col("n")).alias("missing"),
    )


def _histogram(scores: np.ndarray, low: np.ndarray, span: np.ndarray, width: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per query the bins of a block's scores that the global kth score can lie in, and its counts.

    A score below a block's own kth highest can't be the global one, so at most `k` scores and their ties are counted; those
    above the interval were counted by an earlier pass.
    """
    rows, bins, counts = [], [], []
    for at in np.flatnonzero(width > 0):
        above = scores[at] - low[at]
        inside = (above[(above >= 0) & (above < span[at])] // width[at]).astype(np.int64)
        if len(inside) == 0:
            continue
        if len(inside) > k:
            inside = inside[inside >= np.partition(inside, len(inside) - k)[len(inside) - k]]
        values, n = np.unique(inside, return_counts=True)
        rows.append(np.full(len(values), at))
        bins.append(values)
        counts.append(n)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (bins, counts)], np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _reaching(scores: np.ndarray, ids: np.ndarray, low: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per query a block's pairs that reach the threshold, the first `k` of them by score and id."""
    rows, found, reached = [], [], []
    for at in range(len(scores)):
        hit = np.flatnonzero(scores[at] >= low[at])
        if len(hit) > k:
            hit = hit[np.lexsort((ids[hit], -scores[at][hit]))[:k]]
        rows.append(np.full(len(hit), at))
        found.append(ids[hit])
        reached.append(scores[at][hit].astype(np.int64))
    return [np.concatenate(found), np.concatenate(reached)], np.concatenate(rows)


def _blocks(left: DataFrame, right: DataFrame, state: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Scores of every block, handed to `work`; rows are the query's number and what `work` returns."""
    queries = right.join(state, "query")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        release()
        columns = [np.zeros(0, np.int64)] * len(names)
        if candidates.num_rows and asked.num_rows:
            ids, own = candidates.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            dim = asked.column("dim")[0].as_py()
            these, those = _matrix(asked, dim), _matrix(candidates, dim)
            scores = these @ those.T
            # a query is no candidate of its own: below every interval and threshold. Equal rows are in one block
            done = set()
            for q, c in zip(*np.nonzero(own[:, None] == ids[None, :]), strict=True):
                if q not in done and (these[q] == those[c]).all():
                    scores[q, c] = -np.inf
                    done.add(q)
            values, rows = work(scores, ids, *(asked.column(c).to_numpy() for c in ("low", "span", "width")))
            columns = [asked.column("query").to_numpy()[rows], *values]
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns, strict=True)})

    return left.groupBy(*_BLOCK).cogroup(queries.groupBy(*_BLOCK)).applyInArrow(run, schema)


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    vectors = rows.column("vector").combine_chunks()
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(rows.num_rows, dim)
