"""Retrieval quality: retrieve, judge, precision@k, MRR, NDCG, and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.text import normalize_verdict, round_half_up
from tallywork.operators.joins import bounded_join
from tallywork.operators.ranking import top_per_key
from tallywork.operators.vector import vector_top_k
from tallywork.plans.retrieval import question_bound
from tallywork.session import store_once
from tallywork.sinks.tables import Store

# (question, title, description start) per row → a judge's answers; runs inside tasks
Judge = Callable[[pd.Series, pd.Series, pd.Series], pd.Series]
METRICS = ("precision", "mrr", "ndcg")


def retrieve_for_eval(
    chunks: DataFrame, queries: DataFrame, k: int = K.EVAL_MAX_K, threshold: float = K.SIMILARITY_THRESHOLD
) -> DataFrame:
    """(query_id, job_id, chunk_id, similarity, rank): the postings behind the k best chunks.

    The limit comes before the choice of one chunk per posting, so k chunks may mean fewer postings.
    """
    hits = vector_top_k(chunks, queries, k, threshold).drop("rank")
    bound = question_bound(queries)
    owned = bounded_join(
        chunks.select("chunk_id", "job_id"), hits, "chunk_id", "inner", None if bound is None else bound * k
    )
    order = [F.desc("similarity"), F.asc("chunk_id")]
    best = top_per_key(owned, ["query_id", "job_id"], order, 1)
    return top_per_key(best, ["query_id"], order, k, rank="rank")


# ---- judging -------------------------------------------------------------------------------------


def cached_verdicts(retrieved: DataFrame, judgments: DataFrame, judge: str) -> DataFrame:
    """Retrieved rows with the judge's stored verdict, null where there is none."""
    known = judgments.filter(F.col("judge") == judge).select("query_id", "job_id", "verdict")
    return retrieved.join(known, ["query_id", "job_id"], "left")


def unjudged(retrieved: DataFrame, judgments: DataFrame, judge: str) -> DataFrame:
    known = judgments.filter(F.col("judge") == judge).select("query_id", "job_id")
    return retrieved.join(known, ["query_id", "job_id"], "left_anti")


def judge_pairs(pairs: DataFrame, questions: DataFrame, jobs: DataFrame, judge: str, fn: Judge, rows: int | None = None) -> DataFrame:
    """Judgments (judge, query_id, job_id, verdict) of a user's judge for (query_id, job_id) pairs.

    The judge sees the question, the title and the first 300 characters of the description.
    """
    asked = pairs.select("query_id", "job_id").distinct()
    asked = bounded_join(asked, questions.select("query_id", "question"), "query_id", "inner", question_bound(questions))
    texts = jobs.select(
        F.col("id").alias("job_id"), "title", F.substring("description", 1, K.JUDGE_DESCRIPTION_CHARS).alias("start")
    )
    rows_to_judge = bounded_join(texts, asked, "job_id", "inner", rows)
    types = dict(rows_to_judge.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = fn(batch["question"], batch["title"], batch["start"])
            yield batch[["query_id", "job_id"]].assign(answer=answers)

    answered = rows_to_judge.mapInPandas(
        run, f"query_id {types['query_id']}, job_id {types['job_id']}, answer string"
    )
    return answered.select(
        F.lit(judge).alias("judge"), "query_id", "job_id", normalize_verdict(F.col("answer")).alias("verdict")
    )


def with_verdicts(retrieved: DataFrame, judgments: DataFrame, judge: str) -> DataFrame:
    """Retrieved rows with a verdict; what is still unjudged counts as not relevant."""
    return cached_verdicts(retrieved, judgments, judge).withColumn(
        "verdict", F.coalesce("verdict", F.lit("not_relevant"))
    )


# ---- metrics -------------------------------------------------------------------------------------


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def per_query_metrics(judged: DataFrame, queries: DataFrame, ks: tuple[int, ...] = K.EVAL_KS) -> DataFrame:
    """(query_id, category, k, retrieved, precision, mrr, ndcg) for every question and k, three decimals.

    Precision is over what was retrieved, not over k. NDCG is binary, its ideal has all retrieved relevants first.
    A question without results scores 0.
    """
    relevant = F.col("verdict") == "relevant"
    at_k = (
        judged.withColumn("k", F.explode(F.lit(list(ks))))
        .filter(F.col("rank") <= F.col("k"))
        .groupBy("query_id", "k")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(relevant, 1)).alias("rel"),
            F.min(F.when(relevant, F.col("rank"))).alias("first"),
            F.sum(F.when(relevant, _discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        )
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("rel"), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + _discount(i),
    )
    scored = at_k.select(
        "query_id",
        "k",
        "n",
        round_half_up(F.col("rel") / F.col("n"), 3).alias("p"),
        round_half_up(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 3).alias("m"),
        round_half_up(F.col("dcg") / ideal, 3).alias("d"),
    )
    everything = queries.select("query_id", "category", F.explode(F.lit(list(ks))).alias("k"))
    zero = F.lit(0.0)
    return everything.join(scored, ["query_id", "k"], "left").select(
        "query_id",
        "category",
        "k",
        F.coalesce("n", F.lit(0)).alias("retrieved"),
        F.coalesce("p", zero).alias("precision"),
        F.coalesce("m", zero).alias("mrr"),
        F.coalesce("d", zero).alias("ndcg"),
    )


def verdict_counts(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, relevant, marginal, not_relevant) over all retrieved rows of every question."""
    counts = judged.groupBy("query_id").agg(
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in K.VERDICTS]
    )
    return queries.select("query_id").join(counts, "query_id", "left").fillna(0, list(K.VERDICTS))


def mean_of_rounded(c: Column) -> Column:
    """Mean of three-decimal values to three decimals, summed in whole thousandths."""
    thousandths = F.sum(F.round(c * 1000).cast("bigint"))
    n = F.nullif(F.count(c), F.lit(0))
    return F.coalesce(F.floor(thousandths / n + F.lit(0.5)) / F.lit(1000.0), F.lit(0.0))


def _means() -> list[Column]:
    return [mean_of_rounded(F.col(m)).alias(m) for m in METRICS]


def report_cube(metrics: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """All means and counts of a report in one ROLLUP: by `k` (`level` 1) and by `k` and `category` (`level` 0)."""
    rows, counts = metrics, []
    if verdicts is not None:
        rows = metrics.join(verdicts, "query_id")
        counts = [
            F.count(F.when(F.col("relevant") == 0, 1)).alias("queries_with_zero_relevant"),
            F.coalesce(F.sum("marginal"), F.lit(0)).alias("marginal_count"),
        ]
    cells = rows.rollup("k", "category").agg(
        F.grouping_id().cast("int").alias("level"),
        *_means(),
        F.count(F.lit(1)).alias("query_count"),
        F.count(F.when(F.col("retrieved") > 0, 1)).alias("queries_with_results"),
        *counts,
    )
    return cells.filter("level < 2")


def overall(metrics: DataFrame, verdicts: DataFrame, k: int = K.EVAL_DEFAULT_K) -> DataFrame:
    """One row: means at the default k, questions, those with results, those without a relevant, marginal verdicts."""
    return overall_of(report_cube(metrics, verdicts), k)


def overall_of(cube: DataFrame, k: int = K.EVAL_DEFAULT_K) -> DataFrame:
    one = cube.filter((F.col("level") == 1) & (F.col("k") == k)).drop("k", "category", "level")
    # a row of zeros without questions
    return one.agg(*[F.coalesce(F.max(c), F.lit(0).cast(t)).alias(c) for c, t in one.dtypes])


def _all_of(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """`df` with every value of `column` present. The literal side has a handful of rows."""
    literal = df.sparkSession.range(1).select(F.explode(F.lit(list(values))).alias(column))
    return F.broadcast(literal).join(df, column, "left")


def by_category(metrics: DataFrame, k: int = K.EVAL_DEFAULT_K) -> DataFrame:
    """All five categories, zeros where no question belongs to one."""
    return by_category_of(report_cube(metrics), k)


def by_category_of(cube: DataFrame, k: int = K.EVAL_DEFAULT_K) -> DataFrame:
    cells = cube.filter((F.col("level") == 0) & (F.col("k") == k))
    grouped = cells.select("category", *METRICS, F.col("query_count").alias("count"))
    return _all_of(grouped, "category", K.CATEGORIES).fillna(0.0, list(METRICS)).fillna(0, ["count"])


def by_k(metrics: DataFrame) -> DataFrame:
    return by_k_of(report_cube(metrics))


def by_k_of(cube: DataFrame) -> DataFrame:
    return cube.filter("level = 1").select("k", *METRICS)


def category_k_matrix(metrics: DataFrame, metric: str, ks: tuple[int, ...] = K.EVAL_KS) -> DataFrame:
    """(category, k1, k3, …): a metric's mean by category and k, the data behind the report's charts."""
    return category_k_matrix_of(report_cube(metrics), metric, ks)


def category_k_matrix_of(cube: DataFrame, metric: str, ks: tuple[int, ...] = K.EVAL_KS) -> DataFrame:
    # one cell per category and k
    cells = [F.coalesce(F.max(F.when(F.col("k") == k, F.col(metric))), F.lit(0.0)).alias(f"k{k}") for k in ks]
    grid = cube.filter("level = 0").groupBy("category").agg(*cells)
    return _all_of(grid, "category", K.CATEGORIES).fillna(0.0)


def top_results(judged: DataFrame, k: int = K.EVAL_DEFAULT_K) -> DataFrame:
    """The rows a report lists per question, scores to three decimals."""
    return judged.filter(F.col("rank") <= k).select(
        "query_id", "rank", "job_id", round_half_up(F.col("similarity"), 3).alias("score"), "verdict"
    )


# ---- a whole evaluation --------------------------------------------------------------------------


def run_evaluation(
    store: Store,
    chunks: DataFrame,
    jobs: DataFrame,
    queries: DataFrame,
    judge: str,
    fn: Judge,
    k: int = K.EVAL_MAX_K,
    threshold: float = K.SIMILARITY_THRESHOLD,
) -> dict[str, DataFrame]:
    """Retrieve, judge what the store has no verdict for, and measure. Returns the report's tables by name.

    `queries` has query_id, category, question and vector. New verdicts are stored before they are used, so a judge sees a
    pair once, also when an executor is lost or the evaluation runs again.
    """
    # searched once: every table of the report reads the stored result
    found = store_once(retrieve_for_eval(chunks, queries, k, threshold), "found")
    bound = question_bound(queries)
    missing = unjudged(found, store.judgments.read(), judge)
    verdicts = judge_pairs(missing, queries, jobs, judge, fn, None if bound is None else bound * k)
    store.judgments.commit(verdicts)

    judged = store_once(with_verdicts(found, store.judgments.read(), judge), "judged")
    metrics, counts = per_query_metrics(judged, queries), verdict_counts(judged, queries)
    cube = store_once(report_cube(metrics, counts), "report")
    return {
        "per_query": metrics,
        "verdicts": counts,
        "results": top_results(judged),
        "overall": overall_of(cube),
        "by_category": by_category_of(cube),
        "by_k": by_k_of(cube),
        **{f"{m}_by_category_and_k": category_k_matrix_of(cube, m) for m in ("precision", "mrr")},
    }
