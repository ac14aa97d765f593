"""A table of questions → a table of prompts: route, search, count, and put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.operators.filters import LISTING
from tallywork.plans import retrieval as R
from tallywork.plans.requests import CONDITIONS, FILTERED, listed, newest_of, to_rows, without_empty
from tallywork.plans.routing import route_queries, statistics_for
from tallywork.session import cut_lineage


def _has_ids(questions: DataFrame) -> Column:
    if "context_job_ids" not in questions.columns:
        return F.lit(False)
    return F.coalesce(F.size("context_job_ids"), F.lit(0)) > 0


def _filtered(chunks: DataFrame, jobs: DataFrame, asked: DataFrame, **search) -> tuple[list[DataFrame], DataFrame]:
    """(blocks, statistics) of questions with compound filters: the postings found as context and as rows."""
    keyed = cut_lineage(asked.withColumn("request", F.to_json("filters")))
    given = keyed.select("request", "filters.*").withColumnsRenamed({"min_salary": "low", "max_salary": "high"}).distinct()
    given = given.withColumns({c: F.lit(None).cast("string") for c in ("company", "skill")})
    found = cut_lineage(newest_of(jobs, without_empty(given.select("request", *CONDITIONS)), FILTERED).select("request", "pos", "job"))
    rows = to_rows(found, listed(["id", *LISTING]))
    statistics = keyed.select("query_id", "request").join(rows, "request", "left")
    return R.found_blocks(chunks, jobs, keyed, found, **search), statistics.select("query_id", F.coalesce("rows", F.lit("[]")).alias("rows"))


def answer_table(chunks: DataFrame, jobs: DataFrame, questions: DataFrame, **search) -> DataFrame:
    """(query_id, type, prompt, sources) for every question.

    `questions` has query_id, question and vector, and may have context_job_ids (explicit postings), response (a
    classifier's answer) and resume (for the profile block). `chunks` has chunk_id, job_id, chunk_type, chunk_text and
    embedding; `search` passes k, n_jobs and threshold on. A prompt without postings or data is the fixed answer itself.
    """
    routed = cut_lineage(route_queries(questions))
    with_ids = routed.filter(_has_ids(routed))
    filtered = routed.filter(F.col("route") == "filter")
    searched = routed.filter(F.col("route").isin("retrieval", "hybrid") & ~_has_ids(routed))

    blocks = [R.retrieval_blocks(chunks, jobs, searched, **search)]
    statistics = [statistics_for(jobs, routed)]
    if "context_job_ids" in routed.columns:
        blocks.append(R.given_blocks(chunks, jobs, with_ids, R.wanted_from_ids(with_ids)))
    if not filtered.isEmpty():
        more_blocks, more_statistics = _filtered(chunks, jobs, filtered, **search)
        blocks, statistics = blocks + more_blocks, [*statistics, more_statistics]
    context = R.contexts(reduce(DataFrame.unionByName, blocks))
    rows = reduce(DataFrame.unionByName, statistics)

    profile = R.profile_text(F.col("resume")) if "resume" in routed.columns else F.lit("")
    sides = (
        routed.select("query_id", "question", "route", profile.alias("profile"))
        .join(context, "query_id", "left")
        .join(rows, "query_id", "left")
    )
    return sides.select("query_id", *_answer())


def _answer() -> tuple[Column, Column, Column]:
    """Type, prompt and sources from route, context and rows."""
    route, context, rows, question = (F.col(c) for c in ("route", "context", "rows", "question"))
    has_rows = rows.isNotNull() & (rows != "[]")
    kind = (
        F.when((route == "aggregation") | ((route == "hybrid") & context.isNull()), F.lit("aggregation"))
        .when((route == "retrieval") | context.isNull(), F.lit("retrieval"))
        .otherwise(F.lit("hybrid"))
    )
    prompt = (
        F.when((kind == "aggregation") & has_rows, R.aggregation_prompt(question, rows))
        .when(kind == "aggregation", F.lit(K.NO_DATA_ANSWER))
        .when(context.isNull(), F.lit(K.NO_POSTINGS_ANSWER))
        .when(kind == "retrieval", R.retrieval_prompt(question, context, F.col("profile")))
        .otherwise(R.hybrid_prompt(question, context, rows))
    )
    return kind.alias("type"), prompt.alias("prompt"), F.when(kind != "aggregation", F.col("sources")).alias("sources")
