"""Which job answers a question: search, a statistic, a compound filter, or search plus statistic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.responses import extract_route
from tallywork.functions.text import WORD
from tallywork.operators.joins import hot_key_join
from tallywork.plans.analytics import TEMPLATES, run_template
from tallywork.plans.requests import answered
from tallywork.session import cut_lineage


def _mentions(question: Column, words: str) -> Column:
    return question.rlike(rf"(?i)(?<!{WORD})(?:{words})(?!{WORD})")


def wording(question: Column) -> Column:
    """aggregation, retrieval, hybrid (both) or undecided, by wording alone."""
    counts, finds = _mentions(question, K.AGGREGATION_WORDS), _mentions(question, K.RETRIEVAL_WORDS)
    return (
        F.when(counts & finds, F.lit("hybrid"))
        .when(counts, F.lit("aggregation"))
        .when(finds, F.lit("retrieval"))
        .otherwise(F.lit("undecided"))
    )


def route_queries(questions: DataFrame) -> DataFrame:
    """Adds wording, route, intent, params, filters.

    `questions` has question and optionally context_job_ids (explicit ids mean search) and response (a classifier's
    answer, used where the wording does not settle it). A statistic is only routed to with a known intent; without one
    the question is searched, so every question gets an answer.
    """
    has = questions.columns
    ids = F.col("context_job_ids") if "context_job_ids" in has else F.lit(None).cast("array<string>")
    response = F.col("response") if "response" in has else F.lit(None).cast("string")
    rows = questions.withColumn("wording", wording(F.col("question"))).withColumn(
        "_answer", extract_route(response, list(TEMPLATES))
    )
    answer = F.col("_answer")
    kind = F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.lit("retrieval")).when(
        F.col("wording") != "undecided", F.col("wording")
    ).otherwise(answer["type"])
    route = (
        F.when(kind == "retrieval", F.lit("retrieval"))
        .when(answer["intent"].isNull(), F.lit("retrieval"))
        .when((answer["intent"] == "filter_jobs") & answer["filters"].isNotNull(), F.lit("filter"))
        .when(answer["intent"] == "filter_jobs", F.lit("retrieval"))
        .otherwise(kind)
    )
    uses_answer = F.col("route") != "retrieval"
    return (
        rows.withColumn("route", route)
        .withColumn("intent", F.when(uses_answer, answer["intent"]))
        .withColumn("params", F.when(uses_answer, answer["params"]))
        .withColumn("filters", F.when(uses_answer, answer["filters"]))
        .drop("_answer")
    )


def statistics_for(jobs: DataFrame, routed: DataFrame, run: Callable[..., DataFrame] = run_template) -> DataFrame:
    """(query_id, rows): each statistic question's template result as JSON.

    Equal requests are answered once, however many questions share them, and all requests by one plan.
    """
    params = F.coalesce("params", F.array().cast("array<string>"))
    asked = routed.filter(F.col("route").isin("aggregation", "hybrid")).select("query_id", "intent", params.alias("params"))
    asked = cut_lineage(asked.withColumn("request", F.to_json(F.struct("intent", "params"))))
    answers = answered(jobs, asked.select("request", "intent", "params").distinct(), run)
    return hot_key_join(asked, answers, "request", "inner", ["query_id"]).select("query_id", "rows")
