"""Questions → best chunks → postings → prompt context, for a whole table of questions at once.

Only ids, similarities and texts of the few best chunks are ever joined; the embeddings stay in the search scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.postings import salary_header
from tallywork.functions.text import detect_fields, round_half_up
from tallywork.functions.binding import let
from tallywork.operators.filters import filter_jobs
from tallywork.operators.joins import bounded_join, row_bound
from tallywork.operators.ranking import ranked, top_per_key
from tallywork.operators.vector import MAX_BLOCK_QUERIES, vector_rank_within, vector_top_k
from tallywork.session import cut_lineage

JOB_FIELDS = [
    "title", "company", "location", "job_type", "min_salary", "max_salary", "url",
    "requirements", "responsibilities", "benefits", "skills",
]


def question_bound(queries: DataFrame) -> int | None:
    """The number of questions, if they are few enough to be sent to every task."""
    return row_bound(queries, MAX_BLOCK_QUERIES)


def _times(bound: int | None, factor: int) -> int | None:
    return None if bound is None else bound * factor


# ---- questions -----------------------------------------------------------------------------------


def search_text(question: Column, resume: Column) -> Column:
    """What is embedded: up to three resume titles and 15 skills where there is a resume, else the question."""
    titles = F.filter(F.transform(F.slice(resume["experience"], 1, 3), lambda e: e["title"]), lambda t: t != "")
    words = F.concat_ws(" ", titles, F.slice(resume["skills"], 1, 15))
    return F.coalesce(F.nullif(words, F.lit("")), question)


def profile_text(resume: Column) -> Column:
    """The resume as a block for the prompt; empty without content."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {label}: "), value))

    def past_job(e: Column) -> Column:
        dates = F.concat(F.lit(" ("), e["start_date"], F.lit("–"), F.coalesce(e["end_date"], F.lit("Present")), F.lit(")"))
        return F.concat(e["title"], F.lit(" at "), e["company"], F.when(e["start_date"] != "", dates).otherwise(F.lit("")))

    lines = F.concat_ws(
        "\n",
        line("Name", resume["name"]),
        line("Summary", resume["summary"]),
        line("Skills", F.array_join(resume["skills"], ", ")),
        line("Experience", F.array_join(F.transform(F.slice(resume["experience"], 1, 3), past_job), "; ")),
        line("Location", resume["location"]),
    )
    return F.when(lines != "", F.concat(F.lit("User Profile:\n"), lines, F.lit("\n\n"))).otherwise(F.lit(""))


# ---- search --------------------------------------------------------------------------------------


def chunks_of(chunks: DataFrame, jobs: DataFrame, condition: Column) -> DataFrame:
    """Chunks of the postings that meet a condition: the pre-filter by location or job type."""
    return chunks.join(jobs.filter(condition).select(F.col("id").alias("job_id")), "job_id", "left_semi")


def best_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = K.RETRIEVAL_CHUNKS,
    threshold: float = K.SIMILARITY_THRESHOLD,
    bound: int | None = None,
) -> DataFrame:
    """Top chunks per question with posting id, type and text. The texts are fetched after the search.

    `bound` is the number of questions, if known to be small: it bounds the hits, which may then be broadcast.
    """
    hits = vector_top_k(chunks, queries, k, threshold)
    texts = chunks.select("chunk_id", "job_id", "chunk_type", "chunk_text")
    return bounded_join(texts, hits, "chunk_id", "inner", _times(bound, k))


def group_by_job(hits: DataFrame) -> DataFrame:
    """(query_id, job_id, similarity, body): best similarity and all hit texts, best first. At most k texts a group."""
    parts = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("similarity")).alias("order"),
                "chunk_id",
                F.concat(F.lit("["), "chunk_type", F.lit("]: "), "chunk_text").alias("text"),
            )
        )
    )
    return hits.groupBy("query_id", "job_id").agg(
        F.max("similarity").alias("similarity"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("body"),
    )


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = K.RETRIEVAL_CHUNKS,
    n_jobs: int = K.RETRIEVAL_JOBS,
    threshold: float = K.SIMILARITY_THRESHOLD,
    bound: int | None = None,
) -> DataFrame:
    """(query_id, job_id, similarity, body, rank): the best postings per question."""
    groups = group_by_job(best_chunks(chunks, queries, k, threshold, bound))
    return top_per_key(groups, ["query_id"], [F.desc("similarity"), F.asc("job_id")], n_jobs, rank="rank")


def rank_given(chunks: DataFrame, queries: DataFrame, wanted: DataFrame, bound: int | None = None) -> DataFrame:
    """Given postings (query_id, job_id, pos) with their best similarity, 0 without chunks, best first as `rank`."""
    scores = (
        vector_rank_within(chunks, queries, wanted, bound)
        .groupBy("query_id", "job_id")
        .agg(F.max("similarity").alias("similarity"))
    )
    scored = wanted.join(scores, ["query_id", "job_id"], "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0))
    )
    return ranked(scored, ["query_id"], [F.desc("similarity"), F.asc("pos")])


# ---- context -------------------------------------------------------------------------------------


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f" | {label}: "), value)).otherwise(F.lit(""))


def field_appendix(fields: Column, body: Column) -> Column:
    """Lists the question asks for that the body does not carry under their tag."""

    def appendix(asked: Column) -> Column:
        lines = [
            F.when(
                F.array_contains(asked, name)
                & (F.coalesce(F.size(F.col(name)), F.lit(0)) > 0)
                & ~F.contains(body, F.lit(f"[{name}]:")),
                F.concat(F.lit(f"[{name}]: "), F.array_join(name, ", ")),
            )
            for name in K.APPENDIX_FIELDS
        ]
        text = F.concat_ws("\n", *lines)
        return F.when(text != "", F.concat(F.lit("\n"), text)).otherwise(F.lit(""))

    return let(fields, appendix)


def context_blocks(
    found: DataFrame, jobs: DataFrame, questions: DataFrame, body: Column, found_rows: int | None, bound: int | None
) -> DataFrame:
    """One prompt block per found posting; postings that no longer exist drop out.

    `found` has query_id, job_id, similarity, rank; `body` is the block's text, cut at the context limit. `found_rows` and
    `bound` are the known bounds of found postings and questions.
    """
    asked = questions.select("query_id", detect_fields(F.col("question")).alias("_fields"))
    asked = bounded_join(found, asked, "query_id", "inner", bound)
    needed = jobs.withColumnRenamed("id", "job_id")
    rows = bounded_join(needed, asked, "job_id", "inner", found_rows)
    cut = F.substring(F.coalesce(body, F.lit("")), 1, K.JOB_CONTEXT_CHARS)
    rows = rows.withColumn("_body", cut)
    header = F.concat(
        F.lit("Job: "), "title", F.lit(" at "), "company",
        _labelled("Location", F.col("location")),
        _labelled("Type", F.col("job_type")),
        salary_header(F.col("min_salary"), F.col("max_salary")),
        F.lit(" | Similarity: "), F.format_string("%.2f", "similarity"),
    )
    block = F.concat(
        F.lit("---\n"), header, F.lit("\n"), "_body", field_appendix(F.col("_fields"), F.col("_body"))
    )
    return rows.select("query_id", "rank", "job_id", "title", "company", "url", "similarity", block.alias("block"))


def retrieval_blocks(
    chunks: DataFrame,
    jobs: DataFrame,
    queries: DataFrame,
    k: int = K.RETRIEVAL_CHUNKS,
    n_jobs: int = K.RETRIEVAL_JOBS,
    threshold: float = K.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Blocks of the best postings for questions (query_id, question, vector)."""
    bound = question_bound(queries)
    found = retrieve(chunks, queries, k, n_jobs, threshold, bound)
    found = found.withColumn("body", F.substring("body", 1, K.JOB_CONTEXT_CHARS))  # cut before it may be broadcast
    narrow = jobs.select("id", *JOB_FIELDS)
    return context_blocks(found, narrow, queries, F.col("body"), _times(bound, n_jobs), bound)


def given_blocks(chunks: DataFrame, jobs: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of given postings, with the description as body."""
    bound = question_bound(queries)
    found = rank_given(chunks, queries, wanted, bound)
    narrow = jobs.select("id", *JOB_FIELDS, "description")
    return context_blocks(found, narrow, queries, F.col("description"), row_bound(wanted), bound)


def wanted_from_ids(queries: DataFrame, ids: str = "context_job_ids") -> DataFrame:
    """(query_id, job_id, pos) from a column of id lists."""
    return queries.select("query_id", F.posexplode(ids).alias("pos", "job_id"))


def filter_then_retrieve(chunks: DataFrame, jobs: DataFrame, queries: DataFrame, filters: dict, **search) -> DataFrame:
    """Blocks for the postings a compound filter finds (30 at most); an empty find falls back to the search."""
    found = filter_jobs(jobs, **filters).select(F.lit("").alias("request"), F.monotonically_increasing_id().alias("pos"), F.struct("id").alias("job"))
    asked = queries.withColumn("request", F.lit(""))
    return reduce(DataFrame.unionByName, found_blocks(chunks, jobs, asked, cut_lineage(found), **search))


def found_blocks(chunks: DataFrame, jobs: DataFrame, queries: DataFrame, found: DataFrame, **search) -> list[DataFrame]:
    """Blocks of the postings found for each question's `request` (`request`, `job`, `pos`), and of a search where there are none."""
    wanted = queries.select("query_id", "request").join(found.select("request", "pos", F.col("job.id").alias("job_id")), "request")
    wanted = cut_lineage(wanted.select("query_id", "pos", "job_id"))
    blocks = [given_blocks(chunks, jobs, queries, wanted)]
    without = queries.join(wanted.select("query_id"), "query_id", "left_anti")
    if not without.isEmpty():
        blocks.append(retrieval_blocks(chunks, jobs, without, **search))
    return blocks


def contexts(blocks: DataFrame) -> DataFrame:
    """(query_id, context, sources): a question's blocks in rank order, and its source list."""
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                "rank",
                "block",
                F.struct(
                    "job_id", "title", "company", "url", round_half_up(F.col("similarity"), 2).alias("similarity")
                ).alias("source"),
            )
        )
    )
    return (
        blocks.groupBy("query_id")
        .agg(ordered.alias("ordered"))
        .select(
            "query_id",
            F.array_join(F.transform("ordered", lambda b: b["block"]), "\n\n").alias("context"),
            F.transform("ordered", lambda b: b["source"]).alias("sources"),
        )
    )


def sources(blocks: DataFrame) -> DataFrame:
    """One row per question and source posting."""
    return blocks.select(
        "query_id", "job_id", "title", "company", "url", round_half_up(F.col("similarity"), 2).alias("similarity")
    )


# ---- prompts -------------------------------------------------------------------------------------


def retrieval_prompt(question: Column, context: Column, profile: Column) -> Column:
    return F.concat(
        F.lit(K.RETRIEVAL_PROMPT_HEAD), F.coalesce(profile, F.lit("")), F.lit("Job Postings:\n"), context,
        F.lit("\n\nUser Query: "), question, F.lit("\n\nAnswer:"),
    )


def aggregation_prompt(question: Column, rows: Column) -> Column:
    return F.concat(
        F.lit(K.AGGREGATION_PROMPT_HEAD), F.lit("Data:\n"), rows, F.lit("\n\nUser question: "), question, F.lit("\n\nAnswer:")
    )


def hybrid_prompt(question: Column, context: Column, rows: Column) -> Column:
    return F.concat(
        F.lit(K.HYBRID_PROMPT_HEAD), F.lit("Job listings:\n"), context, F.lit("\n\nStatistical data:\n"), rows,
        F.lit("\n\nUser question: "), question, F.lit("\n\nAnswer:"),
    )


def hybrid_answers(questions: DataFrame, context: DataFrame, statistics: DataFrame) -> DataFrame:
    """(query_id, type, prompt): both sides where both exist, else whichever exists, else the fixed answer as prompt.

    `context` is the output of `contexts`, `statistics` has query_id and rows (JSON).
    """
    sides = context.select("query_id", "context").join(statistics.select("query_id", "rows"), "query_id", "full_outer")
    both = questions.select("query_id", "question").join(sides, "query_id", "left")
    has_rows = F.col("rows").isNotNull() & (F.col("rows") != "[]")
    kind = (
        F.when(F.col("context").isNotNull() & F.col("rows").isNotNull(), F.lit("hybrid"))
        .when(F.col("context").isNotNull(), F.lit("retrieval"))
        .when(has_rows, F.lit("aggregation"))
        .otherwise(F.lit("none"))
    )
    question = F.col("question")
    prompt = (
        F.when(kind == "hybrid", hybrid_prompt(question, F.col("context"), F.col("rows")))
        .when(kind == "retrieval", retrieval_prompt(question, F.col("context"), F.lit("")))
        .when(kind == "aggregation", aggregation_prompt(question, F.col("rows")))
        .when(F.col("rows").isNotNull(), F.lit(K.NO_DATA_ANSWER))
        .otherwise(F.lit(K.NO_POSTINGS_ANSWER))
    )
    return both.select("query_id", kind.alias("type"), prompt.alias("prompt"))
