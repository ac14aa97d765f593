"""Posting filters. Each conjunct is there only if its parameter is given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.text import contains_insensitive
from tallywork.operators.ranking import newest_first

LISTING = ["title", "company", "location", "job_type", "min_salary", "max_salary", "url"]


def all_of(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def is_remote_text() -> Column:
    """Remote by wording of location or job type (the statistics' notion, not the `is_remote` flag)."""
    return F.col("location").ilike("%remote%") | F.col("job_type").ilike("%remote%")


def has_skill(skill: str) -> Column:
    """Some skill of the posting, read as a LIKE pattern, matches `skill` regardless of case."""
    return F.exists("skills", lambda pattern: F.ilike(F.lit(skill), pattern))


def salary_overlaps(low: int | None, high: int | None) -> Column:
    """The posting's range meets [low, high]; unknown ranges never do."""
    return all_of(
        [
            None if low is None else F.col("max_salary") >= low,
            None if high is None else F.col("min_salary") <= high,
        ]
    )


def salary_within(low: float | None, high: float | None) -> Column:
    """The posting's range lies inside [low, high]."""
    return all_of(
        [
            None if low is None else F.col("min_salary") >= low,
            None if high is None else F.col("max_salary") <= high,
        ]
    )


def browse_filter(
    source: str | None = None,
    location: str | None = None,
    job_type: str | None = None,
    is_remote: bool | None = None,
    keyword: str | None = None,
    min_salary: int | None = None,
    max_salary: int | None = None,
) -> Column:
    """The faceted listing's filter. Empty texts count as absent; `is_remote=False` is a real value."""
    return all_of(
        [
            F.col("source") == source if source else None,
            contains_insensitive(F.col("location"), location) if location else None,
            F.col("job_type") == job_type if job_type else None,
            F.col("is_remote") == F.lit(is_remote) if is_remote is not None else None,
            contains_insensitive(F.col("title"), keyword) | contains_insensitive(F.col("company"), keyword)
            if keyword
            else None,
            salary_overlaps(min_salary, max_salary),
        ]
    )


def filter_jobs(
    jobs: DataFrame,
    title: str | None = None,
    min_salary: float | None = None,
    max_salary: float | None = None,
    location: str | None = None,
    job_type: str | None = None,
) -> DataFrame:
    """Compound search with caller-written wildcards: newest 30. Without any filter there are no rows."""
    given = [
        F.col("title").ilike(title) if title else None,
        salary_within(min_salary, max_salary) if min_salary is not None or max_salary is not None else None,
        F.col("location").ilike(location) if location else None,
        F.col("job_type").ilike(job_type) if job_type else None,
    ]
    if all(c is None for c in given):
        return jobs.select("id", *LISTING).limit(0)
    return newest_first(jobs.filter(all_of(given)).select("id", *LISTING, "fetched_at"), 30).select("id", *LISTING)
