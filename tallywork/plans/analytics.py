"""The catalogue of named statistics and listings over the postings table.

A template is a function from postings and text parameters to a DataFrame. Every top list breaks ties by its key, puts
nulls last and runs as TakeOrderedAndProject; counts and sums are combined before the shuffle, so a hot group costs its
task one row per upstream task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.operators.filters import LISTING, has_skill, is_remote_text, salary_within
from tallywork.operators.ranking import newest_first, top_n

Template = Callable[..., DataFrame]
TEMPLATES: dict[str, Template] = {}


def template(fn: Template) -> Template:
    TEMPLATES[fn.__name__] = fn
    return fn


def run_template(jobs: DataFrame, name: str, params: Sequence[str] = ()) -> DataFrame:
    """Run a template by name; an unknown name is an error."""
    if name not in TEMPLATES:
        raise KeyError(f"Unknown aggregation template: {name}")
    return TEMPLATES[name](jobs, *params)


# ---- building blocks -----------------------------------------------------------------------------

def _rows() -> Column:
    return F.count(F.lit(1))


def mean_rounded(amount: Column, divisor: int = 1) -> Column:
    """Mean of `amount / divisor`, halves away from zero, in whole numbers throughout; null over no rows."""
    return mean_of(F.sum(amount.cast("bigint")), F.count(amount), divisor)


def mean_of(total: Column, count: Column, divisor: int = 1) -> Column:
    """`mean_rounded` from a sum and a count."""
    denominator = F.nullif(count * divisor * 2, F.lit(0))
    numerator = F.abs(total) * 2 + count * divisor
    whole = (numerator - numerator % denominator) / denominator
    return F.round(F.signum(total.cast("double")) * whole).cast("bigint")


def counted(df: DataFrame, key: str, measure: str, top: int | None) -> DataFrame:
    counts = df.groupBy(key).agg(_rows().alias(measure))
    order = (F.desc(measure), F.asc_nulls_last(key))
    return counts.orderBy(*order) if top is None else top_n(counts, top, *order)


def distinct_sorted(values: DataFrame, key: str, top: int) -> DataFrame:
    return top_n(values.select(key).distinct(), top, F.asc(key))


def listing(jobs: DataFrame, condition: Column, columns: Sequence[str] = LISTING) -> DataFrame:
    newest = newest_first(jobs.filter(condition).select("id", "fetched_at", *LISTING), 20)
    return newest.select(*columns)


def _salary_listing(jobs: DataFrame, condition: Column) -> DataFrame:
    rows = jobs.filter(condition).select("id", *LISTING)
    return top_n(rows, 20, F.desc_nulls_last("min_salary"), F.asc("id")).select(*LISTING)


def _salary_stats(rows: DataFrame, by: str | None, top: int | None) -> DataFrame:
    known = rows.filter(F.col("min_salary").isNotNull())
    grouped = known.groupBy() if by is None else known.filter(F.col(by).isNotNull()).groupBy(by)
    stats = grouped.agg(
        F.min("min_salary").alias("min"),
        F.max("max_salary").alias("max"),
        mean_rounded(F.col("min_salary")).alias("avg"),
        _rows().alias("job_count"),
    )
    if by is None:
        return stats
    order = (F.desc("avg"), F.asc(by))
    return stats.orderBy(*order) if top is None else top_n(stats, top, *order)


# ---- counts --------------------------------------------------------------------------------------


@template
def count_total(jobs: DataFrame) -> DataFrame:
    return jobs.agg(_rows().alias("total"))


@template
def count_by_location(jobs: DataFrame) -> DataFrame:
    return counted(jobs.filter(F.col("location").isNotNull()), "location", "count", 20)


@template
def count_by_job_type(jobs: DataFrame) -> DataFrame:
    return counted(jobs.filter(F.col("job_type").isNotNull()), "job_type", "count", None)


@template
def count_by_company(jobs: DataFrame) -> DataFrame:
    return counted(jobs, "company", "count", 20)


@template
def count_remote(jobs: DataFrame) -> DataFrame:
    return jobs.filter(is_remote_text()).agg(_rows().alias("count"))


# ---- salaries ------------------------------------------------------------------------------------


@template
def salary_stats_overall(jobs: DataFrame) -> DataFrame:
    """Range, mean of mid-points where both ends are known, and postings with a lower end."""
    both_ends = F.col("min_salary").cast("bigint") + F.col("max_salary")
    return jobs.agg(
        F.min("min_salary").alias("min"),
        F.max("max_salary").alias("max"),
        mean_rounded(both_ends, divisor=2).alias("avg_mid"),
        F.count("min_salary").alias("jobs_with_salary"),
    )


@template
def salary_stats_by_title(jobs: DataFrame, pattern: str) -> DataFrame:
    """Always one row, also when nothing matches."""
    return _salary_stats(jobs.filter(F.col("title").ilike(pattern)), None, None)


@template
def salary_stats_by_location(jobs: DataFrame) -> DataFrame:
    return _salary_stats(jobs, "location", 20)


@template
def salary_stats_by_job_type(jobs: DataFrame) -> DataFrame:
    return _salary_stats(jobs, "job_type", None)


@template
def jobs_above_salary(jobs: DataFrame, threshold: str) -> DataFrame:
    return _salary_listing(jobs, F.col("min_salary") >= int(threshold))


@template
def jobs_between_salary(jobs: DataFrame, low: str, high: str) -> DataFrame:
    return _salary_listing(jobs, salary_within(int(low), int(high)))


# ---- listings ------------------------------------------------------------------------------------


@template
def list_jobs_by_title(jobs: DataFrame, pattern: str) -> DataFrame:
    return listing(jobs, F.col("title").ilike(pattern))


@template
def list_jobs_by_location(jobs: DataFrame, pattern: str) -> DataFrame:
    return listing(jobs, F.col("location").ilike(pattern))


@template
def list_jobs_by_company(jobs: DataFrame, pattern: str) -> DataFrame:
    return listing(jobs, F.col("company").ilike(pattern))


@template
def list_jobs_by_type(jobs: DataFrame, pattern: str) -> DataFrame:
    return listing(jobs, F.col("job_type").ilike(pattern))


@template
def list_remote_jobs(jobs: DataFrame) -> DataFrame:
    return listing(jobs, is_remote_text(), [c for c in LISTING if c != "location"])


@template
def list_jobs_by_skill(jobs: DataFrame, skill: str) -> DataFrame:
    return listing(jobs, has_skill(skill))


# ---- discovery -----------------------------------------------------------------------------------


@template
def list_distinct_titles(jobs: DataFrame, pattern: str) -> DataFrame:
    return distinct_sorted(jobs.filter(F.col("title").ilike(pattern)), "title", 30)


@template
def list_distinct_locations(jobs: DataFrame) -> DataFrame:
    return distinct_sorted(jobs.filter(F.col("location").isNotNull()), "location", 50)


def skills_of(jobs: DataFrame) -> DataFrame:
    """One row per posting and skill, a repeated skill repeated."""
    return jobs.select(F.explode("skills").alias("skill")).filter(F.col("skill") != "")


@template
def list_distinct_skills(jobs: DataFrame) -> DataFrame:
    return distinct_sorted(skills_of(jobs), "skill", 80)


@template
def list_distinct_companies(jobs: DataFrame, pattern: str) -> DataFrame:
    return distinct_sorted(jobs.filter(F.col("company").ilike(pattern)), "company", 30)


# ---- trends --------------------------------------------------------------------------------------


@template
def top_hiring_companies(jobs: DataFrame) -> DataFrame:
    return counted(jobs, "company", "openings", 20)


@template
def skills_demand(jobs: DataFrame) -> DataFrame:
    return counted(skills_of(jobs), "skill", "job_count", 30)


@template
def recent_jobs(jobs: DataFrame) -> DataFrame:
    return listing(jobs, F.lit(True), [*LISTING, "fetched_at"])
