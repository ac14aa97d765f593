"""Statistics, listings, filters, paging and lookups over the postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import add, check
from tallywork.operators import filters, joins, ranking
from tallywork.plans import analytics

LISTING = "title, company, location, job_type, min_salary, max_salary, url"
REMOTE = "(location ILIKE '%remote%' OR job_type ILIKE '%remote%')"
_MEAN = "CAST((2 * sum(min_salary) + count(min_salary)) // (2 * count(min_salary)) AS BIGINT)"


def _stats(by: str | None, where: str, tail: str = "") -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"SELECT {key}min(min_salary) AS min, max(max_salary) AS max, {_MEAN} AS avg, count(*) AS job_count "
        f"FROM jobs WHERE min_salary IS NOT NULL AND {where}{group}{tail}"
    )


def _newest(where: str, columns: str = LISTING) -> str:
    return f"SELECT {columns} FROM jobs WHERE {where} ORDER BY fetched_at DESC NULLS LAST, id LIMIT 20"


def _template(name: str, template: str, sql: str, *params: str) -> None:
    add(
        name,
        lambda spark, sf: analytics.run_template(views.jobs(spark, sf), template, params),
        views.with_ctes(views.JOBS) + sql,
    )


_template("A01_count_total", "count_total", "SELECT count(*) AS total FROM jobs")
_template(
    "A02_count_by_location",
    "count_by_location",
    "SELECT location, count(*) AS count FROM jobs WHERE location IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
_template(
    "A03_count_by_job_type",
    "count_by_job_type",
    "SELECT job_type, count(*) AS count FROM jobs WHERE job_type IS NOT NULL GROUP BY 1",
)
_template(
    "A04_count_by_company",
    "count_by_company",
    "SELECT company, count(*) AS count FROM jobs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
_template("A05_count_remote", "count_remote", f"SELECT count(*) AS count FROM jobs WHERE {REMOTE}")
_template(
    "A06_salary_stats_overall",
    "salary_stats_overall",
    "SELECT min(min_salary) AS min, max(max_salary) AS max, "
    "CAST((sum(CAST(min_salary AS BIGINT) + max_salary) + count(min_salary + max_salary)) "
    "// (2 * count(min_salary + max_salary)) AS BIGINT) AS avg_mid, "
    "count(*) FILTER (WHERE min_salary IS NOT NULL) AS jobs_with_salary FROM jobs",
)
_template("A07_salary_stats_by_title", "salary_stats_by_title", _stats(None, "title ILIKE '%build%'"), "%build%")
_template(
    "A07_salary_stats_by_title_none",
    "salary_stats_by_title",
    "SELECT min(min_salary) AS min, max(max_salary) AS max, CAST(round(avg(min_salary)) AS BIGINT) AS avg, "
    "count(*) AS job_count FROM jobs WHERE title ILIKE '%astronaut%'",
    "%astronaut%",
)
_template(
    "A08_salary_stats_by_location",
    "salary_stats_by_location",
    _stats("location", "location IS NOT NULL", " ORDER BY avg DESC, location LIMIT 20"),
)
_template("A09_salary_stats_by_job_type", "salary_stats_by_job_type", _stats("job_type", "job_type IS NOT NULL"))
_template(
    "A10_jobs_above_salary",
    "jobs_above_salary",
    f"SELECT {LISTING} FROM jobs WHERE min_salary >= 150000 ORDER BY min_salary DESC, id LIMIT 20",
    "150000",
)
_template(
    "A11_jobs_between_salary",
    "jobs_between_salary",
    f"SELECT {LISTING} FROM jobs WHERE min_salary >= 80000 AND max_salary <= 120000 ORDER BY min_salary DESC, id LIMIT 20",
    "80000",
    "120000",
)
_template("A12_list_jobs_by_title", "list_jobs_by_title", _newest("title ILIKE '%machin%'"), "%machin%")
_template("A12_list_jobs_by_location", "list_jobs_by_location", _newest("location ILIKE '%n_1%'"), "%n_1%")
_template("A12_list_jobs_by_company", "list_jobs_by_company", _newest("company ILIKE 'company _'"), "company _")
_template("A12_list_jobs_by_type", "list_jobs_by_type", _newest("job_type ILIKE '%full%'"), "%full%")
_template(
    "A13_list_remote_jobs", "list_remote_jobs", _newest(REMOTE, "title, company, job_type, min_salary, max_salary, url")
)
_template(
    "A14_list_jobs_by_skill",
    "list_jobs_by_skill",
    _newest("len(list_filter(skills, lambda s: 'building' ILIKE s)) > 0"),
    "building",
)
_template(
    "A15_list_distinct_titles",
    "list_distinct_titles",
    "SELECT DISTINCT title FROM jobs WHERE title ILIKE '%u%' ORDER BY title LIMIT 30",
    "%u%",
)
_template(
    "A15_list_distinct_companies",
    "list_distinct_companies",
    "SELECT DISTINCT company FROM jobs WHERE company ILIKE '%7%' ORDER BY company LIMIT 30",
    "%7%",
)
_template(
    "A16_list_distinct_locations",
    "list_distinct_locations",
    "SELECT DISTINCT location FROM jobs WHERE location IS NOT NULL ORDER BY location LIMIT 50",
)
_template(
    "A17_list_distinct_skills",
    "list_distinct_skills",
    "SELECT DISTINCT skill FROM (SELECT unnest(skills) AS skill FROM jobs) WHERE skill <> '' ORDER BY skill LIMIT 80",
)
_template(
    "A18_top_hiring_companies",
    "top_hiring_companies",
    "SELECT company, count(*) AS openings FROM jobs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
_template(
    "A19_skills_demand",
    "skills_demand",
    "SELECT skill, count(*) AS job_count FROM (SELECT unnest(skills) AS skill FROM jobs) WHERE skill <> '' "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
)
_template("A20_recent_jobs", "recent_jobs", _newest("TRUE", LISTING + ", fetched_at"))


# ---- browse filters ------------------------------------------------------------------------------


def _browse(name: str, where: str, **given) -> None:
    """All matching ids, and how many: the listing's filter without its paging."""
    add(
        name,
        lambda spark, sf: views.jobs(spark, sf).filter(filters.browse_filter(**given)).select("id", "title", "company"),
        views.with_ctes(views.JOBS) + f"SELECT id, title, company FROM jobs WHERE {where}",
    )


_browse("P01_no_filter", "TRUE")
_browse("P02_equality", "source = 'src2' AND job_type = 'contract'", source="src2", job_type="contract")
_browse("P02_not_remote", "is_remote = FALSE", is_remote=False)
_browse("P03_location_contains", "contains(lower(location), 'nation_1')", location="Nation_1")
_browse(
    "P04_keyword_title_or_company",
    "(contains(lower(title), 'urgent') OR contains(lower(company), 'urgent'))",
    keyword="Urgent",
)
_browse("P05_salary_overlap", "max_salary >= 90000 AND min_salary <= 95000", min_salary=90000, max_salary=95000)
_browse(
    "P01_all_filters",
    "source = 'src1' AND contains(lower(location), 'a') AND job_type = 'part_time' AND is_remote = TRUE "
    "AND (contains(lower(title), 'o') OR contains(lower(company), 'o')) AND max_salary >= 50000 AND min_salary <= 200000",
    source="src1",
    location="a",
    job_type="part_time",
    is_remote=True,
    keyword="O",
    min_salary=50000,
    max_salary=200000,
)


@check("P06_salary_within", views.with_ctes(views.JOBS) + "SELECT id FROM jobs WHERE min_salary >= 60000 AND max_salary <= 90000")
def _(spark, sf):
    return views.jobs(spark, sf).filter(filters.salary_within(60000, 90000)).select("id")


@check("P07_wildcards", views.with_ctes(views.JOBS) + "SELECT id FROM jobs WHERE title ILIKE 'auto%_-high' OR location ILIKE 'remote - %'")
def _(spark, sf):
    jobs = views.jobs(spark, sf)
    return jobs.filter(F.col("title").ilike("auto%_-high") | F.col("location").ilike("remote - %")).select("id")


@check(
    "P08_skill_is_the_pattern",
    views.with_ctes(views.JOBS)
    + "SELECT id FROM jobs WHERE len(list_filter(list_transform(skills, lambda s: concat(left(s, 3), '%')), lambda s: 'building site' ILIKE s)) > 0",
)
def _(spark, sf):
    """Skills that hold a wildcard match as patterns."""
    jobs = views.jobs(spark, sf).withColumn("skills", F.transform("skills", lambda s: F.concat(F.left(s, F.lit(3)), F.lit("%"))))
    return jobs.filter(filters.has_skill("building site")).select("id")


@check(
    "P09_present_and_not_empty",
    views.with_ctes(views.JOBS) + "SELECT id FROM jobs WHERE location IS NOT NULL AND job_type IS NOT NULL AND job_type <> ''",
)
def _(spark, sf):
    jobs = views.jobs(spark, sf)
    return jobs.filter(F.col("location").isNotNull() & F.col("job_type").isNotNull() & (F.col("job_type") != "")).select("id")


@check("P10_remote_text", views.with_ctes(views.JOBS) + f"SELECT id, is_remote FROM jobs WHERE {REMOTE}")
def _(spark, sf):
    return views.jobs(spark, sf).filter(filters.is_remote_text()).select("id", "is_remote")


def _filter_jobs(name: str, where: str, **given) -> None:
    add(
        name,
        lambda spark, sf: filters.filter_jobs(views.jobs(spark, sf), **given),
        views.with_ctes(views.JOBS)
        + f"SELECT id, {LISTING} FROM jobs WHERE {where} ORDER BY fetched_at DESC NULLS LAST, id LIMIT 30",
    )


_filter_jobs("P11_filter_jobs_title", "title ILIKE '%furn%'", title="%furn%")
_filter_jobs("P11_filter_jobs_salary", "min_salary >= 150000", min_salary=150000)
_filter_jobs("P11_filter_jobs_max_salary", "max_salary <= 200000", max_salary=200000)
_filter_jobs(
    "P11_filter_jobs_all",
    "title ILIKE '%furn%' AND min_salary >= 20000 AND location ILIKE '%a%' AND job_type ILIKE '%time%'",
    title="%furn%",
    min_salary=20000,
    location="%a%",
    job_type="%time%",
)
_filter_jobs("P11_filter_jobs_empty", "FALSE")


@check("P12_listing_projection", views.with_ctes(views.JOBS) + f"SELECT {LISTING}, fetched_at FROM jobs")
def _(spark, sf):
    return views.jobs(spark, sf).select(*filters.LISTING, "fetched_at")


# ---- paging, ranking, lookups --------------------------------------------------------------------


@check(
    "W03_page",
    views.with_ctes(views.JOBS)
    + "SELECT id, title, created_at FROM jobs WHERE job_type = 'freelance' ORDER BY created_at DESC NULLS LAST, id LIMIT 25 OFFSET 50",
)
def _(spark, sf):
    rows = views.jobs(spark, sf).filter(filters.browse_filter(job_type="freelance"))
    return ranking.page(rows, 3, 25).select("id", "title", "created_at")


@check(
    "W03_deep_page",
    views.with_ctes(views.JOBS)
    + ", t AS (SELECT greatest(1, CAST(floor(count(*) * 0.9 / 20) AS BIGINT)) AS page FROM jobs) "
    "SELECT id, title, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS place FROM jobs) "
    "WHERE place > ((SELECT page FROM t) - 1) * 20 AND place <= (SELECT page FROM t) * 20",
)
def _(spark, sf):
    """A page nine tenths down."""
    rows = views.jobs(spark, sf)
    number = max(1, int(rows.count() * 0.9 // 20))
    return ranking.page(rows, number, 20).select("id", "title", "created_at")


@check(
    "W03_page_totals",
    views.with_ctes(views.JOBS)
    + "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM jobs WHERE job_type = 'freelance'",
)
def _(spark, sf):
    return ranking.page_totals(views.jobs(spark, sf).filter(filters.browse_filter(job_type="freelance")))


@check(
    "W01_top_by_measure",
    views.with_ctes(views.JOBS)
    + "SELECT company, max(max_salary) AS best FROM jobs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
)
def _(spark, sf):
    best = views.jobs(spark, sf).groupBy("company").agg(F.max("max_salary").alias("best"))
    return ranking.top_n(best, 50, F.desc_nulls_last("best"), F.asc("company"))


@check(
    "W02_newest_first",
    views.with_ctes(views.JOBS) + "SELECT id, fetched_at FROM jobs WHERE is_remote ORDER BY fetched_at DESC, id LIMIT 30",
)
def _(spark, sf):
    return ranking.newest_first(views.jobs(spark, sf).filter("is_remote").select("id", "fetched_at"), 30)


@check(
    "W07_best_paid_per_company",
    views.with_ctes(views.JOBS)
    + "SELECT company, id, min_salary, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company "
    "ORDER BY min_salary DESC NULLS LAST, id) AS rank FROM jobs) WHERE rank <= 5",
)
def _(spark, sf):
    rows = views.jobs(spark, sf).select("company", "id", "min_salary")
    return ranking.top_per_key(rows, ["company"], [F.desc_nulls_last("min_salary"), F.asc("id")], 5, rank="rank")


@check("S01_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(spark, sf):
    return views.table(spark, sf, "orders")


@check("S02_point_lookup", views.with_ctes(views.JOBS) + f"SELECT id, {LISTING} FROM jobs WHERE id = 77")
def _(spark, sf):
    return joins.point_lookup(views.jobs(spark, sf), 77).select("id", *filters.LISTING)


@check("S02_lookup_ids", views.with_ctes(views.JOBS) + f"SELECT id, {LISTING} FROM jobs WHERE id IN (3, 5, 8, 1300, 999999999)")
def _(spark, sf):
    return joins.lookup_ids(views.jobs(spark, sf), [3, 5, 8, 1300, 999999999]).select("id", *filters.LISTING)


@check("D03_distinct_values", views.with_ctes(views.JOBS) + "SELECT DISTINCT title, job_type FROM jobs")
def _(spark, sf):
    return views.jobs(spark, sf).select("title", "job_type").distinct()
