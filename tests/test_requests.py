"""Tables of requests against one request at a time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from checks import views
from tallywork.operators.filters import LISTING, filter_jobs
from tallywork.plans import requests as Q
from tallywork.plans.analytics import TEMPLATES, run_template
from tallywork.plans.routing import statistics_for

SF = "/root/testdata/sf0.001"
PATTERNS = [
    "%", "", "a", "%a%", "_", "__%", "%ing%", "BUILDING%", "%building 1-urgent", "building 1-urgent", "%uilding _-%", "%10\\%%", "%\\_x%", "%nation_1%",
    "%É%", "ärzte%", "%zzz%", "%d%o%", "\\%", "%a\\\\b%", "full\\_time", "%time", "company 1", "%company%", "Remote%",
]
AWKWARD = [
    (100001, "100% remote Ärzte", "É 10% x_x", None, "full_time", 50, 90), (100002, None, None, "", None, None, 10), (100003, "", "a", "a\\b", "%", 7, None),
    (100004, "a\\b c", "Éclair", "İstanbul", "fullXtime", None, None),
]


@pytest.fixture(scope="module")
def jobs(spark):
    rows = views.jobs(spark, SF).select("id", *LISTING, "skills", "fetched_at")
    more = spark.createDataFrame(AWKWARD, "id BIGINT, title STRING, company STRING, location STRING, job_type STRING, min_salary INT, max_salary INT")
    more = more.selectExpr("*", "NULL AS url", "IF(id % 2 = 0, array('py%', NULL, 'Py_'), NULL) AS skills", "NULL AS fetched_at")
    both = rows.unionByName(more.select([F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]))
    path = f"{__import__('tempfile').mkdtemp()}/jobs"
    both.write.parquet(path)
    return spark.read.parquet(path)


def test_like_pairs_equals_ilike(spark, jobs):
    values = jobs.select(F.lit("title").alias("column"), F.col("title").alias("value")).distinct()
    patterns = spark.createDataFrame([("title", p) for p in PATTERNS] + [("company", "%"), ("title", None)], "column STRING, pattern STRING")
    found = {(r.value, r.pattern) for r in Q.like_pairs(values, patterns).collect()}
    wanted = {(r.title, p) for p in PATTERNS for r in jobs.filter(F.col("title").ilike(p)).select("title").collect()}
    assert found == wanted


def test_filters_equal_one_at_a_time(spark, jobs):
    rnd = random.Random(2)
    asked = []
    for i in range(40):
        maybe = lambda options, p=0.5: rnd.choice(options) if rnd.random() < p else None
        asked.append((f"r{i}", maybe(PATTERNS), None, maybe(PATTERNS, 0.3), maybe(PATTERNS, 0.3), None, maybe([0.0, 50.5, 100000.0], 0.4), maybe([90.0, 300000.0], 0.4)))
    asked.append(("nothing", *[None] * 7))
    asked.append(("empty", "", None, "", "", None, None, None))
    schema = "request STRING, title STRING, company STRING, location STRING, job_type STRING, skill STRING, low DOUBLE, high DOUBLE"
    found = {}
    for row in Q.newest_of(jobs, Q.without_empty(spark.createDataFrame(asked, schema)), 30).orderBy("request", "pos").collect():
        found.setdefault(row.request, []).append(row.job.id)
    for name, title, _, location, job_type, _, low, high in asked:
        wanted = [r.id for r in filter_jobs(jobs, title, low, high, location, job_type).collect()]
        assert found.get(name, []) == wanted, (name, title, location, job_type, low, high)


def test_statistics_equal_one_at_a_time(spark, jobs):
    asked = [(name, [p]) for name, filled in Q._FILLED.items() if filled[0] not in ("low", "skill") for p in PATTERNS[:16]]
    asked += [("list_jobs_by_skill", [p]) for p in ("building", "python", "PYX", "nation_1", "nation_%", "")]
    asked += [("jobs_above_salary", [p]) for p in ("0", "200000", " 7 ", "99999999999")]
    asked += [("jobs_between_salary", [a, b]) for a, b in (("0", "100000"), ("250000", "250500"), ("9", "3"))]
    asked += [(name, []) for name in TEMPLATES if name not in Q._FILLED]
    table = spark.createDataFrame([(f"q{i}", "aggregation", *a) for i, a in enumerate(asked)], "query_id STRING, route STRING, intent STRING, params ARRAY<STRING>")
    found = {r.query_id: r.rows for r in statistics_for(jobs, table).collect()}
    assert len(found) == len(asked)
    for i, (name, params) in enumerate(asked):
        assert json.loads(found[f"q{i}"]) == json.loads(Q.rows_json(run_template(jobs, name, params)).first().rows), (name, params)


def test_a_pattern_that_is_none_spoils_no_other(spark, jobs):
    asked = [("bad", "a\\b", None), ("end", "%\\", None), ("both", "%", "x\\y"), ("good", "%building%", None)]
    rows = [(name, title, None, location, None, None, None, None) for name, title, location in asked]
    schema = "request STRING, title STRING, company STRING, location STRING, job_type STRING, skill STRING, low DOUBLE, high DOUBLE"
    more = jobs.limit(1).withColumns({"id": F.lit(7_000_000).cast("bigint"), "skills": F.array(F.lit("C\\C"), F.lit("building"))})
    found = Q.newest_of(jobs.unionByName(more), spark.createDataFrame([*rows, ("skill", None, None, None, None, "BUILDING", None, None)], schema), 30).collect()
    assert {r.request for r in found} == {"good", "skill"}


def test_requests_that_cannot_be_read(spark, jobs):
    asked = [("list_jobs_by_title", []), ("jobs_above_salary", ["much"]), ("jobs_between_salary", ["1", None]), ("jobs_between_salary", ["1"])]
    table = spark.createDataFrame([(f"q{i}", "hybrid", *a) for i, a in enumerate(asked)], "query_id STRING, route STRING, intent STRING, params ARRAY<STRING>")
    assert [r.rows for r in statistics_for(jobs, table).collect()] == ["[]"] * 4
    with pytest.raises(KeyError):
        statistics_for(jobs, table.withColumn("intent", F.lit("no_such_template")))


def test_five_thousand_requests_in_one_plan(spark, jobs):
    """The plan does not grow with the requests, and questions that share one get the same answer."""

    def plan(n):
        table = spark.range(n).selectExpr(
            "concat('q', id) AS query_id", "'aggregation' AS route", "IF(id % 2 = 0, 'list_jobs_by_title', 'salary_stats_by_title') AS intent",
            f"array(concat('%', CAST(id % {n // 2} AS STRING), '-%')) AS params",
        )
        return statistics_for(jobs, table)

    few, many = plan(20), plan(5000)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(few) == size(many)
    assert many.count() == 5000
    assert many.join(spark.range(5000).selectExpr("concat('q', id) AS query_id", "id % 2500 AS pattern", "id % 2 AS kind"), "query_id").groupBy("pattern", "kind").agg(
        F.count_distinct("rows").alias("n")
    ).filter("n > 1").isEmpty()


CONDITIONS = "request STRING, title STRING, company STRING, location STRING, job_type STRING, skill STRING, low DOUBLE, high DOUBLE"


def test_requests_meet_a_few_times_their_rows(spark, monkeypatch):
    """Requests that fit every posting stop looking once they have theirs; rare ones look at all."""
    n, kinds, met = 4000, 120, []
    jobs = spark.range(n).selectExpr(
        "id", "concat('Clerk ', id % 7) AS title", "IF(id % 5 = 0, NULL, 'Acme') AS company", "'Rome' AS location", "'contract' AS job_type",
        "CAST(id * 37 % 1000 AS INT) AS min_salary", "CAST(id * 37 % 1000 + id % 3 AS INT) AS max_salary", "'' AS url", "array('sql') AS skills",
        "IF(id % 11 = 0, NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 90 AS INT))) AS fetched_at",
    )
    asked = [(f"r{i}", "%lerk%", None, None, None, None, float(i % 60), None if i % 2 else 1000.0 - i) for i in range(kinds)]
    rare = [("rare", "clerk 3", "acme", None, None, "SQL", 990.0, None), ("none", "clerk 3", "nobody", None, None, None, None, None), ("pay", *[None] * 5, 998.0, 999.0)]
    inner = Q._met_in
    monkeypatch.setattr(Q, "FIRST_ROUND", 64)
    monkeypatch.setattr(Q, "_met_in", lambda *given: met.append(inner(*given).count()) or inner(*given))
    found = {}
    for r in Q.newest_of(jobs, spark.createDataFrame(asked + rare, CONDITIONS), 30).orderBy("request", "pos").collect():
        found.setdefault(r.request, []).append(r.job.id)
    assert len(met) > 1 and sum(met) < kinds * 30 * Q.GROWTH < kinds * n / 2
    for name, title, company, _, _, _, low, high in asked[:6] + rare:
        rows = filter_jobs(jobs if company is None else jobs.filter(F.col("company").ilike(company)), title, low, high)
        assert found.get(name, []) == [r.id for r in rows.collect()], name


def test_best_paid_between_any_bounds(spark, monkeypatch):
    monkeypatch.setattr(Q, "STRETCHES_OF_PAY", 8)
    rnd = random.Random(5)
    jobs = [(i, rnd.choice([None, *range(0, 900, 7)]), rnd.choice([None, *range(0, 1000, 9)])) for i in range(700)]
    bounds = [(f"r{i}", float(rnd.randrange(-5, 900)), float(rnd.randrange(-5, 1100))) for i in range(80)] + [("all", 0.0, 1e12)]
    table = spark.createDataFrame(jobs, "id BIGINT, min_salary INT, max_salary INT")
    table = table.select("id", *[F.col(c) if c.endswith("salary") else F.lit("x").alias(c) for c in LISTING])
    found = {}
    for r in Q.best_paid_between(table, spark.createDataFrame(bounds, "request STRING, low DOUBLE, high DOUBLE"), 20).orderBy("request", "pos").collect():
        found.setdefault(r.request, []).append(r.job.id)
    for name, low, high in bounds:
        fits = [(-a, i) for i, a, b in jobs if a is not None and b is not None and a >= low and b <= high]
        assert found.get(name, []) == [i for _, i in sorted(fits)[:20]], (name, low, high)
