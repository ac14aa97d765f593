"""Scalar expressions on literals."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywork.functions import postings as P
from tallywork.functions import responses as R
from tallywork.functions import text as T
from tallywork.plans.analytics import TEMPLATES, run_template
from tallywork.plans.routing import route_queries


def values(spark, rows, ddl, column):
    """The column's value for each row."""
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i INT, " + ddl)
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("full_time", "full_time"), ("Full-time", "full_time"), ("FULLTIME", "full_time"), ("Permanent", "full_time"),
        ("full time", "full_time"), ("part_time", "part_time"), ("Part-time", "part_time"), ("part time", "part_time"),
        ("contract", "contract"), ("Contractor", "contract"), ("contract-to-hire", "contract"),
        ("contract to hire", "contract"), ("intern", "internship"), ("Internship", "internship"),
        ("freelance", "freelance"), ("Freelancer", "freelance"), (" full_time ", "full_time"),
        ("remote", None), ("unknown", None), ("temporary", None), ("", None), (None, None),
    ],
)
def test_job_type(spark, raw, expected):
    assert values(spark, [(raw,)], "s STRING", P.normalize_job_type(F.col("s"))) == [expected]


def test_normalize_salary(spark):
    cases = [
        ((30.0, 50.0, "hourly"), (62400, 104000)),
        ((None, 5000.0, "monthly"), (60000, 60000)),
        ((0.0, 0.0, None), (None, None)),
        ((None, None, "hourly"), (None, None)),
        ((100.4, None, "Weekly"), (5221, 5221)),
        ((50000.5, 60000.0, "sometimes"), (50001, 60000)),
    ]
    pay = P.normalize_salary(F.col("a"), F.col("b"), F.col("p"))
    found = values(spark, [c for c, _ in cases], "a DOUBLE, b DOUBLE, p STRING", pay)
    assert [tuple(f) for f in found] == [e for _, e in cases]


def test_salary_text(spark):
    cases = {
        "$60k - $80k": (60000, 80000),
        "$60,000": (60000, 60000),
        "$50/hr": (104000, 104000),
        "paid 15th and 30th": (None, None),
        "60-80k": (80000, 80000),
        "60.5K": (60500, 60500),
        "1,000 per week": (52000, 52000),
        "10 hourly, monthly 3000": (20800, 6240000),
        ", , ,": (None, None),
        "99999999999": (None, None),
        "": (None, None),
    }
    found = values(spark, [(c,) for c in cases], "s STRING", P.parse_salary_text(F.col("s")))
    assert dict(zip(cases, map(tuple, found))) == cases
    assert tuple(values(spark, [(None,)], "s STRING", P.parse_salary_text(F.col("s")))[0]) == (None, None)


def test_skill_lists(spark):
    one = "a ARRAY<STRING>"
    lists = [(["salesforce", "Salesforce Marketing Cloud"],), (["Go", "go"],), (["AWS", "aws", "AWS/GCP"],), (None,), ([],)]
    assert values(spark, lists, one, P.dedupe_substrings(F.col("a"))) == [
        ["Salesforce Marketing Cloud"], ["Go", "go"], ["AWS/GCP"], None, [],
    ]
    assert values(spark, lists, one, P.dedupe_insensitive(F.col("a"))) == [
        ["salesforce", "Salesforce Marketing Cloud"], ["Go"], ["AWS", "AWS/GCP"], None, [],
    ]
    words = [(["AI", " ml ", "C", "42", "Python", "4x4"],)]
    assert values(spark, words, one, P.filter_keywords(F.col("a"))) == [["Python", "4x4"]]
    merged = P.merge_skills(F.col("a"), F.col("b"))
    assert values(spark, [(["React"], ["react.js", "React", "seo"]), (None, None)], one + ", b ARRAY<STRING>", merged) == [
        ["react.js"], [],
    ]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("abAB ", max_size=4), max_size=6), min_size=1, max_size=6))
def test_skill_lists_like_plain_python(spark, lists):
    def insensitive(items):
        seen, kept = set(), []
        for item in items:
            if item.lower() not in seen:
                seen.add(item.lower())
                kept.append(item)
        return kept

    def substrings(items):
        low = [i.lower() for i in items]
        return [i for i, x in zip(items, low) if not any(x in o and len(o) > len(x) for o in low)]

    rows = [(items,) for items in lists]
    assert values(spark, rows, "a ARRAY<STRING>", P.dedupe_insensitive(F.col("a"))) == [insensitive(x) for x in lists]
    assert values(spark, rows, "a ARRAY<STRING>", P.dedupe_substrings(F.col("a"))) == [substrings(x) for x in lists]


@pytest.mark.parametrize(
    ("text", "keyword", "expected"),
    [
        ("learn", "rn", False), ("an RN here", "rn", True), ("C# dev", "c#", True), ("c#x", "c#", False),
        ("react.js", "react.js", True), ("reactxjs", "react.js", False), ("the back-end", "back-end", True),
        ("Spring Boot", "spring boot", True), ("asp.net", ".net", True), (" .net", ".net", False), ("cdl-a", "cdl", True),
    ],
)
def test_keyword(spark, text, keyword, expected):
    ddl, row = "t STRING, k STRING", [(text, keyword)]
    assert values(spark, row, ddl, T.match_keyword(F.col("t"), F.col("k"))) == [expected]
    assert values(spark, row, ddl, T.matches_any(F.lower("t"), [keyword])) == [expected]


def test_html_and_thinking(spark):
    strip = [("<p>a</p>\n <b>b</b> ",), ("no tags",), ("a &amp;lt; b",)]
    assert values(spark, strip, "s STRING", T.strip_html(F.col("s"))) == ["a b", "no tags", "a &amp;lt; b"]
    assert values(spark, strip, "s STRING", T.strip_html_entities(F.col("s"))) == ["a b", "no tags", "a < b"]
    thoughts = [("<think>x\ny</think>\n\n answer",), ("<think>a</think>b<think>c</think>\nd",), ("<think>open",)]
    assert values(spark, thoughts, "s STRING", T.strip_thinking(F.col("s"))) == ["answer", "bd", "<think>open"]


def test_verdicts(spark):
    cases = {
        "relevant": "relevant", "Marginal.": "marginal", "not relevant": "not_relevant", "NOT_RELEVANT": "not_relevant",
        "somewhat relevant": "relevant", "no": "not_relevant", "": "not_relevant",
    }
    found = values(spark, [(c,) for c in cases], "s STRING", T.normalize_verdict(F.col("s")))
    assert dict(zip(cases, found)) == cases


def test_job_answers(spark):
    good = '{"summary":"S","salary":"$1","skills":["sales","Salesforce",3],"jobType":"contract","isRemote":true,"benefits":[]}'
    rows = [(good,), ("```json\n" + good + "\n```",), ("Sure: " + good + " ok?",), ("{broken",), ("5",), (None,),
            ('{"summary":5,"skills":"x","isRemote":"yes","jobType":"gig","requirements":[1,null]}',)]
    found = values(spark, rows, "s STRING", R.extract_job(F.col("s")))
    for parsed in found[:3]:
        assert (parsed.summary, parsed.salary, parsed.skills) == ("S", "$1", ["Salesforce"])
        assert (parsed.job_type, parsed.is_remote, parsed.benefits) == ("contract", True, None)
    for parsed in found[3:]:
        assert all(v is None for v in parsed)


def test_resume_answers(spark):
    raw = (
        '{"name":"N","phone":5,"skills":["a",1],"experience":[{"company":"C","startDate":"2020"},{"description":"d"},7],'
        '"education":[{"degree":"x"},{"institution":"I","graduationYear":2001}]}'
    )
    good, bad = values(spark, [(raw,), ("nothing",)], "s STRING", R.extract_resume(F.col("s")))
    assert (good.name, good.phone, good.skills, good.certifications) == ("N", None, ["a"], [])
    assert [tuple(e) for e in good.experience] == [("C", "", "2020", None, "")]
    assert [tuple(e) for e in good.education] == [("I", None, None, None)]
    assert (bad.name, bad.skills, bad.experience, bad.education) == (None, [], [], [])


def test_route_answers(spark):
    rows = [
        ('{"type":"retrieval","intent":null,"params":[]}',),
        ('{"type":"aggregation","intent":"salary_stats_by_title","params":["%a%"]}',),
        ('{"type":"hybrid","intent":"count_total"}',),
        ("malformed",),
        ('{"type":"other","intent":"count_total"}',),
        ('{"type":"aggregation","intent":"unknown"}',),
    ]
    found = values(spark, rows, "s STRING", R.extract_route(F.col("s"), list(TEMPLATES)))
    assert [(f.type, f.intent, f.params) for f in found] == [
        ("retrieval", None, None), ("aggregation", "salary_stats_by_title", ["%a%"]), ("hybrid", "count_total", None),
        ("retrieval", None, None), ("retrieval", None, None), ("aggregation", None, None),
    ]


def test_wording(spark):
    texts = {
        "how many remote jobs are available": "aggregation",
        "find python developer jobs": "retrieval",
        "find frontend jobs and how many are remote": "hybrid",
        "what types of driving jobs exist": "aggregation",
        "list all available locations": "aggregation",
        "python": "undecided",
    }
    df = spark.createDataFrame([(t,) for t in texts], "question STRING")
    assert {r.question: r.wording for r in route_queries(df).collect()} == texts


def test_unknown_template(spark):
    with pytest.raises(KeyError):
        run_template(spark.range(1), "no_such_template")
