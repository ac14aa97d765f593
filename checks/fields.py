"""Field normalisation, text cleaning and answer parsing over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import check
from tallywork import constants as K
from tallywork.functions import postings as P
from tallywork.functions import responses as R
from tallywork.functions import text as T
from tallywork.plans.analytics import TEMPLATES

_SPELLINGS = [
    ("full_time", "full_time"), ("Full-time", "full_time"), ("FULLTIME", "full_time"), ("Permanent", "full_time"),
    (" full time\t", "full_time"), ("part_time", "part_time"), ("Part-time", "part_time"), ("part time", "part_time"),
    ("PartTime", "part_time"), ("contract", "contract"), ("Contractor", "contract"), ("contract-to-hire", "contract"),
    ("Contract To Hire", "contract"), ("intern", "internship"), ("Internship", "internship"),
    ("freelance", "freelance"), ("Freelancer", "freelance"), ("remote", None), ("temporary", None), ("", None), (None, None),
]


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value + "'"


def _case(key: str, values: list[str | None]) -> str:
    """A CASE over `key % n`, the same text on both engines."""
    whens = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


_RAW_TYPE = _case("o_orderkey", [raw for raw, _ in _SPELLINGS])


@check(
    "F01_normalize_job_type",
    f"SELECT o_orderkey AS id, {_RAW_TYPE} AS raw, {_case('o_orderkey', [t for _, t in _SPELLINGS])} AS job_type FROM orders",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_RAW_TYPE} AS raw")
    return rows.select("id", "raw", P.normalize_job_type(F.col("raw")).alias("job_type"))


_PERIODS = ["hourly", "Hour", "monthly", "month", "WEEKLY", "week", "yearly", "annual", "fortnight", None]
_FACTORS = {"hourly": 2080, "Hour": 2080, "monthly": 12, "month": 12, "WEEKLY": 52, "week": 52}
_SALARY_INPUT = (
    "o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 0.0 "
    "ELSE floor(o_totalprice) / 8 END AS lo, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0.0 "
    f"ELSE floor(o_totalprice) / 4 END AS hi, {_case('o_orderkey', _PERIODS)} AS period"
)


@check(
    "F02_normalize_salary",
    f"""WITH s AS (SELECT {_SALARY_INPUT} FROM orders),
f AS (SELECT *, {' '.join(['CASE', *[f"WHEN period = '{p}' THEN {f}" for p, f in _FACTORS.items()], 'ELSE 1 END'])} AS factor FROM s),
y AS (SELECT id, nullif(CAST(floor(lo * factor + 0.5) AS INT), 0) AS a, nullif(CAST(floor(hi * factor + 0.5) AS INT), 0) AS b FROM f)
SELECT id, coalesce(a, b) AS min_salary, coalesce(b, a) AS max_salary FROM y""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders", spread=True).selectExpr(*_split_select(_SALARY_INPUT))
    pay = P.normalize_salary(F.col("lo"), F.col("hi"), F.col("period"))
    return rows.select("id", pay.alias("pay")).select("id", "pay.min_salary", "pay.max_salary")


def _split_select(text: str) -> list[str]:
    """Select items of a text, split at commas outside parentheses and CASEs."""
    items, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(text[start:i])
            start = i + 1
    return [*items, text[start:]]


_SALARY_TEXT = """CASE o_orderkey % 12
 WHEN 0 THEN concat('$', CAST(20 + o_orderkey % 90 AS STRING), 'k - $', CAST(40 + o_orderkey % 90 AS STRING), 'K')
 WHEN 1 THEN concat('USD ', CAST(20 + o_orderkey % 90 AS STRING), ',500 a year')
 WHEN 2 THEN concat('$', CAST(10 + o_orderkey % 90 AS STRING), '/hr')
 WHEN 3 THEN concat(CAST(1000 + o_orderkey % 900 AS STRING), '.50 to ', CAST(2000 + o_orderkey % 900 AS STRING), ' per month')
 WHEN 4 THEN 'paid 15th and 30th'
 WHEN 5 THEN concat(CAST(20 + o_orderkey % 70 AS STRING), '-', CAST(90 + o_orderkey % 70 AS STRING), 'k')
 WHEN 6 THEN concat('1,', CAST(100 + o_orderkey % 900 AS STRING), ' weekly, 4 weeks off')
 WHEN 7 THEN concat('Hourly: ', CAST(10 + o_orderkey % 30 AS STRING), ' monthly bonus 500')
 WHEN 8 THEN concat('60.5k, then 61.25k, then ', CAST(o_orderkey AS STRING), '000')
 WHEN 9 THEN 'competitive, , DOE'
 WHEN 10 THEN ''
 END"""


@check(
    "F03_parse_salary_text",
    f"""WITH s AS (SELECT o_orderkey AS id, {_SALARY_TEXT} AS raw FROM orders),
n AS (SELECT id, raw, CASE WHEN regexp_matches(raw, '(?i)per\\s*hour|/\\s*hour|/\\s*hr\\b|hourly') THEN 2080
 WHEN regexp_matches(raw, '(?i)per\\s*month|/\\s*month|monthly') THEN 12
 WHEN regexp_matches(raw, '(?i)per\\s*week|/\\s*week|weekly') THEN 52 ELSE 1 END AS factor,
 regexp_extract_all(raw, '(?i)\\$?([\\d,]+\\.?\\d*k?)', 1) AS tokens FROM s),
a AS (SELECT id, raw, list_filter(list_transform(tokens, lambda t: floor(
 TRY_CAST(replace(replace(lower(t), ',', ''), 'k', '') AS DOUBLE) * (CASE WHEN ends_with(lower(t), 'k') THEN 1000 ELSE 1 END) * factor + 0.5)),
 lambda x: x >= 1000 AND x <= 2147483647) AS amounts FROM n)
SELECT id, raw, CAST(amounts[1] AS INT) AS min_salary, CAST(coalesce(amounts[2], amounts[1]) AS INT) AS max_salary FROM a""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders", spread=True).selectExpr("o_orderkey AS id", f"{_SALARY_TEXT} AS raw")
    return rows.select("id", "raw", P.parse_salary_text(F.col("raw")).alias("pay")).select(
        "id", "raw", "pay.min_salary", "pay.max_salary"
    )


@check(
    "F04_salary_precedence",
    views.with_ctes(views.JOBS)
    + "SELECT id, coalesce(min_salary, max_salary, 70000) AS min_salary, coalesce(max_salary, min_salary, 90000) AS max_salary FROM jobs",
)
def _(spark, sf):
    pay = P.pick_salary(F.col("min_salary"), F.col("max_salary"), F.lit("$70k to $90k"))
    return views.jobs(spark, sf).select("id", pay.alias("pay")).select("id", "pay.min_salary", "pay.max_salary")


@check(
    "F05_type_and_remote_precedence",
    f"""WITH s AS (SELECT o_orderkey AS id, {_case('o_orderkey', [t for _, t in _SPELLINGS])} AS known FROM orders)
SELECT id, coalesce(known, CASE WHEN id % 2 = 0 THEN 'freelance' END) AS job_type,
 coalesce(CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN false END, false) AS is_remote FROM s""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        f"{_RAW_TYPE} AS raw",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'freelance' END AS parsed",
        "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag",
        "CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS parsed_flag",
    )
    return rows.select(
        "id",
        P.pick_job_type(F.col("raw"), F.col("parsed")).alias("job_type"),
        P.pick_remote(F.col("flag"), F.col("parsed_flag")).alias("is_remote"),
    )


# Words of each posting with stop words, numbers, repeats and parts of others among them.
_KEYWORDS = (
    "{array}(lower(title), title, company, 'AI', ' Remote ', 'C', '2024', 'Go', 'go', 'Salesforce', "
    "concat('Salesforce ', company), left(title, 4))"
)
_PLAUSIBLE = "list_filter({a}, lambda x: length(trim(lower(x))) >= 2 AND NOT list_contains([{stops}], trim(lower(x))) AND NOT regexp_full_match(trim(lower(x)), '[0-9]+'))"
_FIRST = "list_filter({a}, lambda x, i: list_position(list_transform({a}, lambda y: lower(y)), lower(x)) = i)"
_WHOLE = "list_filter({a}, lambda x: len(list_filter({a}, lambda o: contains(lower(o), lower(x)) AND length(o) > length(x))) = 0)"
_STOPS = ", ".join(f"'{w}'" for w in K.KEYWORD_STOPWORDS)


def _keyword_sql(*steps: str) -> str:
    sql = views.with_ctes(views.JOBS, "k0 AS (SELECT id, " + _KEYWORDS.format(array="list_value") + " AS a FROM jobs)")
    for i, step in enumerate(steps):
        sql = sql.rstrip() + f", k{i + 1} AS (SELECT id, {step.format(a='a', stops=_STOPS)} AS a FROM k{i})\n"
    return sql + f"SELECT id, array_to_string(a, '|') AS kept FROM k{len(steps)}"


def _keyword_rows(spark, sf):
    return views.jobs(spark, sf, spread=True).selectExpr("id", _KEYWORDS.format(array="array") + " AS a")


def _joined(column):
    return F.array_join(column, "|").alias("kept")


@check("F06_filter_keywords", _keyword_sql(_PLAUSIBLE))
def _(spark, sf):
    return _keyword_rows(spark, sf).select("id", _joined(P.filter_keywords(F.col("a"))))


@check("F07_dedupe_insensitive", _keyword_sql(_FIRST))
def _(spark, sf):
    return _keyword_rows(spark, sf).select("id", _joined(P.dedupe_insensitive(F.col("a"))))


@check("F08_dedupe_substrings", _keyword_sql(_WHOLE))
def _(spark, sf):
    return _keyword_rows(spark, sf).select("id", _joined(P.dedupe_substrings(F.col("a"))))


def _counts_sql(step: str) -> str:
    return (
        _keyword_sql(step).rsplit("SELECT id", 1)[0]
        + "SELECT skill, count(*) AS postings FROM (SELECT unnest(a) AS skill FROM k1) GROUP BY 1"
    )


def _skill_counts(rows, kept):
    return rows.select(F.explode(kept).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("postings"))


@check("D05_skills_once_per_posting", _counts_sql(_FIRST))
def _(spark, sf):
    return _skill_counts(_keyword_rows(spark, sf), P.dedupe_insensitive(F.col("a")))


@check("D06_longest_skills_per_posting", _counts_sql(_WHOLE))
def _(spark, sf):
    return _skill_counts(_keyword_rows(spark, sf), P.dedupe_substrings(F.col("a")))


@check(
    "F09_merge_skills",
    views.with_ctes(
        views.JOBS,
        "k0 AS (SELECT id, skills, " + _KEYWORDS.format(array="list_value") + " AS a FROM jobs)",
        f"k1 AS (SELECT id, list_concat(skills, {_PLAUSIBLE.format(a='a', stops=_STOPS)}) AS a FROM k0)",
        f"k2 AS (SELECT id, {_FIRST.format(a='a')} AS a FROM k1)",
    )
    + f"SELECT id, array_to_string({_WHOLE.format(a='a')}, '|') AS kept FROM k2",
)
def _(spark, sf):
    rows = views.jobs(spark, sf, spread=True).selectExpr("id", "skills", _KEYWORDS.format(array="array") + " AS a")
    return rows.select("id", _joined(P.merge_skills(F.col("skills"), F.col("a"))))


@check(
    "F10_content_hash",
    views.with_ctes(views.POSTINGS)
    + "SELECT id, sha256(concat(title, '|', company, '|', description, '|', coalesce(location, ''))) AS content_hash FROM postings",
)
def _(spark, sf):
    hashed = P.content_hash(F.col("title"), F.col("company"), F.col("description"), F.col("location"))
    return views.postings(spark, sf).select("id", hashed.alias("content_hash"))


@check("F11_short_id", "SELECT doc_id, left(sha256(text), 16) AS source_id FROM documents")
def _(spark, sf):
    return views.table(spark, sf, "documents", spread=True).select("doc_id", P.short_id(F.sha2("text", 256)).alias("source_id"))


_WS = K.WHITESPACE_CLASS


def _squeeze_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


_NO_TAGS = "regexp_replace({}, '<[^>]+>', ' ', 'g')"


@check("F12_strip_html", f"SELECT page_id, {_squeeze_sql(_NO_TAGS.format('html'))} AS text FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages", spread=True).select("page_id", T.strip_html(F.col("html")).alias("text"))


def _entities_sql(column: str) -> str:
    text = _NO_TAGS.format(column)
    for entity, char in K.HTML_ENTITIES:
        quoted_entity, quoted = entity.replace("'", "''"), char.replace("'", "''")
        text = f"replace({text}, '{quoted_entity}', '{quoted}')"
    return _squeeze_sql(text)


_ENTITY_TAIL = " &amp;lt;b&amp;gt; &quot;a&#39;b&quot;&nbsp;&ndash; &mdash;"


@check(
    "F13_strip_html_entities",
    "SELECT page_id, " + _entities_sql(f"concat(html, '{_ENTITY_TAIL}')") + " AS text FROM pages",
)
def _(spark, sf):
    html = F.concat("html", F.lit(_ENTITY_TAIL))
    return views.table(spark, sf, "pages", spread=True).select("page_id", T.strip_html_entities(html).alias("text"))


SALARY_HEADER_SQL = (
    "CASE WHEN coalesce(min_salary, 0) = 0 THEN '' ELSE concat(' | Salary: $', format('{:,}', min_salary), "
    "CASE WHEN coalesce(max_salary, 0) = 0 THEN '+' ELSE concat('–$', format('{:,}', max_salary)) END) END"
)


@check(
    "F14_salary_header",
    views.with_ctes(views.JOBS, "s AS (SELECT id, min_salary, CASE WHEN id % 3 > 0 THEN max_salary END AS max_salary FROM jobs)")
    + f"SELECT id, {SALARY_HEADER_SQL} AS header FROM s",
)
def _(spark, sf):
    open_ended = F.when(F.col("id") % 3 > 0, F.col("max_salary"))
    return views.jobs(spark, sf).select("id", P.salary_header(F.col("min_salary"), open_ended).alias("header"))


_DOC_KEYWORDS = ["the", "las", "c#", "of the", "der", "tion", ".net", "mail"]
# The oracle's pattern language has no look-around; consuming the neighbours gives the same yes or no.
_DOC_PATTERNS = [
    r"(^|[^a-z0-9_])the($|[^a-z0-9_])", r"(^|[^a-z0-9_])las($|[^a-z0-9_])", r"(^|[^a-z0-9_])c#($|[^a-z0-9])",
    r"(^|[^a-z0-9_])of the($|[^a-z0-9_])", r"(^|[^a-z0-9_])der($|[^a-z0-9_])", r"(^|[^a-z0-9_])tion($|[^a-z0-9_])",
    r"[a-z0-9_]\.net($|[^a-z0-9_])", r"(^|[^a-z0-9_])mail($|[^a-z0-9_])",
]
_WITH_CODE = "concat(text, CASE doc_id % 5 WHEN 0 THEN ' C# dev' WHEN 1 THEN ' c#x' WHEN 2 THEN ' asp.net' WHEN 3 THEN ' .NET' ELSE '' END)"


@check(
    "F16_match_keyword",
    f"SELECT doc_id, regexp_matches(lower({_WITH_CODE}), {_case('doc_id', _DOC_PATTERNS)}) AS matched FROM documents",
)
def _(spark, sf):
    docs = views.table(spark, sf, "documents", spread=True).selectExpr(
        "doc_id", f"{_WITH_CODE} AS text", f"{_case('doc_id', _DOC_KEYWORDS)} AS keyword"
    )
    return docs.select("doc_id", T.match_keyword(F.col("text"), F.col("keyword")).alias("matched"))


@check(
    "F16_match_keyword_groups",
    "SELECT doc_id, "
    + ", ".join(f"regexp_matches(lower({_WITH_CODE}), '{p}') AS k{i}" for i, p in enumerate(_DOC_PATTERNS))
    + " FROM documents",
)
def _(spark, sf):
    docs = views.table(spark, sf, "documents", spread=True).selectExpr("doc_id", f"lower({_WITH_CODE}) AS text")
    return docs.select("doc_id", *[T.matches_any(F.col("text"), [k]).alias(f"k{i}") for i, k in enumerate(_DOC_KEYWORDS)])


_ASKS = [
    " what is the Salary", " which perks", " any experience or skills needed", " tech stack?", " duties", " resalary", " 401k and pay", "",
]
FIELDS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches({{q}}, '(?i)(^|[^A-Za-z0-9_])({p})') THEN '{f}' END" for f, p in K.FIELD_PREFIXES
) + "], lambda f: f IS NOT NULL)"


@check(
    "F17_detect_fields",
    f"WITH q AS (SELECT conv_id, turn, concat(text, {_case('(conv_id + turn)', _ASKS)}) AS question FROM conversations) "
    f"SELECT conv_id, turn, array_to_string({FIELDS_SQL.format(q='question')}, '|') AS fields FROM q",
)
def _(spark, sf):
    rows = views.table(spark, sf, "conversations", spread=True).selectExpr(
        "conv_id", "turn", f"concat(text, {_case('(conv_id + turn)', _ASKS)}) AS question"
    )
    return rows.select("conv_id", "turn", F.array_join(T.detect_fields(F.col("question")), "|").alias("fields"))


# ---- model answers -------------------------------------------------------------------------------


def answers(spark, sf):
    """Postings as a model might answer about them: fenced, bare, wrapped in prose, cut off, or with wrong types."""
    given = F.to_json(
        F.struct("summary", "salary", "responsibilities", "requirements", "benefits", "skills",
                 F.col("job_type").alias("jobType"), F.col("is_remote").alias("isRemote"))
    )
    wrong = F.to_json(
        F.struct(
            F.lit(5).alias("summary"), F.col("salary"), F.lit("none").alias("responsibilities"),
            F.array(F.lit(1), F.lit(2)).alias("requirements"), F.lit(None).alias("benefits"), F.col("skills"),
            F.lit("gig").alias("jobType"), F.lit("yes").alias("isRemote"),
        )
    )
    n = F.col("id") % 6
    raw = (
        F.when(n == 0, F.concat(F.lit("```json\n"), given, F.lit("\n```")))
        .when(n == 1, given)
        .when(n == 2, F.concat(F.lit("Here you are: "), given, F.lit(" Anything else?")))
        .when(n == 3, F.concat(F.lit("Sorry, "), F.substring("description", 1, 50), F.lit(" {broken")))
        .when(n == 4, wrong)
        .otherwise(F.lit("[1, 2]"))
    )
    return views.postings(spark, sf).withColumn("raw", raw)


@check(
    "F18_extract_job",
    views.with_ctes(
        views.POSTINGS, "s AS (SELECT *, id % 6 < 3 AS full_answer, id % 6 = 4 AS wrong FROM postings)"
    )
    + """SELECT id, CASE WHEN full_answer THEN summary END AS summary, CASE WHEN full_answer OR wrong THEN salary END AS salary,
 CASE WHEN full_answer AND len(responsibilities) > 0 THEN array_to_string(responsibilities, '|') END AS responsibilities,
 CASE WHEN full_answer AND len(requirements) > 0 THEN array_to_string(requirements, '|') END AS requirements,
 CASE WHEN full_answer AND len(benefits) > 0 THEN array_to_string(benefits, '|') END AS benefits,
 CASE WHEN (full_answer OR wrong) AND len(skills) > 0 THEN array_to_string(skills, '|') END AS skills,
 CASE WHEN full_answer THEN job_type END AS job_type, CASE WHEN full_answer THEN is_remote END AS is_remote FROM s""",
)
def _(spark, sf):
    parsed = answers(spark, sf).select("id", R.extract_job(F.col("raw")).alias("p"))
    lists = ("responsibilities", "requirements", "benefits", "skills")
    return parsed.select(
        "id", "p.summary", "p.salary", *[F.array_join(f"p.{c}", "|").alias(c) for c in lists], "p.job_type", "p.is_remote"
    )


def resume_answers(spark, sf):
    """Customers as resume answers: with jobs and schools, some without a name or a usable entry."""
    name = F.col("c_name")
    job = F.struct(
        F.when(F.col("c_custkey") % 3 > 0, name).alias("company"),
        F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("title"),
        F.lit("2020").alias("startDate"),
        F.when(F.col("c_custkey") % 2 > 0, F.lit("2022")).alias("endDate"),
        F.lit("did things").alias("description"),
    )
    school = F.struct(
        F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("School of "), "c_mktsegment")).alias("institution"),
        F.lit("BSc").alias("degree"),
        F.lit(None).cast("string").alias("field"),
        F.col("c_custkey").alias("graduationYear"),
    )
    raw = F.to_json(
        F.struct(
            F.when(F.col("c_custkey") % 7 > 0, name).alias("name"),
            F.lit("a@example.com").alias("email"),
            F.col("c_acctbal").alias("phone"),
            F.lit("Here").alias("location"),
            F.array(F.col("c_mktsegment"), F.lit("Excel")).alias("skills"),
            F.array(job, job).alias("experience"),
            F.array(school).alias("education"),
        )
    )
    broken = F.when(F.col("c_custkey") % 11 == 0, F.lit("no json here")).otherwise(F.concat(F.lit("```\n"), raw, F.lit("```")))
    return views.table(spark, sf, "customer", spread=True).withColumn("raw", broken)


@check(
    "F19_extract_resume",
    """WITH s AS (SELECT *, c_custkey % 11 > 0 AS good, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS company,
 CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END AS title FROM customer)
SELECT c_custkey, CASE WHEN good AND c_custkey % 7 > 0 THEN c_name END AS name, CASE WHEN good THEN 'a@example.com' END AS email,
 CAST(NULL AS VARCHAR) AS phone, CASE WHEN good THEN concat(c_mktsegment, '|Excel') ELSE '' END AS skills,
 CASE WHEN good AND (company <> '' OR title <> '') THEN concat_ws(';', concat(company, '/', title, '/2020/', CASE WHEN c_custkey % 2 > 0 THEN '2022' ELSE '-' END),
  concat(company, '/', title, '/2020/', CASE WHEN c_custkey % 2 > 0 THEN '2022' ELSE '-' END)) ELSE '' END AS experience,
 CASE WHEN good AND c_custkey % 5 > 0 THEN concat('School of ', c_mktsegment, '/BSc') ELSE '' END AS education,
 CAST(0 AS INT) AS years FROM s""",
)
def _(spark, sf):
    parsed = resume_answers(spark, sf).select("c_custkey", R.extract_resume(F.col("raw")).alias("p"))
    jobs = F.transform(
        "p.experience", lambda e: F.concat_ws("/", e["company"], e["title"], e["start_date"], F.coalesce(e["end_date"], F.lit("-")))
    )
    schools = F.transform("p.education", lambda e: F.concat_ws("/", e["institution"], e["degree"]))
    years = F.size(F.filter("p.education", lambda e: e["graduation_year"].isNotNull()))
    return parsed.select(
        "c_custkey", "p.name", "p.email", "p.phone", F.array_join("p.skills", "|").alias("skills"),
        F.array_join(jobs, ";").alias("experience"), F.array_join(schools, ";").alias("education"), years.alias("years"),
    )


_VERDICT_TEXTS = [
    ("relevant", "relevant"), ("Relevant.", "relevant"), (" MARGINAL\n", "marginal"), ("not_relevant", "not_relevant"),
    ("Not relevant", "not_relevant"), ("**not_relevant**", "not_relevant"), ("I think it is marginal, or relevant", "marginal"),
    ("no idea", "not_relevant"), ("", "not_relevant"), (None, "not_relevant"), ("answer: relevant!", "relevant"),
]


@check(
    "F20_normalize_verdict",
    f"SELECT event_id, {_case('event_id', [v for _, v in _VERDICT_TEXTS])} AS verdict FROM events",
)
def _(spark, sf):
    rows = views.table(spark, sf, "events").selectExpr(
        "event_id", f"{_case('event_id', [t for t, _ in _VERDICT_TEXTS])} AS answer"
    )
    return rows.select("event_id", T.normalize_verdict(F.col("answer")).alias("verdict"))


@check(
    "F21_strip_thinking",
    "SELECT doc_id, regexp_replace(concat(CASE WHEN doc_id % 2 = 0 THEN 'x ' ELSE '' END, regexp_replace(text, '^\n+', '')), '^" + _WS + "+|" + _WS + "+$', '', 'g') AS text FROM documents",
)
def _(spark, sf):
    """Two thoughts are put before each text, one of them spanning lines; both must go."""
    thought = F.concat(
        F.lit("<think>hm\n"), F.substring("text", 1, 20), F.lit("</think>\n\n"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("x ")).otherwise(F.lit("")), F.lit("<think></think>"),
    )
    docs = views.table(spark, sf, "documents", spread=True).filter(F.col("text").isNotNull())
    safe = F.regexp_replace("text", "^\n+", "")
    return docs.select("doc_id", T.strip_thinking(F.concat(thought, safe)).alias("text"))


@check(
    "F22_round_half_up",
    "SELECT event_id, floor(value / 7 * 100.0 + 0.5) / 100.0 AS two, floor(value / 7 * 1000.0 + 0.5) / 1000.0 AS three FROM events",
)
def _(spark, sf):
    x = F.col("value") / 7
    return views.table(spark, sf, "events").select(
        "event_id", T.round_half_up(x, 2).alias("two"), T.round_half_up(x, 3).alias("three")
    )


@check(
    "F23_label_warning",
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n < 5 THEN concat('Only ', n, ' jobs matched (expected >= 5)')
 WHEN n = 9 THEN 'Capped at 9 candidates — consider tuning max_relevant' END AS warning FROM n""",
)
def _(spark, sf):
    counts = views.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", T.label_warning(F.col("n"), F.lit(5), F.lit(9)).alias("warning"))


@check(
    "F24_allowed_values",
    f"SELECT o_orderkey AS id, CASE WHEN raw IN ('full_time', 'part_time', 'contract', 'internship', 'freelance') THEN raw END AS job_type "
    f"FROM (SELECT o_orderkey, {_RAW_TYPE} AS raw FROM orders)",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_RAW_TYPE} AS raw")
    return rows.select("id", T.one_of(F.col("raw"), K.JOB_TYPES).alias("job_type"))


_ROUTE_ANSWERS = [
    ('{"type":"retrieval","intent":null,"params":[]}', "retrieval", None, None, None, None),
    ('{"type":"aggregation","intent":"count_by_location","params":[]}', "aggregation", "count_by_location", None, None, None),
    ('{"type":"hybrid","intent":"list_jobs_by_title","params":["%dev%", 5]}', "hybrid", "list_jobs_by_title", "%dev%", None, None),
    ("not json", "retrieval", None, None, None, None),
    ('{"type":"chat","intent":"count_total"}', "retrieval", None, None, None, None),
    ('{"type":"aggregation","intent":"drop_table"}', "aggregation", None, None, None, None),
    ('{"type":"hybrid","intent":"filter_jobs","filters":{"title":"%devops%","minSalary":150000}}', "hybrid", "filter_jobs", None, "%devops%", 150000.0),
    ('{"type":"hybrid","intent":"filter_jobs","filters":{"title":7,"minSalary":"90000"}}', "hybrid", "filter_jobs", None, None, 90000.0),
]


def _route_column(i: int) -> str:
    values = [row[i] for row in _ROUTE_ANSWERS]
    if i == 5:
        whens = " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values) if v is not None)
        return f"CAST(CASE o_orderkey % {len(values)} {whens} END AS DOUBLE)"
    return _case("o_orderkey", values)


@check(
    "F25_extract_route",
    f"SELECT o_orderkey AS id, {_route_column(1)} AS type, {_route_column(2)} AS intent, {_route_column(3)} AS params, "
    f"{_route_column(4)} AS title, {_route_column(5)} AS min_salary FROM orders",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders", spread=True).selectExpr("o_orderkey AS id", f"{_route_column(0)} AS raw")
    parsed = rows.select("id", R.extract_route(F.col("raw"), list(TEMPLATES)).alias("r"))
    return parsed.select(
        "id", "r.type", "r.intent", F.array_join("r.params", "|").alias("params"), "r.filters.title", "r.filters.min_salary"
    )
