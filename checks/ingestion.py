"""Sources, deduplication, upserts, edits and whole ingestion runs.

The landed pages are made from the pages table (its HTML as description) and the posting of the same number. Queries that
write do so in a folder of their own under the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views
from checks.fields import _entities_sql, _NO_TAGS, _squeeze_sql
from checks.registry import check
from checks.search import DIM, hex_embedder
from checks.views import with_ctes
from tallywork import schemas
from tallywork.operators.joins import cascade_delete, existing_only, hot_key_join
from tallywork.operators.ranking import first_seen, latest_wins, top_n
from tallywork.plans import ingest as I
from tallywork.plans import users as U
from tallywork.session import shared_folder
from tallywork.sinks import tables as S
from tallywork.sources import landing as L
from tallywork.sources import tables as T
from tallywork.streaming.ingest import distinct_within, start_ingestion

PAGE_ROWS = 50


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/check-{uuid.uuid4().hex}"


# ---- landed pages --------------------------------------------------------------------------------

_TYPES = "CASE id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'Full-Time' WHEN 2 THEN 'gig' END"
_PAY = "CASE id % 3 WHEN 1 THEN '$60k - $80k' WHEN 2 THEN concat('USD ', CAST(50 + id % 40 AS STRING), ',500 yearly') END"
_LANDED = (
    "landed AS (SELECT j.id, j.title, j.company, j.location, j.url, p.html, "
    + f"{_TYPES} AS kind, {_PAY} AS pay FROM jobs j JOIN pages p ON p.page_id = j.id)"
)


def landed(spark, sf):
    pages = views.table(spark, sf, "pages", spread=True).selectExpr("page_id AS id", "html")
    j = views.jobs(spark, sf, spread=True, among=pages.select("id"))
    rows = j.join(pages, "id")
    return rows.select("id", "title", "company", "location", j["url"], "html").withColumns(
        {"kind": F.expr(_TYPES), "pay": F.expr(_PAY)}
    )


def _pages(rows, field, item):
    """Rows as pages of fifty, in id order."""
    numbered = rows.select(F.floor(F.col("id") / PAGE_ROWS).alias("page"), "id", item.alias("item"))
    by_id = lambda a, b: F.signum((a["id"] - b["id"]).cast("double")).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("id", "item")), by_id)
    return numbered.groupBy("page").agg(F.transform(ordered, lambda x: x["item"]).alias(field))


def remotive_pages(rows):
    item = F.struct(
        "id", "url", "title", F.col("company").alias("company_name"), F.col("kind").alias("job_type"),
        F.col("location").alias("candidate_required_location"), F.col("pay").alias("salary"), F.col("html").alias("description"),
    )
    return _pages(rows, "jobs", item)


def _jobicy_item(kind):
    monthly = F.col("id") % 5 == 0
    return F.struct(
        "id", "url", F.col("title").alias("jobTitle"), F.col("company").alias("companyName"), kind.alias("jobType"),
        F.col("location").alias("jobGeo"), F.col("html").alias("jobDescription"),
        F.when(F.col("id") % 3 > 0, F.lit(5000.0) + F.col("id")).alias("salaryMin"), F.lit(None).cast("double").alias("salaryMax"),
        F.when(monthly, F.lit("Monthly")).alias("salaryPeriod"), F.lit("USD").alias("salaryCurrency"),
    )


def jobicy_pages(rows):
    """Job type as text, as an array, or missing."""
    kind = F.when(F.col("id") % 2 == 0, F.parse_json(F.to_json(F.array(F.lit("part-time"), F.lit("contract"))))).otherwise(
        F.parse_json(F.concat(F.lit('"'), F.coalesce("kind", F.lit("intern")), F.lit('"')))
    )
    return _pages(rows, "jobs", _jobicy_item(kind))


def findwork_pages(rows):
    item = F.struct(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 7 > 0, F.col("title")).alias("role"),
        F.col("company").alias("company_name"), F.lit(None).cast("int").alias("company_num_employees"),
        F.col("kind").alias("employment_type"), "location", (F.col("id") % 2 == 0).alias("remote"),
        F.when(F.col("id") % 5 > 0, F.lit("http://logo.example")).otherwise(F.lit("")).alias("logo"), "url",
        F.concat("html", F.lit(" R&amp;D")).alias("text"), F.lit("2024-01-01").alias("date_posted"),
        F.array(F.lit("Python"), F.lit("AI"), F.col("company")).alias("keywords"), F.lit("x").alias("source"),
    )
    return _pages(rows, "results", item)


_REMOTIVE_SQL = f"""remotive AS (SELECT CAST(id AS VARCHAR) AS source_id, 'remotive' AS source, title, company, location,
 {_squeeze_sql(_NO_TAGS.format('html'))} AS description, url, CASE WHEN id % 4 = 1 THEN 'full_time' END AS job_type,
 CASE WHEN id % 4 = 0 OR contains(lower(location), 'remote') THEN true END AS is_remote,
 CAST(CASE id % 3 WHEN 1 THEN 60000 ELSE (50 + id % 40) * 1000 + 500 END AS INT) AS min_salary,
 CAST(CASE id % 3 WHEN 1 THEN 80000 ELSE (50 + id % 40) * 1000 + 500 END AS INT) AS max_salary,
 CAST(NULL AS VARCHAR) AS logo, CAST(NULL AS VARCHAR) AS keywords, id FROM landed WHERE id % 3 > 0)"""
_JOBICY_SQL = f"""jobicy AS (SELECT CAST(id AS VARCHAR) AS source_id, 'jobicy' AS source, title, company, location,
 {_squeeze_sql(_NO_TAGS.format('html'))} AS description, url,
 CASE WHEN id % 2 = 0 THEN 'part_time' WHEN id % 4 = 1 THEN 'full_time' WHEN id % 4 = 3 THEN 'internship' END AS job_type,
 CAST(NULL AS BOOLEAN) AS is_remote,
 CAST((5000 + id) * CASE WHEN id % 5 = 0 THEN 12 ELSE 1 END AS INT) AS min_salary,
 CAST((5000 + id) * CASE WHEN id % 5 = 0 THEN 12 ELSE 1 END AS INT) AS max_salary,
 CAST(NULL AS VARCHAR) AS logo, CAST(NULL AS VARCHAR) AS keywords, id FROM landed WHERE id % 3 > 0)"""
_FINDWORK_SQL = f"""findwork AS (SELECT CAST(id AS VARCHAR) AS source_id, 'findwork' AS source, title, company, location,
 {_entities_sql("concat(html, ' R&amp;D')")} AS description, url, CASE WHEN id % 4 = 1 THEN 'full_time' END AS job_type,
 id % 2 = 0 AS is_remote, CAST(NULL AS INT) AS min_salary, CAST(NULL AS INT) AS max_salary,
 CASE WHEN id % 5 > 0 THEN 'http://logo.example' END AS logo, concat_ws('|', 'Python', 'AI', company) AS keywords, id FROM landed WHERE id % 7 > 0)"""
_RAW = "source_id, source, title, company, location, description, url, job_type, is_remote, min_salary, max_salary, logo, keywords"


def _flat(raw):
    return raw.select(*[F.array_join(c, "|").alias(c) if c == "keywords" else c for c in schemas.RAW_JOB_COLUMNS])


@check("S06_remotive", with_ctes(views.JOBS, _LANDED, _REMOTIVE_SQL) + f"SELECT {_RAW} FROM remotive")
def _(spark, sf):
    return _flat(L.remotive(remotive_pages(landed(spark, sf))))


@check("S07_jobicy", with_ctes(views.JOBS, _LANDED, _JOBICY_SQL) + f"SELECT {_RAW} FROM jobicy")
def _(spark, sf):
    return _flat(L.jobicy(jobicy_pages(landed(spark, sf))))


@check("S08_findwork", with_ctes(views.JOBS, _LANDED, _FINDWORK_SQL) + f"SELECT {_RAW} FROM findwork")
def _(spark, sf):
    return _flat(L.findwork(findwork_pages(landed(spark, sf))))


_ALL_SOURCES = (views.JOBS, _LANDED, _REMOTIVE_SQL, _JOBICY_SQL, _FINDWORK_SQL)


@check(
    "S09_union_of_sources_with_cap",
    with_ctes(*_ALL_SOURCES)
    + f"SELECT {_RAW} FROM remotive UNION ALL SELECT {_RAW} FROM jobicy UNION ALL SELECT * FROM (SELECT {_RAW} FROM findwork ORDER BY id LIMIT 100)",
)
def _(spark, sf):
    rows = landed(spark, sf)
    capped = top_n(L.findwork(findwork_pages(rows)), 100, F.asc("page"), F.asc("pos"))
    return _flat(L.union_sources([L.remotive(remotive_pages(rows)), L.jobicy(jobicy_pages(rows)), capped]))


@check(
    "S09_union_of_sources",
    with_ctes(*_ALL_SOURCES) + f"SELECT {_RAW} FROM remotive UNION ALL SELECT {_RAW} FROM jobicy UNION ALL SELECT {_RAW} FROM findwork",
)
def _(spark, sf):
    """Everything that was landed, without a paging stop."""
    rows = landed(spark, sf)
    return _flat(L.union_sources([L.remotive(remotive_pages(rows)), L.jobicy(jobicy_pages(rows)), L.findwork(findwork_pages(rows))]))


@check(
    "P13_source_row_filters",
    with_ctes(*_ALL_SOURCES)
    + "SELECT source, count(*) AS kept FROM (SELECT source FROM remotive UNION ALL SELECT source FROM jobicy UNION ALL SELECT source FROM findwork) GROUP BY 1",
)
def _(spark, sf):
    rows = landed(spark, sf)
    every = L.union_sources([L.remotive(remotive_pages(rows)), L.jobicy(jobicy_pages(rows)), L.findwork(findwork_pages(rows))])
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


def _land(pages, folder):
    """One JSON file per page, as an API answer is landed."""
    pages.repartition("page").write.partitionBy("page").mode("append").json(folder)


@check(
    "D01_failed_source_is_skipped",
    with_ctes(*_ALL_SOURCES) + f"SELECT {_RAW} FROM remotive UNION ALL SELECT {_RAW} FROM jobicy",
)
def _(spark, sf):
    """Two sources landed as files, the third has no folder."""
    root, rows = scratch(spark), landed(spark, sf)
    _land(remotive_pages(rows), f"{root}/remotive")
    _land(jobicy_pages(rows), f"{root}/jobicy")
    raw, failed = L.read_landing(spark, {name: f"{root}/{name}" for name in L.SOURCES})
    if failed != ["findwork"]:
        raise AssertionError(failed)
    return _flat(raw)


def _fourth_board(pages):
    """A board of the caller's own, with pages as Findwork has them."""
    return L.findwork(pages).withColumn("source", F.lit("fourth"))


@check(
    "U01_fourth_source",
    with_ctes(*_ALL_SOURCES) + f"SELECT {_RAW} FROM (SELECT * REPLACE ('fourth' AS source) FROM findwork)",
)
def _(spark, sf):
    root = scratch(spark)
    _land(findwork_pages(landed(spark, sf)), f"{root}/fourth")
    raw, failed = L.read_landing(spark, {"fourth": f"{root}/fourth"}, sources={"fourth": (schemas.FINDWORK_PAGE, _fourth_board)})
    return _flat(raw)


# ---- first, last ---------------------------------------------------------------------------------


@check(
    "W04_first_seen",
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
)
def _(spark, sf):
    return first_seen(views.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id"
    )


@check(
    "W06_latest_wins",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def _(spark, sf):
    return latest_wins(views.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


@check(
    "K01_upsert",
    """WITH s AS (SELECT * FROM events WHERE event_id % 2 = 0), i AS (SELECT * FROM events WHERE event_id % 2 = 1),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM s) WHERE n = 1),
i1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM i) WHERE n = 1)
SELECT user_id, event_type, coalesce(i1.event_id, s1.event_id) AS event_id, coalesce(i1.value, s1.value) AS value FROM s1 FULL JOIN i1 USING (user_id, event_type)""",
)
def _(spark, sf):
    """Every second event is stored, the others come in."""
    events, keys, sequence = views.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]
    stored = latest_wins(events.filter("event_id % 2 = 0"), keys, sequence)
    return S.upsert(stored, events.filter("event_id % 2 = 1"), keys, sequence).select(*keys, "event_id", "value")


@check(
    "K01_versioned_upsert",
    """WITH v AS (SELECT user_id, event_type, event_id % 3 AS version, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2, 3),
last AS (SELECT user_id, event_type, arg_max(event_id, version) AS event_id, max(version) AS version FROM v GROUP BY 1, 2)
SELECT user_id, event_type, event_id FROM last WHERE NOT (version < 2 AND user_id % 5 = 0)""",
)
def _(spark, sf):
    """Three commits of events by event_id % 3; the last also deletes the keys of every fifth user it does not write."""
    from tallywork.sinks.versioned import VersionedTable

    schema = "user_id BIGINT, event_type STRING, event_id BIGINT"
    table = VersionedTable(spark, f"{scratch(spark)}/events", schema, ("user_id", "event_type"))
    events = views.table(spark, sf, "events")
    for version in (0, 1, 2):
        rows = latest_wins(events.filter(F.col("event_id") % 3 == version), ["user_id", "event_type"], ["ts"])
        gone = None
        if version == 2:
            fifth = table.read().filter("user_id % 5 = 0")
            gone = fifth.join(rows.select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")
        table.commit(rows, deleted=gone)
        if version == 0:
            table.fold()
    return table.read()


# ---- what is new ---------------------------------------------------------------------------------

# Documents as postings: every second is stored, every fourth of those also embedded.
_STATUS = """inc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_id, sha256(concat('t|c|', text, '|')) AS h FROM documents),
st AS (SELECT h, min(doc_id) AS existing FROM inc WHERE doc_id % 2 = 0 GROUP BY 1),
cls AS (SELECT i.doc_id, i.source_id, i.h, s.existing, CASE WHEN s.existing IS NULL THEN 'new' WHEN s.existing % 8 = 0 THEN 'skipped' ELSE 're-embed' END AS status
 FROM inc i LEFT JOIN st s USING (h))"""


def incoming(spark, sf):
    docs = views.table(spark, sf, "documents", spread=True)
    raw = docs.select(
        F.col("doc_id").cast("string").alias("source_id"), F.lit("doc").alias("source"), F.lit("t").alias("title"),
        F.lit("c").alias("company"), F.lit(None).cast("string").alias("location"), F.col("text").alias("description"),
        F.lit("u").alias("url"), F.lit(None).cast("string").alias("job_type"), F.lit(None).cast("boolean").alias("is_remote"),
        F.lit(None).cast("int").alias("min_salary"), F.lit(None).cast("int").alias("max_salary"),
        F.lit(None).cast("string").alias("logo"), F.lit(None).cast("array<string>").alias("keywords"),
        F.lit(0).cast("bigint").alias("page"), F.col("doc_id").alias("pos"), "doc_id",
    )
    return I.with_content_hash(raw)


def classified(spark, sf):
    rows = incoming(spark, sf)
    stored = rows.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "content_hash")
    chunks = stored.filter("id % 8 = 0").select(F.col("id").alias("job_id"))
    return I.classify(rows, stored, chunks)


@check(
    "J01_classify_incoming",
    with_ctes(_STATUS) + "SELECT doc_id, existing AS existing_id, status FROM cls",
)
def _(spark, sf):
    return classified(spark, sf).select("doc_id", "existing_id", "status")


@check(
    "S03_lookup_by_hash",
    with_ctes(_STATUS) + "SELECT i.doc_id, s.existing AS existing_id FROM inc i JOIN st s USING (h)",
)
def _(spark, sf):
    rows = incoming(spark, sf)
    stored = rows.filter("doc_id % 2 = 0").groupBy("content_hash").agg(F.min("doc_id").alias("existing_id"))
    return hot_key_join(rows.select("doc_id", "content_hash"), stored, "content_hash", "inner", ["doc_id"]).select("doc_id", "existing_id")


@check(
    "D02_new_contents",
    with_ctes(_STATUS) + "SELECT min(doc_id) AS doc_id, h AS content_hash FROM cls WHERE status = 'new' GROUP BY h",
)
def _(spark, sf):
    return I.new_contents(classified(spark, sf)).select("doc_id", "content_hash")


# Every third document repeats the key of the one before it with a text of its own, as an edited posting does.
_EDITED = """e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN doc_id - 1 ELSE doc_id END AS k, h FROM cls WHERE status = 'new'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id DESC) AS n FROM e) WHERE n = 1)"""


@check(
    "D02_last_per_key_before_first_per_content",
    with_ctes(_STATUS, _EDITED) + "SELECT min(doc_id) AS doc_id, h AS content_hash FROM last GROUP BY h",
)
def _(spark, sf):
    key = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")
    return I.new_contents(classified(spark, sf).withColumn("source_id", key)).select("doc_id", "content_hash")


@check(
    "D04_stored_but_not_embedded",
    with_ctes(_STATUS) + "SELECT DISTINCT existing AS id FROM cls WHERE status = 're-embed'",
)
def _(spark, sf):
    again = classified(spark, sf).filter(F.col("status") == I.RE_EMBED)
    return again.select(F.col("existing_id").alias("id")).distinct()


@check(
    "A22_run_counts",
    with_ctes(_STATUS)
    + "SELECT count(*) AS fetched, count(DISTINCT h) FILTER (WHERE status = 'new') AS stored, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM cls",
)
def _(spark, sf):
    rows = classified(spark, sf)
    return I.run_counts(rows, I.new_contents(rows))


@check("J09_has_embedding", with_ctes(views.JOBS, views.CHUNKS) + "SELECT id, title FROM jobs WHERE id IN (SELECT job_id FROM chunks)")
def _(spark, sf):
    return I.has_embedding(views.jobs(spark, sf), views.chunks(spark, sf)).select("id", "title")


# ---- chunks, edits -------------------------------------------------------------------------------


@check(
    "K02_replace_chunks",
    with_ctes(views.CHUNKS)
    + "SELECT chunk_id, job_id, chunk_text FROM chunks WHERE job_id % 3 > 0 UNION ALL SELECT chunk_id, job_id, 'new ' || chunk_text FROM chunks WHERE job_id % 3 = 0 AND chunk_id % 2 = 0",
)
def _(spark, sf):
    """A third of the postings gets half as many, new chunks."""
    stored = views.chunks(spark, sf).select("chunk_id", "job_id", "chunk_text")
    new = stored.filter("job_id % 3 = 0 AND chunk_id % 2 = 0").withColumn("chunk_text", F.concat(F.lit("new "), "chunk_text"))
    return S.replace_chunks(stored, new)


def stored_jobs(spark, sf):
    """The posting view in the stored form."""
    typed = dict(part.split(" ", 1) for part in schemas.JOB.split(", "))
    jobs = views.jobs(spark, sf).withColumns({"id": F.col("id").cast("string"), "description": F.concat("title", F.lit(" job"))})
    return jobs.select(*[(F.col(c) if c in jobs.columns else F.lit(None)).cast(typed[c]).alias(c) for c in schemas.JOB_COLUMNS])


_CHANGE_COLUMNS = (
    "CASE WHEN o_orderkey % 10 = 1 THEN 'insert' WHEN o_orderkey % 10 IN (2, 3) THEN 'patch' WHEN o_orderkey % 10 = 4 THEN 'delete' END AS op",
    "CAST(CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) AS id",
    "o_orderkey AS seq",
    "CASE WHEN o_orderkey % 10 = 1 THEN concat('Hand made ', CAST(o_orderkey % 1000 AS STRING)) WHEN o_orderkey % 10 = 3 THEN 'Patched' END AS title",
    "CASE WHEN o_orderkey % 10 = 1 THEN 'Me' END AS company",
    "CASE WHEN o_orderkey % 10 = 2 THEN 'Moved' END AS location",
    "CASE WHEN o_orderkey % 10 = 1 THEN 'by hand' END AS description",
    "CASE WHEN o_orderkey % 10 = 1 THEN 'http://m.example' END AS url",
    "CAST(NULL AS STRING) AS job_type",
    "CASE WHEN o_orderkey % 10 IN (2, 3) THEN CAST(o_orderkey % 10 * 1000 AS INT) END AS min_salary",
    "CAST(NULL AS INT) AS max_salary",
)


@check(
    "K04_apply_changes",
    with_ctes(
        views.JOBS,
        "ch AS (SELECT " + ", ".join(_CHANGE_COLUMNS) + " FROM orders WHERE o_orderkey % 10 IN (1, 2, 3, 4))",
        "hand AS (SELECT DISTINCT title, company, description, url, left(sha256(concat(title, '|', company, '|', description, '|')), 16) AS source_id FROM ch WHERE op = 'insert')",
    )
    + """SELECT source, source_id, CASE WHEN id % 10 = 2 AND id + 1 <= (SELECT max(o_orderkey) FROM orders) THEN 'Patched' ELSE title END AS title, CASE WHEN id % 10 = 2 THEN 'Moved' ELSE location END AS location,
 CASE WHEN id % 10 = 2 THEN CASE WHEN id + 1 <= (SELECT max(o_orderkey) FROM orders) THEN 3000 ELSE 2000 END ELSE min_salary END AS min_salary, max_salary FROM jobs WHERE id % 10 <> 4
UNION ALL SELECT 'manual', source_id, title, CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST(NULL AS INT) FROM hand""",
)
def _(spark, sf):
    """Two patches per patched posting, of which the later title and salary count; inserts repeat contents."""
    changes = views.table(spark, sf, "orders").filter("o_orderkey % 10 IN (1, 2, 3, 4)").selectExpr(*_CHANGE_COLUMNS)
    jobs, now = stored_jobs(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    written, deleted = S.apply_changes(jobs, changes, now)
    after = jobs.join(deleted, "id", "left_anti").join(written.select("id"), "id", "left_anti").unionByName(written)
    return after.select("source", "source_id", "title", "location", "min_salary", "max_salary")


@check(
    "K03_csv_export_and_import",
    with_ctes(views.POSTINGS)
    + """SELECT source_id, source, title, company, location, replace(description, chr(13), '') AS description, url, job_type, min_salary, max_salary FROM postings""",
)
def _(spark, sf):
    """Whole documents, with quotes, commas and line breaks, written as CSV and read back as raw postings."""
    typed = dict(part.split(" ", 1) for part in schemas.JOB.split(", "))
    rows = views.postings(spark, sf).withColumn("id", F.col("id").cast("string"))
    jobs = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(typed[c]).alias(c) for c in schemas.JOB_COLUMNS])
    folder = scratch(spark)
    S.export_csv(jobs, folder)
    return T.csv_to_raw(T.read_csv_rows(spark, folder)).drop("is_remote", "logo", "keywords")


def _header_first(batches):
    """The header line before the first row of each file."""
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array(["id,text,lang"])], names=["value"])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])


@check(
    "S04_csv_rows",
    "SELECT CAST(doc_id AS VARCHAR) AS id, replace(text, chr(13), '') AS text, lang FROM documents WHERE doc_id % 10 > 0",
)
def _(spark, sf):
    """Hand-made lines with doubled quotes and line breaks; every tenth has a field too many and is dropped."""
    folder = scratch(spark)
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), quoted, F.col("lang"), F.when(F.col("doc_id") % 10 == 0, F.lit("extra")))
    lines = views.table(spark, sf, "documents", spread=True).select(line.alias("value"))
    lines.mapInArrow(_header_first, "value string").write.text(folder)
    rows = T.read_csv_rows(spark, folder).select("id", "text", "lang")
    return rows.withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))


@check(
    "S05_csv_to_raw",
    "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS location, "
    "CASE WHEN o_orderkey % 4 > 0 THEN 'contract' END AS job_type, CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(o_totalprice) AS INT) END AS min_salary, "
    "CAST(NULL AS INT) AS max_salary FROM orders",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS sourceId", "'csv' AS source", "'t' AS title", "'c' AS company",
        "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS location", "'d' AS description", "'u' AS url",
        "CASE WHEN o_orderkey % 4 > 0 THEN 'contract' END AS jobType",
        "CASE WHEN o_orderkey % 5 > 0 THEN concat(CAST(CAST(floor(o_totalprice) AS INT) AS STRING), '.0 USD') ELSE '' END AS minSalary",
        "'n/a' AS maxSalary",
    )
    return T.csv_to_raw(rows).select("source_id", "location", "job_type", "min_salary", "max_salary")


# ---- bookmarks, profiles, judgments --------------------------------------------------------------

_FAV = "fav AS (SELECT user_id, event_id AS job_id, ts AS saved_at FROM events WHERE event_type = 'purchase')"


def favorites(spark, sf):
    return views.table(spark, sf, "events").filter("event_type = 'purchase'").selectExpr(
        "user_id", "event_id AS job_id", "ts AS saved_at"
    )


@check(
    "J04_favorite_jobs",
    with_ctes(views.JOBS, _FAV) + "SELECT user_id, job_id, title, saved_at FROM fav JOIN jobs ON id = job_id",
)
def _(spark, sf):
    return U.favorite_jobs(favorites(spark, sf), views.jobs(spark, sf)).select("user_id", "job_id", "title", "saved_at")


@check(
    "J05_resume_flag",
    "SELECT c_custkey AS id, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup') AS has_resume FROM customer",
)
def _(spark, sf):
    users = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return U.with_resume_flag(users, views.table(spark, sf, "events").filter("event_type = 'signup'"))


@check(
    "J06_existing_jobs_only",
    with_ctes(views.JOBS, _FAV) + "SELECT user_id, job_id FROM fav WHERE job_id IN (SELECT id FROM jobs WHERE job_type IS NOT NULL)",
)
def _(spark, sf):
    jobs = views.jobs(spark, sf).filter("job_type IS NOT NULL").select(F.col("id").alias("job_id"))
    return existing_only(favorites(spark, sf).select("user_id", "job_id"), jobs, "job_id", ["user_id"])


@check(
    "J07_cascade_delete",
    with_ctes(views.JOBS, _FAV) + "SELECT user_id, job_id FROM fav WHERE job_id NOT IN (SELECT id FROM jobs WHERE job_type IS NULL)",
)
def _(spark, sf):
    deleted = views.jobs(spark, sf).filter("job_type IS NULL").select(F.col("id").alias("job_id"))
    return cascade_delete(favorites(spark, sf).select("user_id", "job_id"), deleted, "job_id", ["user_id"])


@check(
    "J08_saved_flag",
    with_ctes(views.JOBS, _FAV) + "SELECT id, id IN (SELECT job_id FROM fav WHERE user_id = 42) AS is_saved FROM jobs",
)
def _(spark, sf):
    return U.with_saved_flag(views.jobs(spark, sf).select("id"), favorites(spark, sf), 42)


_BOOKMARK = (
    "SELECT user_id, event_id % 50 AS job_id, CASE WHEN event_type = 'error' THEN 'unsave' ELSE 'save' END AS action, ts, event_id AS seq FROM {events} "
    "WHERE event_type IN ('purchase', 'error', 'view')"
)


@check(
    "K05_bookmark_events",
    f"""WITH e AS ({_BOOKMARK.format(events='events')}), u AS (SELECT user_id, job_id, max(seq) AS last_unsave FROM e WHERE action = 'unsave' GROUP BY 1, 2),
k AS (SELECT e.user_id, e.job_id, min(ts) AS saved_at FROM e LEFT JOIN u USING (user_id, job_id) WHERE action = 'save' AND (last_unsave IS NULL OR seq > last_unsave) GROUP BY 1, 2),
olds AS (SELECT user_id, event_id % 50 AS job_id, min(ts) AS saved_at FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, job_id, CASE WHEN u.last_unsave IS NULL THEN coalesce(o.saved_at, k.saved_at) ELSE k.saved_at END AS saved_at
FROM (SELECT user_id, job_id FROM olds UNION SELECT user_id, job_id FROM k) a LEFT JOIN olds o USING (user_id, job_id) LEFT JOIN k USING (user_id, job_id) LEFT JOIN u USING (user_id, job_id)
WHERE k.saved_at IS NOT NULL OR u.last_unsave IS NULL""",
)
def _(spark, sf):
    """Clicks are the stored bookmarks; purchases and views save, errors unsave."""
    events = spark.sql(_BOOKMARK.format(events="{e}"), e=views.table(spark, sf, "events"))
    clicks = views.table(spark, sf, "events").filter("event_type = 'click'")
    saved = clicks.groupBy("user_id", (F.col("event_id") % 50).alias("job_id")).agg(F.min("ts").alias("saved_at"))
    written, gone = S.bookmark_state(saved, events)
    keys = ["user_id", "job_id"]
    return saved.join(gone, keys, "left_anti").join(written.select(*keys), keys, "left_anti").unionByName(written)


@check(
    "K06_upsert_resumes",
    "SELECT CAST(user_id AS VARCHAR) AS user_id, arg_max(event_id, event_id) AS last_event FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1",
)
def _(spark, sf):
    """Two commits, sign-ups with even and then all ids; the last resume per user stays."""
    store = S.Store(spark, scratch(spark))
    rows = views.table(spark, sf, "events").filter("event_type IN ('signup', 'view')")
    names = [part.split()[0] for part in ("id", "user_id", "file_path", "raw_text", "embedding_model", "embedding", "created_at", "updated_at")]
    resume = rows.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.lit("f").alias("file_path"),
        F.col("event_id").cast("string").alias("raw_text"), F.lit(None).cast(schemas.PARSED_RESUME).alias("parsed_data"),
        F.lit("m").alias("embedding_model"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id",
    )
    S.upsert_resumes(store, resume.filter("event_id % 2 = 0"), ["event_id"])
    S.upsert_resumes(store, resume, ["event_id"])
    if not set(names) <= set(store.resumes.columns):
        raise AssertionError(names)
    return store.resumes.read().select("user_id", F.col("raw_text").cast("bigint").alias("last_event"))


@check(
    "K07_judgments",
    "SELECT 'local' AS judge, 'q' || (user_id % 15) AS query_id, 'j' || (event_id % 97) AS job_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 2, 3",
)
def _(spark, sf):
    """Three appended commits, read with the last verdict per key."""
    store = S.Store(spark, scratch(spark))
    rows = views.table(spark, sf, "events").selectExpr(
        "'local' AS judge", "concat('q', CAST(user_id % 15 AS STRING)) AS query_id", "concat('j', CAST(event_id % 97 AS STRING)) AS job_id",
        "event_type AS verdict", "event_id",
    )
    S.record_judgments(store, rows, ["event_id"])
    S.clear_judgments(store)
    last = rows.agg(F.max("event_id")).first()[0]
    S.record_judgments(store, rows.filter(F.col("event_id") < last / 2), ["event_id"])
    S.record_judgments(store, rows.filter(F.col("event_id") >= last / 2), ["event_id"])
    return store.judgments.read()


@check(
    "S10_judgment_keys",
    "SELECT 'local' AS judge, 'q' || (user_id % 15) AS query_id, 'j:' || (event_id % 97) AS job_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 2, 3",
)
def _(spark, sf):
    pairs = views.table(spark, sf, "events").selectExpr(
        "concat('local:q', CAST(user_id % 15 AS STRING), ':j:', CAST(event_id % 97 AS STRING)) AS key", "event_type AS verdict", "event_id AS seq"
    )
    return T.split_judgment_keys(pairs)


@check(
    "S10_judgment_log",
    "SELECT 'local' AS judge, 'q' || (user_id % 15) AS query_id, 'j:' || (event_id % 97) AS job_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 2, 3",
)
def _(spark, sf):
    """The events as one log file, landed and read back in splits."""
    pairs = views.table(spark, sf, "events").selectExpr(
        "to_json(array(concat('local:q', CAST(user_id % 15 AS STRING), ':j:', CAST(event_id % 97 AS STRING)), event_type)) AS pair", "event_id"
    )
    ends = pairs.agg(F.min("event_id").alias("first"), F.max("event_id").alias("last")).first()
    lines = pairs.coalesce(1).sortWithinPartitions("event_id").select(
        F.concat(F.when(F.col("event_id") == ends["first"], "[").otherwise(","), "pair", F.when(F.col("event_id") == ends["last"], "]").otherwise(""))
    )
    path = f"{scratch(spark)}/log"
    lines.write.text(path)
    return T.read_judgment_log(spark, path)


# ---- whole runs ----------------------------------------------------------------------------------

_RUN_JOBS = (
    *_ALL_SOURCES,
    # First run: even postings from one board, odd ones from another. Second run: the third board brings everything.
    "raw1 AS (SELECT * FROM remotive WHERE id % 2 = 0 UNION ALL SELECT * FROM findwork WHERE id % 2 = 1)",
    "h AS (SELECT *, sha256(concat(title, '|', company, '|', description, '|', coalesce(location, ''))) AS hash FROM raw1)",
    "h2 AS (SELECT *, sha256(concat(title, '|', company, '|', description, '|', coalesce(location, ''))) AS hash FROM jobicy)",
    "r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source, id) AS n FROM h) WHERE n = 1)",
    "r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source, id) AS n FROM h2 WHERE hash NOT IN (SELECT hash FROM h)) WHERE n = 1)",
)
_RUN_SQL = (
    "SELECT source, source_id, title, location, job_type, coalesce(is_remote, false) AS is_remote, min_salary, max_salary, hash AS content_hash, "
    "CASE WHEN source = 'findwork' THEN 'Python|' || company ELSE '' END AS skills "
    "FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)"
)
NOW = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"


def run_twice(spark, sf):
    """Two landings, each followed by a streaming run with the same checkpoint, then a run with nothing new."""
    root, rows = scratch(spark), landed(spark, sf)
    folders = {name: f"{root}/landing/{name}" for name in L.SOURCES}
    store = S.Store(spark, f"{root}/store")
    embedding = I.Embedding(hex_embedder, "hex", DIM)

    def run():
        query = start_ingestion(spark, folders, store, f"{root}/checkpoint", embedding, now=F.expr(NOW))
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()

    _land(remotive_pages(rows.filter("id % 2 = 0")), folders["remotive"])
    _land(findwork_pages(rows.filter("id % 2 = 1")), folders["findwork"])
    run()  # the third board has no folder yet
    _land(jobicy_pages(rows), folders["jobicy"])
    run()
    run()
    return store


@check("I01_incremental_ingestion", with_ctes(*_RUN_JOBS) + _RUN_SQL)
def _(spark, sf):
    store = run_twice(spark, sf)
    return store.jobs.read().select(
        "source", "source_id", "title", "location", "job_type", "is_remote", "min_salary", "max_salary", "content_hash",
        F.array_join("skills", "|").alias("skills"),
    )


@check(
    "I01_batch_after_reset",
    with_ctes(*_RUN_JOBS) + "SELECT source, source_id FROM remotive WHERE id % 2 = 0 UNION ALL SELECT source, source_id FROM r2",
)
def _(spark, sf):
    """Stream, reset from the first board's postings, stream again: neither the reset nor the next batch is lost."""
    root, rows = scratch(spark), landed(spark, sf)
    folders = {name: f"{root}/landing/{name}" for name in L.SOURCES}
    store, embedding = S.Store(spark, f"{root}/store"), I.Embedding(hex_embedder, "hex", DIM)

    def run():
        start_ingestion(spark, folders, store, f"{root}/checkpoint", embedding, now=F.expr(NOW)).awaitTermination()

    _land(findwork_pages(rows.filter("id % 2 = 1")), folders["findwork"])
    run()
    # what the reset loads has contents of the second run's board, which are then known
    first = L.remotive(remotive_pages(rows.filter("id % 2 = 0"))).unionByName(L.findwork(findwork_pages(rows.filter("id % 2 = 1"))))
    I.reset_from_csv(store, first.drop("page", "pos"), embedding, F.expr(NOW))
    _land(jobicy_pages(rows), folders["jobicy"])
    run()
    return store.jobs.read().filter("source <> 'findwork'").select("source", "source_id")


@check(
    "K04_edit_between_batches",
    with_ctes(
        *_ALL_SOURCES,
        "h AS (SELECT *, sha256(concat(title, '|', company, '|', description, '|', coalesce(location, ''))) AS hash FROM findwork)",
        "f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS n FROM h WHERE id % 2 = 1) WHERE n = 1)",
        "f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS n FROM h WHERE id % 2 = 0 "
        "AND hash NOT IN (SELECT hash FROM f1 WHERE id % 6 <> 3)) WHERE n = 1)",
    )
    + "SELECT source_id, CASE WHEN id % 4 = 1 THEN 'edited' ELSE title END AS title, CAST(1 AS BIGINT) AS identities FROM f1 WHERE id % 6 <> 3 "
    "UNION ALL SELECT source_id, title, 1 FROM f2",
)
def _(spark, sf):
    """Batch, edit, batch, and the first batch delivered again: patches and deletes stay, chunks go with what is deleted."""
    root, rows = scratch(spark), landed(spark, sf)
    store, embedding, now = S.Store(spark, f"{root}/store"), I.Embedding(hex_embedder, "hex", DIM), F.expr(NOW)
    raw = L.findwork(findwork_pages(rows))
    odd = F.col("source_id").cast("bigint") % 2 == 1
    I.ingest_batch(store, raw.filter(odd), "s#0", embedding, now=now)
    stored = store.jobs.read().select("id", F.col("source_id").cast("bigint").alias("n"))
    typed = dict(part.split(" ", 1) for part in schemas.JOB.split(", "))
    changes = stored.filter("n % 4 = 1 OR n % 6 = 3").select(
        "id", F.when(F.col("n") % 6 == 3, "delete").otherwise("patch").alias("op"), F.col("n").alias("seq"),
        *[(F.lit("edited") if c == "title" else F.lit(None)).cast(typed[c]).alias(c) for c in S.PATCHABLE],
    )
    S.edit_postings(store, changes, now, "edit")
    I.ingest_batch(store, raw.filter(~odd), "s#1", embedding, now=now)
    I.ingest_batch(store, raw.filter(odd), "s#0", embedding, now=now)
    identities = store.chunks.read().filter("chunk_type = 'identity'").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("identities"))
    return store.jobs.read().join(identities, "id", "full").select("source_id", "title", "identities")


@check(
    "I02_stream_dedup",
    "SELECT user_id, event_type, count(*) AS rows FROM (SELECT DISTINCT user_id, event_type, event_id % 3 AS third, "
    "CAST(ts AS DATE) AS day FROM events) GROUP BY 1, 2",
)
def _(spark, sf):
    """The events land three times in three triggers; each content of a day passes once, the state holds no more than the delay."""
    root = scratch(spark)
    events = views.table(spark, sf, "events").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("third"), F.col("ts").cast("date").alias("day")
    )
    for again in range(3):
        events.withColumn("again", F.lit(again)).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    stream = spark.readStream.schema("user_id BIGINT, event_type STRING, ts TIMESTAMP, third BIGINT, day DATE").option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    once = distinct_within(stream, ["user_id", "event_type", "third", "day"], "ts", "1000 days")
    query = once.writeStream.format("parquet").option("path", f"{root}/once").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id BIGINT, event_type STRING").parquet(f"{root}/once").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("rows"))


@check(
    "I05_run_metrics",
    with_ctes(*_RUN_JOBS)
    + "SELECT CAST(0 AS BIGINT) AS run, (SELECT count(*) FROM h) AS fetched, (SELECT count(*) FROM r1) AS stored, CAST(0 AS BIGINT) AS skipped "
    "UNION ALL SELECT 1, (SELECT count(*) FROM h2), (SELECT count(*) FROM r2), (SELECT count(*) FROM h2 WHERE hash IN (SELECT hash FROM h))",
)
def _(spark, sf):
    """Counts of each run; the third finds no new file and runs no batch."""
    return run_twice(spark, sf).runs.read().withColumnRenamed("version", "run")


@check(
    "I03_self_healing_chunks",
    with_ctes(*_RUN_JOBS)
    + "SELECT source, source_id, CAST(1 AS BIGINT) AS identities FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)",
)
def _(spark, sf):
    """The chunks of every second posting get lost after the first run; landing the same pages again restores them."""
    root, rows = scratch(spark), landed(spark, sf)
    store, embedding, now = S.Store(spark, f"{root}/store"), I.Embedding(hex_embedder, "hex", DIM), F.expr(NOW)
    first = L.remotive(remotive_pages(rows.filter("id % 2 = 0"))).unionByName(L.findwork(findwork_pages(rows.filter("id % 2 = 1"))))
    I.ingest_batch(store, first, 0, embedding, now=now)
    lost = store.jobs.read().filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).select(F.col("id").alias("job_id"))
    store.chunks.commit(store.chunks.read().limit(0), deleted=lost)
    I.ingest_batch(store, first.unionByName(L.jobicy(jobicy_pages(rows))), 2, embedding, now=now)
    identities = store.chunks.read().filter("chunk_type = 'identity'").groupBy("job_id").agg(F.count(F.lit(1)).alias("identities"))
    jobs = store.jobs.read().select(F.col("id").alias("job_id"), "source", "source_id")
    return jobs.join(identities, "job_id").select("source", "source_id", "identities")


def half_broken_parser(raw):
    """A stand-in for a parsing model: every second answer cannot be read."""
    good = F.to_json(F.struct(F.concat(F.lit("About "), "title").alias("summary"), F.array("title").alias("skills"), F.lit("$70k").alias("salary")))
    return raw.withColumn("response", F.when(F.col("source_id").cast("bigint") % 2 == 0, good).otherwise(F.lit("sorry")))


@check(
    "I04_bad_answers_are_isolated",
    with_ctes(*_ALL_SOURCES)
    + "SELECT source_id, CASE WHEN id % 2 = 0 THEN 'About ' || title END AS summary, "
    "CASE WHEN id % 2 = 0 THEN 70000 END AS min_salary, id % 2 = 0 OR TRUE AS has_identity, id % 2 = 0 AS structured FROM findwork",
)
def _(spark, sf):
    """Unreadable answers leave fields empty; the posting is stored, with window chunks unless its source gave skills."""
    root, rows = scratch(spark), landed(spark, sf)
    store, embedding = S.Store(spark, f"{root}/store"), I.Embedding(hex_embedder, "hex", DIM)
    raw = L.findwork(findwork_pages(rows)).withColumn("keywords", F.array().cast("array<string>"))
    I.ingest_batch(store, raw, 0, embedding, half_broken_parser, F.expr(NOW))
    kinds = store.chunks.read().groupBy(F.col("job_id").alias("id")).agg(
        F.max(F.col("chunk_type") == "identity").alias("has_identity"), (~F.max(F.col("chunk_type") == "description") & F.max(F.col("chunk_type") == "benefits")).alias("structured")
    )
    return store.jobs.read().join(kinds, "id").select("source_id", "summary", "min_salary", "has_identity", "structured")


@check(
    "K08_truncate_and_reload",
    with_ctes(views.POSTINGS, "o AS (SELECT * FROM postings)")
    + "SELECT source_id, title, min_salary, CAST(CASE WHEN min_salary IS NULL AND max_salary IS NULL THEN 0 ELSE 1 END AS BIGINT) AS salary_chunks FROM o",
)
def _(spark, sf):
    """A store with other content is emptied and loaded from CSV."""
    root = scratch(spark)
    store, embedding = S.Store(spark, f"{root}/store"), I.Embedding(hex_embedder, "hex", DIM)
    I.ingest_batch(store, L.findwork(findwork_pages(landed(spark, sf))), 0, embedding, now=F.expr(NOW))
    typed = dict(part.split(" ", 1) for part in schemas.JOB.split(", "))
    rows = views.postings(spark, sf).withColumn("id", F.col("id").cast("string"))
    jobs = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(typed[c]).alias(c) for c in schemas.JOB_COLUMNS])
    S.export_csv(jobs, f"{root}/csv", compression="gzip")
    I.reset_from_csv(store, T.csv_to_raw(T.read_csv_rows(spark, f"{root}/csv")), embedding, F.expr(NOW))
    salaries = store.chunks.read().groupBy(F.col("job_id").alias("id")).agg(F.count(F.when(F.col("chunk_type") == "salary", 1)).alias("salary_chunks"))
    return store.jobs.read().join(salaries, "id").select("source_id", "title", "min_salary", "salary_chunks")
