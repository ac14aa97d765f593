"""Typed chunks and text windows over postings with text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import check
from tallywork import constants as K
from tallywork.functions import chunks as C
from tallywork.plans.ingest import to_chunks

_STRUCTURED = (
    "(summary IS NOT NULL OR salary IS NOT NULL OR len(requirements) > 0 OR len(responsibilities) > 0 "
    "OR len(benefits) > 0 OR len(skills) > 0)"
)
_HEAD = "title || ' at ' || company"
_PLACE = "CASE WHEN location IS NULL THEN 'Remote' ELSE 'in ' || location END"
_KIND = (
    "CASE WHEN job_type IS NOT NULL THEN job_type || CASE WHEN is_remote THEN ', remote' ELSE '' END "
    "WHEN is_remote THEN 'remote' END"
)
_IDENTITY = f"concat_ws('. ', {_HEAD}, {_PLACE}, {_KIND}, summary) || '.'"
_NEEDS = f"'Requirements for ' || {_HEAD} || ': ' || array_to_string(requirements, '. ')"
_WORK = (
    "concat_ws('. ', CASE WHEN len(responsibilities) > 0 THEN 'Responsibilities: ' || array_to_string(responsibilities, '. ') END, "
    "CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END)"
)
_PAY = (
    "concat_ws('. ', CASE WHEN len(benefits) > 0 THEN 'Benefits at ' || company || ': ' || array_to_string(benefits, '. ') END, "
    "'Compensation: ' || salary)"
)
_PLAIN_IDENTITY = f"concat_ws('. ', {_HEAD}, 'in ' || location, job_type) || '.'"
_SALARY = (
    f"{_HEAD} || '. Salary: ' || concat_ws('–', '$' || format('{{:,}}', min_salary), '$' || format('{{:,}}', max_salary)) || ' per year.'"
)

# Segments: a separator that no text holds is put at every break, innermost level first needed.
_SEP = "chr(1)"


def segments_sql(text: str) -> str:
    sentences = (
        f"list_transform(string_split(regexp_replace(b, '([.!?]){K.WHITESPACE_CLASS}+', '\\1' || {_SEP}, 'g'), {_SEP}), lambda s: s || ' ')"
    )
    bullets = (
        f"flatten(list_transform(string_split(regexp_replace(p, '\\n([-•*] )', {_SEP} || chr(10) || '\\1', 'g'), {_SEP}), "
        f"lambda b: CASE WHEN length(b) <= {K.WINDOW_CHARS} THEN [b] ELSE {sentences} END))"
    )
    return (
        f"list_filter(flatten(list_transform(string_split(regexp_replace({text}, '\\n\\n+', {_SEP}, 'g'), {_SEP}), "
        f"lambda p: CASE WHEN length(p) <= {K.WINDOW_CHARS} THEN [p || chr(10) || chr(10)] ELSE {bullets} END)), "
        f"lambda s: regexp_matches(s, '[^{K.WHITESPACE_CLASS[1:]}'))"
    )


def _trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{K.WHITESPACE_CLASS}+|{K.WHITESPACE_CLASS}+$', '', 'g')"


def windows_ctes(source: str, text: str, key: str) -> list[str]:
    """CTEs ending in `win(key, texts)`: pieces folded into windows, uncapped."""
    room = K.WINDOW_CHARS - K.WINDOW_OVERLAP
    return [
        f"seg AS (SELECT {key}, {segments_sql(text)} AS parts FROM {source})",
        f"pieces AS (SELECT {key}, flatten(list_transform(parts, lambda s: list_transform(range(0, length(s), {room}), "
        f"lambda i: substring(s, i + 1, {room})))) AS parts FROM seg)",
        f"folded AS (SELECT {key}, list_reduce(list_transform(parts, lambda s: {{'cur': s, 'done': CAST([] AS VARCHAR[])}}), "
        f"lambda acc, x: CASE WHEN length(acc.cur) + length(x.cur) <= {K.WINDOW_CHARS} "
        "THEN {'cur': acc.cur || x.cur, 'done': acc.done} "
        f"ELSE {{'cur': right(acc.cur, {K.WINDOW_OVERLAP}) || x.cur, 'done': list_append(acc.done, {_trim_sql('acc.cur')})}} END, "
        "{'cur': '', 'done': CAST([] AS VARCHAR[])}) AS f FROM pieces)",
        f"win AS (SELECT {key}, CASE WHEN {_trim_sql('f.cur')} <> '' THEN list_append(f.done, {_trim_sql('f.cur')}) ELSE f.done END AS texts FROM folded)",
    ]


def _fields(df):
    return {c: F.col(c) for c in df.columns}


@check("T01_has_structure", views.with_ctes(views.POSTINGS) + f"SELECT id, {_STRUCTURED} AS structured FROM postings")
def _(spark, sf):
    rows = views.postings(spark, sf)
    lists = [F.col(c) for c in ("responsibilities", "requirements", "benefits", "skills")]
    return rows.select("id", C.has_structure(F.col("summary"), F.col("salary"), *lists).alias("structured"))


@check(
    "T02_structured_chunks",
    views.with_ctes(
        views.POSTINGS,
        f"""c AS (SELECT id, 1 AS n, 'identity' AS chunk_type, {_IDENTITY} AS chunk_text FROM postings
 UNION ALL SELECT id, 2, 'requirements', {_NEEDS} FROM postings WHERE len(requirements) > 0
 UNION ALL SELECT id, 3, 'responsibilities', {_WORK} FROM postings WHERE len(responsibilities) > 0 OR len(skills) > 0
 UNION ALL SELECT id, 4, 'benefits', {_PAY} FROM postings WHERE len(benefits) > 0 OR salary IS NOT NULL)""",
    )
    + "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS pos, chunk_type, chunk_text FROM c",
)
def _(spark, sf):
    rows = views.postings(spark, sf)
    return rows.select("id", F.posexplode(C.structured_chunks(_fields(rows))).alias("pos", "c")).select(
        "id", "pos", F.col("c.type").alias("chunk_type"), F.col("c.text").alias("chunk_text")
    )


@check("T03_identity_text", views.with_ctes(views.POSTINGS) + f"SELECT id, {_IDENTITY} AS text FROM postings")
def _(spark, sf):
    c = _fields(views.postings(spark, sf))
    text = C.identity_text(c["title"], c["company"], c["location"], c["job_type"], c["is_remote"], c["summary"])
    return views.postings(spark, sf).select("id", text.alias("text"))


# Documents in which a third got paragraphs, a third bullets.
_SHAPED = (
    "CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', concat('.', chr(10), chr(10), chr(10))) "
    "WHEN 1 THEN replace(text, '. ', concat('.', chr(10), '- ')) ELSE text END"
)


def shaped(spark, sf):
    return views.table(spark, sf, "documents", spread=True).selectExpr("doc_id", f"{_SHAPED} AS text")


_SHAPED_SQL = f"shaped AS (SELECT doc_id, {_SHAPED} AS text FROM documents)"


@check(
    "T05_segments",
    views.with_ctes(_SHAPED_SQL, f"seg AS (SELECT doc_id, {segments_sql('text')} AS parts FROM shaped)")
    + "SELECT doc_id, CAST(len(parts) AS INT) AS n, sha256(array_to_string(parts, '|')) AS digest FROM seg",
)
def _(spark, sf):
    parts = shaped(spark, sf).select("doc_id", C.segments(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").alias("n"), F.sha2(F.array_join("parts", "|"), 256).alias("digest"))


@check(
    "T06_windows",
    views.with_ctes(_SHAPED_SQL, *windows_ctes("shaped", "text", "doc_id"))
    + "SELECT doc_id, array_to_string(texts, '|') AS windows FROM win",
)
def _(spark, sf):
    """All windows of the whole text, as postings get them."""
    return shaped(spark, sf).select("doc_id", F.array_join(C.windows(F.col("text")), "|").alias("windows"))


@check(
    "T06_windows_whole_text",
    views.with_ctes(_SHAPED_SQL, *windows_ctes("shaped", "text", "doc_id"))
    + "SELECT doc_id, CAST(len(texts) AS INT) AS n, sha256(array_to_string(texts, '|')) AS digest FROM win",
)
def _(spark, sf):
    texts = shaped(spark, sf).select("doc_id", C.windows(F.col("text"), max_windows=None).alias("w"))
    return texts.select("doc_id", F.size("w").alias("n"), F.sha2(F.array_join("w", "|"), 256).alias("digest"))


def _window_chunks_sql(only: str = "TRUE") -> str:
    first = "texts"
    return f"""SELECT id, 1 AS n, 'identity' AS chunk_type, {_PLAIN_IDENTITY} AS chunk_text FROM postings WHERE {only}
 UNION ALL SELECT id, 2, 'salary', {_SALARY} FROM postings WHERE (min_salary IS NOT NULL OR max_salary IS NOT NULL) AND {only}
 UNION ALL SELECT id, 2 + i, CASE WHEN i = 1 THEN 'requirements' ELSE 'description' END, t
  FROM (SELECT id, unnest({first}) AS t, generate_subscripts({first}, 1) AS i FROM win)"""


@check(
    "T04_window_chunks",
    views.with_ctes(
        views.POSTINGS,
        *windows_ctes("postings", "description", "id"),
        "c AS (" + _window_chunks_sql() + ")",
    )
    + "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS pos, chunk_type, chunk_text FROM c",
)
def _(spark, sf):
    rows = views.postings(spark, sf)
    return rows.select("id", F.posexplode(C.window_chunks(_fields(rows))).alias("pos", "c")).select(
        "id", "pos", F.col("c.type").alias("chunk_type"), F.col("c.text").alias("chunk_text")
    )


@check(
    "T01_build_chunks",
    views.with_ctes(
        views.POSTINGS,
        *windows_ctes(f"postings WHERE NOT {_STRUCTURED}", "description", "id"),
        f"""c AS (SELECT id, 1 AS n, 'identity' AS chunk_type, {_IDENTITY} AS chunk_text FROM postings WHERE {_STRUCTURED}
 UNION ALL SELECT id, 2, 'requirements', {_NEEDS} FROM postings WHERE len(requirements) > 0
 UNION ALL SELECT id, 3, 'responsibilities', {_WORK} FROM postings WHERE len(responsibilities) > 0 OR len(skills) > 0
 UNION ALL SELECT id, 4, 'benefits', {_PAY} FROM postings WHERE len(benefits) > 0 OR salary IS NOT NULL
 UNION ALL {_window_chunks_sql('NOT ' + _STRUCTURED)})""",
    )
    + "SELECT id AS job_id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS pos, chunk_type, chunk_text FROM c",
)
def _(spark, sf):
    return to_chunks(views.postings(spark, sf))
