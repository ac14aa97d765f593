"""Vector search, context assembly, routing and prompts over the chunk and posting views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.fields import FIELDS_SQL, SALARY_HEADER_SQL
from checks.registry import add, check
from checks.views import THRESHOLD, top_chunks_sql, with_ctes
from tallywork import constants as K
from tallywork.operators import embedding as E
from tallywork.operators import vector as V
from tallywork.plans import retrieval as R
from tallywork.plans import answers, routing
from tallywork.operators.filters import filter_jobs
from tallywork.plans.ingest import has_embedding
from tallywork.plans.requests import FILTERED, newest_of, rows_json

_SEARCH = (views.CHUNKS, views.QUESTIONS, views.PAIRS)


def job_details(spark, sf, spread=False):
    """Postings with the lists the context appendix reads."""
    jobs = views.jobs(spark, sf, spread)
    return jobs.select(
        "*",
        F.array(F.concat(F.lit("Know "), "title")).alias("requirements"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("Ship"), F.lit("Fix"))).otherwise(F.array().cast("array<string>")).alias("responsibilities"),
        F.array(F.lit("Dental")).alias("benefits"),
        F.concat("company", F.lit(" hires for "), F.repeat("title", F.lit(200))).alias("description"),
    )


DETAILS = (
    "details AS (SELECT *, ['Know ' || title] AS requirements, CASE WHEN id % 2 = 0 THEN ['Ship', 'Fix'] ELSE CAST([] AS VARCHAR[]) END "
    "AS responsibilities, ['Dental'] AS benefits, company || ' hires for ' || repeat(title, 200) AS description FROM jobs)"
)


# ---- embedding -----------------------------------------------------------------------------------

DIM = 16


def hex_embedder(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a model: the first hex digits of the text's hash."""
    import hashlib

    return [[float(int(c, 16)) for c in hashlib.sha256(t.encode()).hexdigest()[:DIM]] for t in texts]


def _hex_sql(text: str) -> str:
    return f"list_transform(range(1, {DIM + 1}), lambda i: instr('0123456789abcdef', substr(sha256({text}), i, 1)) - 1)"


@check("V01_embed_column", f"SELECT doc_id, array_to_string({_hex_sql('text')}, ',') AS vector FROM documents")
def _(spark, sf):
    docs = views.table(spark, sf, "documents", spread=True).select("doc_id", "text")
    embedded, _ = E.embed_column(docs, "text", hex_embedder, "hex", ["doc_id"], dim=DIM)
    digits = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return embedded.select("doc_id", F.array_join(digits, ",").alias("vector"))


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@check(
    "V02_embedding_cache",
    f"""WITH cache AS (SELECT sha256(text) AS h, max(TIMESTAMP '2024-01-10 00:00:00' + to_hours(CAST(doc_id % 100 AS INT) * 3)) AS at
 FROM documents WHERE doc_id % 3 > 0 GROUP BY 1)
SELECT d.doc_id, coalesce(c.at > {_NOW} - INTERVAL 7 DAY, false) AS cached, array_to_string({_hex_sql('d.text')}, ',') AS vector
FROM documents d LEFT JOIN cache c ON c.h = sha256(d.text)""",
)
def _(spark, sf):
    """Two thirds of the texts are in the cache, some of them too old, some under another model's name only."""
    docs = views.table(spark, sf, "documents", spread=True).select("doc_id", "text")
    stored = docs.filter("doc_id % 3 > 0").select(F.sha2("text", 256).alias("text_hash"), "text", "doc_id")
    vectors = E.embed_texts(stored.dropDuplicates(["text_hash"]), hex_embedder, DIM)
    at = F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00' + make_dt_interval(0, CAST(doc_id % 100 AS INT) * 3)")
    ages = stored.groupBy("text_hash").agg(F.max(at).alias("cached_at"))
    own = vectors.join(ages, "text_hash").select("text_hash", F.lit("hex").alias("model"), "embedding", "cached_at")
    other = own.select(
        "text_hash", F.lit("other").alias("model"), F.transform("embedding", lambda x: x * 0).alias("embedding"), "cached_at"
    )
    now = F.expr(_NOW.replace("TIMESTAMP ", "TIMESTAMP_NTZ"))
    cache = own.unionByName(other)
    embedded, fresh = E.embed_column(docs, "text", hex_embedder, "hex", ["doc_id"], dim=DIM, cache=cache, now=now)
    missing = fresh.select(F.col("text_hash").alias("h"), F.lit(True).alias("embedded_now"))
    flagged = embedded.withColumn("h", F.sha2("text", 256)).join(missing, "h", "left")
    digits = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return flagged.select("doc_id", F.col("embedded_now").isNull().alias("cached"), F.array_join(digits, ",").alias("vector"))


# ---- vector search -------------------------------------------------------------------------------


@check(
    "V03_cosine_similarity",
    with_ctes(views.CHUNKS, views.QUESTIONS)
    + "SELECT c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.vector), 6) AS similarity "
    "FROM chunks c JOIN questions q ON q.label = c.label",
)
def _(spark, sf):
    """Every chunk against the question of its own label."""
    pairs = views.chunks(spark, sf).join(views.questions(spark, sf).select("label", "vector"), "label")
    return pairs.select("chunk_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("vector")), 6).alias("similarity"))


_TOP_SQL = "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM hits"


@check("V04_vector_top_k", with_ctes(*_SEARCH, top_chunks_sql(15)) + _TOP_SQL)
def _(spark, sf):
    top = V.vector_top_k(views.chunks(spark, sf), views.questions(spark, sf), 15, THRESHOLD)
    return top.withColumn("similarity", F.round("similarity", 6))


@check("V04_vector_top_k_in_cells", with_ctes(*_SEARCH, top_chunks_sql(15)) + _TOP_SQL)
def _(spark, sf):
    """The same result by the way taken when there are too many questions to send to every task."""
    top = V.vector_top_k(
        views.chunks(spark, sf), views.questions(spark, sf), 15, THRESHOLD, max_block_queries=4, cell_rows=150
    )
    return top.withColumn("similarity", F.round("similarity", 6))


@check(
    "P16_similarity_threshold",
    with_ctes(*_SEARCH)
    + "SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.3 AND label = query_label",
)
def _(spark, sf):
    own = views.questions(spark, sf).select("query_id", "label", "vector")
    pairs = views.chunks(spark, sf).join(own, "label").filter(F.col("embedding").isNotNull())
    scored = pairs.withColumn("similarity", V.cosine_similarity(F.col("embedding"), F.col("vector")))
    return scored.filter(F.col("similarity") >= 0.3).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@check(
    "V05_vector_top_k_with_job",
    with_ctes(views.JOBS, *_SEARCH, top_chunks_sql(10))
    + "SELECT h.query_id, h.chunk_id, h.job_id, j.title, round(h.similarity, 6) AS similarity FROM hits h JOIN jobs j ON j.id = h.job_id",
)
def _(spark, sf):
    found = R.best_chunks(views.chunks(spark, sf), views.questions(spark, sf), 10, THRESHOLD)
    titles = views.jobs(spark, sf).select(F.col("id").alias("job_id"), "title")
    joined = R.bounded_join(titles, found, "job_id", "inner", 10 * 1024)
    return joined.select("query_id", "chunk_id", "job_id", "title", F.round("similarity", 6).alias("similarity"))


# Eight postings of the chunk table make the id list of one user; the users' questions take the vectors in turn.
_LIST = 8
_USERS_SQL = (
    f"users AS (SELECT 'u' || n AS query_id, q.label, q.query_id AS base_id, q.question FROM (SELECT DISTINCT job_id // {_LIST} AS n FROM chunks) c "
    "JOIN questions q ON q.label = n % 10)"
)
_WANTED_SQL = (
    f"wanted AS (SELECT u.query_id, u.base_id, c.job_id, row_number() OVER (PARTITION BY u.query_id ORDER BY c.job_id DESC) - 1 AS pos FROM "
    f"(SELECT DISTINCT job_id FROM chunks{{more}}) c JOIN users u ON u.query_id = 'u' || ((c.job_id % 1000000) // {_LIST}))"
)
_WANTED = _WANTED_SQL.format(more="")
_BEST = (
    "best AS (SELECT w.query_id, w.job_id, max(p.similarity) AS s FROM wanted w JOIN pairs p ON p.query_id = w.base_id AND p.job_id = w.job_id GROUP BY 1, 2)"
)


def users(spark, sf, missing=False):
    """Questions with explicit id lists, as many as the chunk table asks for; `missing` adds an id without chunks."""
    jobs = views.chunks(spark, sf).select("job_id").distinct().withColumn("n", F.floor(F.col("job_id") / _LIST))
    lists = jobs.groupBy("n").agg(F.sort_array(F.collect_list("job_id"), False).alias("context_job_ids"))
    if missing:
        gone = F.array((F.col("n") * _LIST + 1000000).cast("bigint"))
        lists = lists.withColumn("context_job_ids", F.concat(gone, "context_job_ids"))
    lists = lists.withColumn("label", (F.col("n") % 10).cast("int"))
    asked = lists.join(views.questions(spark, sf).select("label", "question", "vector"), "label")
    return asked.select(F.concat(F.lit("u"), F.col("n").cast("string")).alias("query_id"), "question", "vector", "context_job_ids")


@check(
    "V06_vector_rank_within",
    with_ctes(*_SEARCH, _USERS_SQL, _WANTED)
    + "SELECT w.query_id, w.job_id, p.chunk_id, round(p.similarity, 6) AS similarity FROM wanted w JOIN pairs p ON p.query_id = w.base_id AND p.job_id = w.job_id",
)
def _(spark, sf):
    asked = users(spark, sf)
    ranked = V.vector_rank_within(views.chunks(spark, sf), asked, R.wanted_from_ids(asked), R.question_bound(asked))
    return ranked.withColumn("similarity", F.round("similarity", 6))


@check(
    "W10_rank_given_ids",
    with_ctes(
        *_SEARCH,
        _USERS_SQL,
        _WANTED_SQL.format(more=f" UNION ALL SELECT DISTINCT (job_id // {_LIST}) * {_LIST} + 1000000 FROM chunks"),
        _BEST,
    )
    + "SELECT query_id, job_id, CAST(rank AS INT) AS rank, round(s, 6) AS similarity FROM (SELECT w.query_id, w.job_id, coalesce(b.s, 0) AS s, "
    "row_number() OVER (PARTITION BY w.query_id ORDER BY coalesce(b.s, 0) DESC, pos) AS rank FROM wanted w LEFT JOIN best b USING (query_id, job_id))",
)
def _(spark, sf):
    """Each list also names a posting without chunks, which ranks with similarity 0."""
    asked = users(spark, sf, missing=True)
    ranked = R.rank_given(views.chunks(spark, sf), asked, R.wanted_from_ids(asked), R.question_bound(asked))
    return ranked.select("query_id", "job_id", "rank", F.round("similarity", 6).alias("similarity"))


# ---- grouping and context ------------------------------------------------------------------------

_GROUPS = (
    "groups AS (SELECT query_id, job_id, max(similarity) AS similarity, string_agg('[' || chunk_type || ']: ' || chunk_text, "
    "chr(10) || chr(10) ORDER BY similarity DESC, chunk_id) AS body FROM hits GROUP BY 1, 2)"
)
_FOUND = (
    "found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, job_id) AS rank "
    "FROM groups) WHERE rank <= 5)"
)


@check(
    "A21_group_chunks_by_job",
    with_ctes(*_SEARCH, top_chunks_sql(15), _GROUPS) + "SELECT query_id, job_id, round(similarity, 6) AS similarity, body FROM groups",
)
def _(spark, sf):
    hits = R.best_chunks(views.chunks(spark, sf), views.questions(spark, sf), 15, THRESHOLD)
    return R.group_by_job(hits).withColumn("similarity", F.round("similarity", 6))


@check(
    "R02_retrieve",
    with_ctes(*_SEARCH, top_chunks_sql(15), _GROUPS, _FOUND)
    + "SELECT query_id, job_id, round(similarity, 6) AS similarity, body, CAST(rank AS INT) AS rank FROM found",
)
def _(spark, sf):
    found = R.retrieve(views.chunks(spark, sf), views.questions(spark, sf), threshold=THRESHOLD)
    return found.withColumn("similarity", F.round("similarity", 6))


def _appendix_sql(body: str) -> str:
    lines = ", ".join(
        f"CASE WHEN list_contains(fields, '{f}') AND len({f}) > 0 AND NOT contains({body}, '[{f}]:') "
        f"THEN '[{f}]: ' || array_to_string({f}, ', ') END"
        for f in K.APPENDIX_FIELDS
    )
    return f"coalesce(chr(10) || nullif(concat_ws(chr(10), {lines}), ''), '')"


def _block_ctes(found: str, body: str) -> str:
    header = (
        "'Job: ' || title || ' at ' || company || coalesce(' | Location: ' || location, '') || coalesce(' | Type: ' || job_type, '') || "
        f"{SALARY_HEADER_SQL} || ' | Similarity: ' || printf('%.2f', similarity)"
    )
    return (
        f"joined AS (SELECT f.query_id, f.job_id, f.similarity, f.rank, left({body}, 2400) AS cut, d.*, "
        f"{FIELDS_SQL.format(q='q.question')} AS fields FROM {found} f JOIN questions q USING (query_id) JOIN details d ON d.id = f.job_id),\n"
        f"blocks AS (SELECT *, '---' || chr(10) || {header} || chr(10) || cut || {_appendix_sql('cut')} AS block FROM joined)"
    )


_RETRIEVAL_BLOCKS = (views.JOBS, DETAILS, *_SEARCH, top_chunks_sql(15), _GROUPS, _FOUND, _block_ctes("found", "f.body"))


def _blocks(spark, sf):
    return R.retrieval_blocks(views.chunks(spark, sf), job_details(spark, sf), views.questions(spark, sf), threshold=THRESHOLD)


@check("R03_context_block", with_ctes(*_RETRIEVAL_BLOCKS) + "SELECT query_id, job_id, CAST(rank AS INT) AS rank, block FROM blocks")
def _(spark, sf):
    return _blocks(spark, sf).select("query_id", "job_id", "rank", "block")


_ASKED = "concat(title, ' duties and benefits', CASE WHEN id % 5 = 0 THEN ' or skills' ELSE '' END)"


@check(
    "R04_field_appendix",
    with_ctes(
        views.JOBS,
        DETAILS,
        f"s AS (SELECT *, {FIELDS_SQL.format(q=_ASKED)} AS fields, CASE id % 3 WHEN 0 THEN '[benefits]: x' ELSE 'nothing' END AS body FROM details)",
    )
    + f"SELECT id, {_appendix_sql('body')} AS appendix FROM s",
)
def _(spark, sf):
    rows = job_details(spark, sf, spread=True).withColumn("asked", F.expr(_ASKED))
    body = F.when(F.col("id") % 3 == 0, F.lit("[benefits]: x")).otherwise(F.lit("nothing"))
    return rows.select("id", R.field_appendix(R.detect_fields(F.col("asked")), body).alias("appendix"))


_GIVEN_BLOCKS = (
    views.JOBS, DETAILS, *_SEARCH, _USERS_SQL, _WANTED, _BEST,
    "given AS (SELECT w.query_id, w.job_id, coalesce(b.s, 0) AS similarity, row_number() OVER (PARTITION BY w.query_id "
    "ORDER BY coalesce(b.s, 0) DESC, pos) AS rank FROM wanted w LEFT JOIN best b USING (query_id, job_id))",
    _block_ctes("given", "d.description").replace("JOIN questions q", "JOIN users q"),
)


@check("R05_context_from_ids", with_ctes(*_GIVEN_BLOCKS) + "SELECT query_id, job_id, CAST(rank AS INT) AS rank, block FROM blocks")
def _(spark, sf):
    asked = users(spark, sf)
    blocks = R.given_blocks(views.chunks(spark, sf), job_details(spark, sf), asked, R.wanted_from_ids(asked))
    return blocks.select("query_id", "job_id", "rank", "block")


@check(
    "R06_sources",
    with_ctes(*_RETRIEVAL_BLOCKS)
    + "SELECT query_id, job_id, title, company, url, floor(similarity * 100.0 + 0.5) / 100.0 AS similarity FROM blocks",
)
def _(spark, sf):
    return R.sources(_blocks(spark, sf))


# ---- resumes -------------------------------------------------------------------------------------


def resumes(spark, sf):
    """Customers with resumes of various completeness."""
    return views.table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "c_mktsegment AS question",
        """named_struct('name', CASE WHEN c_custkey % 7 > 0 THEN c_name END, 'summary', CASE WHEN c_custkey % 3 = 0 THEN 'Short' END,
 'location', CASE WHEN c_custkey % 5 = 0 THEN 'Here' END,
 'skills', CASE WHEN c_custkey % 2 = 0 THEN transform(sequence(1, 20), i -> concat('s', CAST(i AS STRING))) ELSE CAST(array() AS ARRAY<STRING>) END,
 'experience', CASE WHEN c_custkey % 4 > 1 THEN transform(sequence(1, CAST(c_custkey % 5 + 1 AS INT)), i -> named_struct(
   'company', concat('Co', CAST(i AS STRING)), 'title', CASE WHEN i = 2 THEN '' ELSE concat(c_mktsegment, CAST(i AS STRING)) END,
   'start_date', CASE WHEN i % 2 = 1 THEN '2020' END, 'end_date', CASE WHEN i = 3 THEN '2021' END)) ELSE array() END) AS resume""",
    )


_RESUMES_SQL = """r AS (SELECT c_custkey, c_mktsegment AS question, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS name,
 CASE WHEN c_custkey % 3 = 0 THEN 'Short' END AS summary, CASE WHEN c_custkey % 5 = 0 THEN 'Here' END AS location,
 CASE WHEN c_custkey % 2 = 0 THEN list_transform(range(1, 21), lambda i: 's' || i) ELSE CAST([] AS VARCHAR[]) END AS skills,
 CASE WHEN c_custkey % 4 > 1 THEN least(c_custkey % 5 + 1, 3) ELSE 0 END AS jobs FROM customer)"""


@check(
    "R01_search_text",
    with_ctes(
        _RESUMES_SQL,
        "t AS (SELECT *, array_to_string(list_filter(list_transform(range(1, jobs + 1), lambda i: CASE WHEN i = 2 THEN '' ELSE question || i END), "
        "lambda x: x <> ''), ' ') AS titles, array_to_string(skills[1:15], ' ') AS words FROM r)",
    )
    + "SELECT c_custkey, coalesce(nullif(concat_ws(' ', nullif(titles, ''), nullif(words, '')), ''), question) AS text FROM t",
)
def _(spark, sf):
    return resumes(spark, sf).select("c_custkey", R.search_text(F.col("question"), F.col("resume")).alias("text"))


@check(
    "R07_profile_text",
    with_ctes(
        _RESUMES_SQL,
        "t AS (SELECT *, array_to_string(list_transform(range(1, jobs + 1), lambda i: CASE WHEN i = 2 THEN '' ELSE question || i END || ' at Co' || i "
        "|| CASE WHEN i = 1 THEN ' (2020–Present)' WHEN i = 3 THEN ' (2020–2021)' ELSE '' END), '; ') AS past FROM r)",
        "l AS (SELECT c_custkey, concat_ws(chr(10), '  Name: ' || name, '  Summary: ' || summary, '  Skills: ' || nullif(array_to_string(skills, ', '), ''), "
        "'  Experience: ' || nullif(past, ''), '  Location: ' || location) AS lines FROM t)",
    )
    + "SELECT c_custkey, CASE WHEN lines = '' THEN '' ELSE 'User Profile:' || chr(10) || lines || chr(10) || chr(10) END AS profile FROM l",
)
def _(spark, sf):
    return resumes(spark, sf).select("c_custkey", R.profile_text(F.col("resume")).alias("profile"))


# ---- prompts -------------------------------------------------------------------------------------


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CONTEXT = "ctx AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY 1)"


@check(
    "R08_retrieval_prompt",
    with_ctes(*_RETRIEVAL_BLOCKS, _CONTEXT)
    + f"SELECT query_id, {_lit(K.RETRIEVAL_PROMPT_HEAD)} || 'Job Postings:' || chr(10) || context || chr(10) || chr(10) || 'User Query: ' || question "
    "|| chr(10) || chr(10) || 'Answer:' AS prompt FROM ctx JOIN questions USING (query_id)",
)
def _(spark, sf):
    context = R.contexts(_blocks(spark, sf))
    asked = views.questions(spark, sf).select("query_id", "question").join(context, "query_id")
    return asked.select("query_id", R.retrieval_prompt(F.col("question"), F.col("context"), F.lit("")).alias("prompt"))


_JSON_SQL = "to_json(list({'skill': skill, 'job_count': job_count} ORDER BY job_count DESC, skill))"
_DEMAND = (
    "demand AS (SELECT skill, count(*) AS job_count FROM (SELECT unnest(skills) AS skill FROM jobs) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)"
)


@check(
    "R08_aggregation_prompt",
    with_ctes(views.JOBS, views.QUESTIONS, _DEMAND)
    + f"SELECT query_id, {_lit(K.AGGREGATION_PROMPT_HEAD)} || 'Data:' || chr(10) || (SELECT {_JSON_SQL} FROM demand) || chr(10) || chr(10) || 'User question: ' "
    "|| question || chr(10) || chr(10) || 'Answer:' AS prompt FROM questions",
)
def _(spark, sf):
    asked = views.questions(spark, sf).select(
        "query_id", "question", F.lit("aggregation").alias("route"), F.lit("skills_demand").alias("intent"),
        F.array().cast("array<string>").alias("params"),
    )
    rows = routing.statistics_for(views.jobs(spark, sf), asked)
    return asked.join(rows, "query_id").select(
        "query_id", R.aggregation_prompt(F.col("question"), F.col("rows")).alias("prompt")
    )


_ROUTE_TEXTS = [
    "how many remote jobs are available", "find python developer jobs", "find frontend jobs and how many are remote",
    "what types of driving jobs exist", "list all available locations", "nurses in Ohio", "jobs for nurses",
    "average pay", "counting sheep", "refind it",
]
_ROUTE_RESPONSES = [
    '{"type":"aggregation","intent":"count_remote"}', "garbage", '{"type":"hybrid","intent":"skills_demand","params":["a"]}',
    '{"type":"hybrid","intent":"filter_jobs","filters":{"title":"%x%"}}', '{"type":"aggregation","intent":"filter_jobs"}',
    '{"type":"retrieval","intent":null}', None,
]
_WORDING = ["aggregation", "retrieval", "hybrid", "aggregation", "aggregation", "undecided", "retrieval", "aggregation", "undecided", "undecided"]


def _cases(key: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else _lit(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


def _route_table() -> tuple[list, list]:
    """Expected route and intent for every pair of text and response."""
    answers = [("aggregation", "count_remote", False), ("retrieval", None, False), ("hybrid", "skills_demand", False),
               ("hybrid", "filter_jobs", True), ("aggregation", "filter_jobs", False), ("retrieval", None, False),
               ("retrieval", None, False)]
    routes, intents = [], []
    for n in range(len(_ROUTE_TEXTS) * len(_ROUTE_RESPONSES)):
        kind, (answer, intent, filters) = _WORDING[n % len(_ROUTE_TEXTS)], answers[n % len(_ROUTE_RESPONSES)]
        kind = answer if kind == "undecided" else kind
        if kind == "retrieval" or intent is None or (intent == "filter_jobs" and not filters):
            kind, intent = "retrieval", None
        elif intent == "filter_jobs":
            kind = "filter"
        routes.append(kind)
        intents.append(intent)
    return routes, intents


_ROUTES, _INTENTS = _route_table()


@check(
    "R09_route_queries",
    f"SELECT event_id, {_cases('event_id', _WORDING)} AS wording, CASE WHEN user_id % 9 = 0 THEN 'retrieval' ELSE {_cases('event_id', _ROUTES)} END AS route, "
    f"CASE WHEN user_id % 9 = 0 THEN NULL ELSE {_cases('event_id', _INTENTS)} END AS intent FROM events",
)
def _(spark, sf):
    asked = views.table(spark, sf, "events", spread=True).selectExpr(
        "event_id",
        f"{_cases('event_id', _ROUTE_TEXTS).replace(chr(39) * 2, chr(39))} AS question",
        f"{_cases('event_id', _ROUTE_RESPONSES)} AS response",
        "CASE WHEN user_id % 9 = 0 THEN array('a') END AS context_job_ids",
    )
    return routing.route_queries(asked).select("event_id", "wording", "route", "intent")


@check(
    "R10_filter_then_retrieve",
    with_ctes(
        views.JOBS, DETAILS, *_SEARCH,
        "ids AS (SELECT id, row_number() OVER (ORDER BY fetched_at DESC NULLS LAST, id) - 1 AS pos FROM jobs WHERE title ILIKE '%u%' "
        "AND job_type ILIKE '%time%' AND id IN (SELECT job_id FROM chunks) ORDER BY fetched_at DESC NULLS LAST, id LIMIT 30)",
        "best AS (SELECT query_id, job_id, max(similarity) AS s FROM pairs GROUP BY 1, 2)",
        "given AS (SELECT q.query_id, i.id AS job_id, coalesce(b.s, 0) AS similarity, row_number() OVER (PARTITION BY q.query_id "
        "ORDER BY coalesce(b.s, 0) DESC, pos) AS rank FROM ids i CROSS JOIN questions q LEFT JOIN best b ON b.query_id = q.query_id AND b.job_id = i.id)",
        _block_ctes("given", "d.description"),
    )
    + "SELECT query_id, job_id, CAST(rank AS INT) AS rank, block FROM blocks",
)
def _(spark, sf):
    chunks = views.chunks(spark, sf)
    embedded = has_embedding(job_details(spark, sf), chunks)
    blocks = R.filter_then_retrieve(chunks, embedded, views.questions(spark, sf), {"title": "%u%", "job_type": "%time%"})
    return blocks.select("query_id", "job_id", "rank", "block")


@check(
    "R10_filter_finds_nothing",
    with_ctes(*_RETRIEVAL_BLOCKS) + "SELECT query_id, job_id, CAST(rank AS INT) AS rank, block FROM blocks",
)
def _(spark, sf):
    blocks = R.filter_then_retrieve(
        views.chunks(spark, sf), job_details(spark, sf), views.questions(spark, sf), {"title": "%astronaut%"}, threshold=THRESHOLD
    )
    return blocks.select("query_id", "job_id", "rank", "block")


@check(
    "R11_hybrid_answers",
    with_ctes(
        *_RETRIEVAL_BLOCKS, _DEMAND,
        "ctx AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks JOIN questions q2 USING (query_id) WHERE q2.label % 3 > 0 GROUP BY 1)",
        f"st AS (SELECT query_id, CASE WHEN label % 4 = 3 THEN '[]' ELSE (SELECT {_JSON_SQL} FROM demand) END AS rows FROM questions WHERE label % 2 = 1)",
        "b AS (SELECT q.query_id, question, context, rows, CASE WHEN context IS NOT NULL AND rows IS NOT NULL THEN 'hybrid' WHEN context IS NOT NULL THEN 'retrieval' "
        "WHEN rows IS NOT NULL AND rows <> '[]' THEN 'aggregation' ELSE 'none' END AS type FROM questions q LEFT JOIN ctx USING (query_id) LEFT JOIN st USING (query_id))",
    )
    + f"""SELECT query_id, type, CASE type WHEN 'hybrid' THEN {_lit(K.HYBRID_PROMPT_HEAD)} || 'Job listings:' || chr(10) || context || chr(10) || chr(10)
  || 'Statistical data:' || chr(10) || rows || chr(10) || chr(10) || 'User question: ' || question || chr(10) || chr(10) || 'Answer:'
 WHEN 'retrieval' THEN {_lit(K.RETRIEVAL_PROMPT_HEAD)} || 'Job Postings:' || chr(10) || context || chr(10) || chr(10) || 'User Query: ' || question || chr(10) || chr(10) || 'Answer:'
 WHEN 'aggregation' THEN {_lit(K.AGGREGATION_PROMPT_HEAD)} || 'Data:' || chr(10) || rows || chr(10) || chr(10) || 'User question: ' || question || chr(10) || chr(10) || 'Answer:'
 ELSE CASE WHEN rows IS NOT NULL THEN {_lit(K.NO_DATA_ANSWER)} ELSE {_lit(K.NO_POSTINGS_ANSWER)} END END AS prompt FROM b""",
)
def _(spark, sf):
    """Questions with both sides, one side, an empty statistic, or neither."""
    asked = views.questions(spark, sf)
    labels = asked.select("query_id", "label")
    context = R.contexts(_blocks(spark, sf)).join(labels.filter("label % 3 > 0"), "query_id", "left_semi")
    wanted_statistic = labels.filter("label % 2 = 1").select(
        "query_id", F.lit("hybrid").alias("route"), F.lit("skills_demand").alias("intent"), F.array().cast("array<string>").alias("params")
    )
    statistics = routing.statistics_for(views.jobs(spark, sf), wanted_statistic).join(labels, "query_id")
    statistics = statistics.select("query_id", F.when(F.col("label") % 4 == 3, F.lit("[]")).otherwise(F.col("rows")).alias("rows"))
    return R.hybrid_answers(asked, context, statistics)


# ---- whole question tables -----------------------------------------------------------------------

# Question, classifier answer and what must come of them, by question label.
_TABLE = [
    ("find building jobs", None, "retrieval", None),
    ("jobs with good benefits and which skills", "garbage", "retrieval", None),
    ("what salary and requirements", '{"type":"aggregation","intent":"skills_demand"}', "aggregation", "demand"),
    ("how many duties are there", None, "retrieval", None),
    ("find a tool and count all", '{"type":"retrieval","intent":"skills_demand","params":[]}', "hybrid", "demand"),
    ("perks", '{"type":"hybrid","intent":"filter_jobs","filters":{"title":"%u%","jobType":"%time%"}}', "filter", "filtered"),
    ("experience", '{"type":"hybrid","intent":"filter_jobs","filters":{"title":"%u%","jobType":"%time%"}}', "filter", "filtered"),
    ("how many", '{"type":"aggregation","intent":"list_jobs_by_title","params":["%astronaut%"]}', "aggregation", "none"),
    ("count in total", '{"type":"aggregation","intent":"count_total"}', "aggregation", "total"),
    ("looking for anything", '{"type":"aggregation","intent":"count_total"}', "ids", None),
]


def _by_label(i: int) -> str:
    return _cases("label", [row[i] for row in _TABLE])


_LISTED = "{'id': id, 'title': title, 'company': company, 'location': location, 'job_type': job_type, 'min_salary': min_salary, 'max_salary': max_salary, 'url': url}"


@check(
    "R08_answer_table",
    with_ctes(
        views.JOBS, DETAILS, *_SEARCH,
        f"asked AS (SELECT *, {_by_label(0)} AS ask, {_by_label(2)} AS route, {_by_label(3)} AS statistic FROM questions)",
        top_chunks_sql(15), _GROUPS, _FOUND,
        "near AS (SELECT * FROM details WHERE id IN (SELECT job_id FROM chunks))",
        "ids AS (SELECT *, row_number() OVER (ORDER BY fetched_at DESC NULLS LAST, id) - 1 AS pos FROM near WHERE title ILIKE '%u%' AND job_type ILIKE '%time%' "
        "ORDER BY fetched_at DESC NULLS LAST, id LIMIT 30)",
        "best AS (SELECT query_id, job_id, max(similarity) AS s FROM pairs GROUP BY 1, 2)",
        "named AS (SELECT query_id, i.id AS job_id, pos FROM asked, ids i WHERE route = 'filter' UNION ALL SELECT query_id, unnest([3, 5, 999999999]), unnest([0, 1, 2]) FROM asked WHERE route = 'ids')",
        "given AS (SELECT n.query_id, n.job_id, coalesce(b.s, 0) AS similarity, row_number() OVER (PARTITION BY n.query_id ORDER BY coalesce(b.s, 0) DESC, pos) AS rank "
        "FROM named n LEFT JOIN best b USING (query_id, job_id))",
        "f2 AS (SELECT query_id, job_id, similarity, rank, CAST(body AS VARCHAR) AS body FROM found WHERE query_id IN (SELECT query_id FROM asked WHERE route IN ('retrieval', 'hybrid')) "
        "UNION ALL SELECT g.query_id, g.job_id, g.similarity, g.rank, d.description FROM given g JOIN near d ON d.id = g.job_id)",
        _block_ctes("f2", "f.body").replace("JOIN questions q", "JOIN asked q").replace("q.question", "q.ask").replace("JOIN details d", "JOIN near d"),
        _CONTEXT,
        "src AS (SELECT query_id, string_agg(job_id || ':' || printf('%.2f', floor(similarity * 100.0 + 0.5) / 100.0), ',' ORDER BY rank) AS sources FROM blocks GROUP BY 1)",
        "demand AS (SELECT skill, count(*) AS job_count FROM (SELECT unnest(skills) AS skill FROM near) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)",
        f"st AS (SELECT *, CASE statistic WHEN 'demand' THEN (SELECT {_JSON_SQL} FROM demand) WHEN 'none' THEN '[]' WHEN 'total' THEN (SELECT to_json(list({{'total': n}})) FROM (SELECT count(*) AS n FROM near)) "
        f"WHEN 'filtered' THEN (SELECT to_json(list({_LISTED} ORDER BY pos)) FROM ids) END AS rows FROM asked)",
        "b AS (SELECT st.query_id, ask AS question, context, rows, sources, CASE WHEN route = 'aggregation' OR (route = 'hybrid' AND context IS NULL) THEN 'aggregation' "
        "WHEN route IN ('retrieval', 'ids') OR context IS NULL THEN 'retrieval' ELSE 'hybrid' END AS type FROM st LEFT JOIN ctx USING (query_id) LEFT JOIN src USING (query_id))",
    )
    + f"""SELECT query_id, type, CASE WHEN type = 'aggregation' AND rows <> '[]' THEN {_lit(K.AGGREGATION_PROMPT_HEAD)} || 'Data:' || chr(10) || rows || chr(10) || chr(10) || 'User question: ' || question || chr(10) || chr(10) || 'Answer:'
 WHEN type = 'aggregation' THEN {_lit(K.NO_DATA_ANSWER)} WHEN context IS NULL THEN {_lit(K.NO_POSTINGS_ANSWER)}
 WHEN type = 'retrieval' THEN {_lit(K.RETRIEVAL_PROMPT_HEAD)} || 'Job Postings:' || chr(10) || context || chr(10) || chr(10) || 'User Query: ' || question || chr(10) || chr(10) || 'Answer:'
 ELSE {_lit(K.HYBRID_PROMPT_HEAD)} || 'Job listings:' || chr(10) || context || chr(10) || chr(10) || 'Statistical data:' || chr(10) || rows || chr(10) || chr(10) || 'User question: ' || question || chr(10) || chr(10) || 'Answer:' END AS prompt,
 CASE WHEN type <> 'aggregation' THEN sources END AS sources FROM b""",
)
def _(spark, sf):
    """Questions of every route over the embedded postings: search, statistics (one empty), both, filter, given ids."""
    chunks = views.chunks(spark, sf)
    jobs = has_embedding(job_details(spark, sf), chunks)
    asked = views.questions(spark, sf).selectExpr(
        "query_id", f"{_by_label(0)} AS question", "vector", f"{_by_label(1)} AS response",
        "IF(label = 9, array(3L, 5L, 999999999L), NULL) AS context_job_ids",
    )
    table = answers.answer_table(chunks, jobs, asked, threshold=THRESHOLD)
    source = F.transform("sources", lambda s: F.format_string("%d:%.2f", s["job_id"], s["similarity"]))
    return table.select("query_id", "type", "prompt", F.array_join(source, ",").alias("sources"))


# ---- tables of requests ---------------------------------------------------------------------------

# One compound filter per customer: part of a segment, a nation or none, a job type or none, bounds for some.
_FILTERS = """SELECT concat('c', CAST(c_custkey AS {text})) AS request, CASE WHEN c_custkey % 4 < 3 THEN concat('%', substr(c_mktsegment, 2, 4), '%') END AS title,
 CASE WHEN c_custkey % 3 = 0 THEN concat('%nation_', CAST(c_nationkey AS {text})) WHEN c_custkey % 3 = 1 THEN 'remote%' END AS location,
 CASE WHEN c_custkey % 5 = 0 THEN '%\\_time' WHEN c_custkey % 5 = 1 THEN 'contract' END AS job_type,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(floor(abs(c_acctbal) * 20) AS DOUBLE) END AS low, CASE WHEN c_custkey % 7 = 0 THEN CAST(300000 AS DOUBLE) END AS high FROM {customer}"""
_LIKE = "({0} IS NULL OR coalesce(j.{1} ILIKE {0} ESCAPE '\\', false))"


@check(
    "R10_filter_table",
    with_ctes(views.JOBS, "asked AS (" + _FILTERS.format(text="VARCHAR", customer="customer") + ")")
    + "SELECT request, CAST(pos AS INT) AS pos, id FROM (SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY fetched_at DESC NULLS LAST, id) AS pos "
    "FROM asked a JOIN jobs j ON " + " AND ".join(_LIKE.format(f"a.{c}", c) for c in ("title", "location", "job_type"))
    + " AND (low IS NULL OR min_salary >= low) AND (high IS NULL OR max_salary <= high) "
    "AND coalesce(a.title, a.location, a.job_type, CAST(low AS VARCHAR), CAST(high AS VARCHAR)) IS NOT NULL) WHERE pos <= 30",
)
def _(spark, sf):
    """A filter per customer, all in one plan."""
    asked = spark.sql(_FILTERS.format(text="STRING", customer="{c}"), c=views.table(spark, sf, "customer"))
    asked = asked.withColumns({c: F.lit(None).cast("string") for c in ("company", "skill")})
    return newest_of(views.jobs(spark, sf), asked, FILTERED).select("request", "pos", F.col("job.id").alias("id"))


# One statistic per customer, of every kind that has parameters; many customers share one.
_STATISTICS = """SELECT concat('c', CAST(c_custkey AS {text})) AS query_id, CASE c_custkey % 8 WHEN 0 THEN 'list_jobs_by_title' WHEN 1 THEN 'list_jobs_by_location'
 WHEN 2 THEN 'list_jobs_by_company' WHEN 3 THEN 'salary_stats_by_title' WHEN 4 THEN 'list_distinct_titles' WHEN 5 THEN 'jobs_between_salary' WHEN 6 THEN 'jobs_above_salary'
 ELSE 'list_jobs_by_skill' END AS intent, CASE c_custkey % 8 WHEN 0 THEN concat('%', substr(c_mktsegment, 1, 5), '%') WHEN 1 THEN concat('%_', CAST(c_nationkey AS {text}))
 WHEN 2 THEN concat('company ', CAST(c_custkey % 90 AS {text})) WHEN 3 THEN concat(c_mktsegment, '%') WHEN 4 THEN concat('%', substr(c_mktsegment, 4, 2), '%')
 WHEN 5 THEN CAST(CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS {text}) WHEN 6 THEN CAST(CAST(floor(abs(c_acctbal) * 50) AS BIGINT) AS {text})
 ELSE lower(c_mktsegment) END AS p1, CASE WHEN c_custkey % 8 = 5 THEN '250000' END AS p2 FROM {customer}"""
_JOB_JSON = "list({'title': title, 'company': company, 'location': location, 'job_type': job_type, 'min_salary': min_salary, 'max_salary': max_salary, 'url': url} ORDER BY pos)"


def _listed_sql(intent: str, condition: str, order: str = "fetched_at DESC NULLS LAST, id") -> str:
    return (
        f"SELECT query_id, to_json({_JOB_JSON}) AS rows FROM (SELECT query_id, j.*, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS pos "
        f"FROM asked a JOIN jobs j ON a.intent = '{intent}' AND {condition}) WHERE pos <= 20 GROUP BY query_id"
    )


@check(
    "R08_statistics_table",
    with_ctes(
        views.JOBS, "asked AS (" + _STATISTICS.format(text="VARCHAR", customer="customer") + ")",
        "found AS (" + " UNION ALL ".join([
            _listed_sql("list_jobs_by_title", "j.title ILIKE p1"), _listed_sql("list_jobs_by_location", "j.location ILIKE p1"),
            _listed_sql("list_jobs_by_company", "j.company ILIKE p1"), _listed_sql("list_jobs_by_skill", "len(list_filter(j.skills, lambda s: p1 ILIKE s)) > 0"),
            _listed_sql("jobs_above_salary", "min_salary >= TRY_CAST(p1 AS BIGINT)", "min_salary DESC NULLS LAST, id"),
            _listed_sql("jobs_between_salary", "min_salary >= TRY_CAST(p1 AS BIGINT) AND max_salary <= TRY_CAST(p2 AS BIGINT)", "min_salary DESC NULLS LAST, id"),
            "SELECT query_id, to_json(list({'min': lo, 'max': hi, 'avg': mean, 'job_count': n})) AS rows FROM (SELECT query_id, min(min_salary) AS lo, max(max_salary) AS hi, "
            "CAST(floor(sum(min_salary) / count(min_salary) + 0.5) AS BIGINT) AS mean, count(min_salary) AS n FROM asked a LEFT JOIN jobs j ON j.title ILIKE p1 "
            "WHERE a.intent = 'salary_stats_by_title' GROUP BY query_id) GROUP BY query_id",
            "SELECT query_id, to_json(list({'title': title} ORDER BY title)) AS rows FROM (SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY title) AS pos "
            "FROM (SELECT DISTINCT query_id, title FROM asked a JOIN jobs j ON a.intent = 'list_distinct_titles' AND j.title ILIKE p1)) WHERE pos <= 30 GROUP BY query_id",
        ]) + ")",
    )
    + "SELECT query_id, coalesce(CAST(rows AS VARCHAR), '[]') AS rows FROM asked LEFT JOIN found USING (query_id)",
)
def _(spark, sf):
    """A statistic per customer, all in one plan."""
    asked = spark.sql(_STATISTICS.format(text="STRING", customer="{c}"), c=views.table(spark, sf, "customer"))
    asked = asked.select("query_id", F.lit("aggregation").alias("route"), "intent", F.array_compact(F.array("p1", "p2")).alias("params"))
    return routing.statistics_for(views.jobs(spark, sf), asked)


# ---- joins named after their use -----------------------------------------------------------------

add(
    "J10_chunks_of_given_jobs",
    lambda spark, sf: R.chunks_of(
        views.chunks(spark, sf), views.jobs(spark, sf), (F.col("job_type") == "contract") & F.col("location").isNotNull()
    ).select("chunk_id", "job_id", "chunk_type"),
    with_ctes(views.JOBS, views.CHUNKS)
    + "SELECT chunk_id, job_id, chunk_type FROM chunks WHERE job_id IN (SELECT id FROM jobs WHERE job_type = 'contract' AND location IS NOT NULL)",
)


@check(
    "J02_chunk_with_job",
    with_ctes(views.JOBS, views.CHUNKS) + "SELECT chunk_id, job_id, title, company FROM chunks JOIN jobs ON id = job_id",
)
def _(spark, sf):
    titles = views.jobs(spark, sf).select(F.col("id").alias("job_id"), "title", "company")
    return views.chunks(spark, sf).select("chunk_id", "job_id").join(titles, "job_id")


@check(
    "J03_groups_with_details",
    with_ctes(views.JOBS, *_SEARCH, top_chunks_sql(15), _GROUPS, _FOUND)
    + "SELECT f.query_id, f.job_id, j.title, j.company, j.url FROM found f JOIN jobs j ON j.id = f.job_id WHERE j.location IS NOT NULL",
)
def _(spark, sf):
    """Groups whose posting is gone (here: without location) drop out after the choice of the five best."""
    found = R.retrieve(views.chunks(spark, sf), views.questions(spark, sf), threshold=THRESHOLD)
    details = views.jobs(spark, sf).filter(F.col("location").isNotNull())
    details = details.select(F.col("id").alias("job_id"), "title", "company", "url")
    return R.bounded_join(details, found, "job_id", "inner", 5 * 1024).select("query_id", "job_id", "title", "company", "url")


@check(
    "J16_filter_ids_feed_search",
    with_ctes(
        views.JOBS, *_SEARCH,
        "ids AS (SELECT id FROM jobs WHERE min_salary >= 100000 AND title ILIKE '%e%' AND id IN (SELECT job_id FROM chunks) "
        "ORDER BY fetched_at DESC NULLS LAST, id LIMIT 30)",
    )
    + "SELECT query_id, job_id, chunk_id, round(similarity, 6) AS similarity FROM pairs WHERE job_id IN (SELECT id FROM ids)",
)
def _(spark, sf):
    chunks, asked = views.chunks(spark, sf), views.questions(spark, sf)
    embedded = has_embedding(views.jobs(spark, sf), chunks)
    found = filter_jobs(embedded, title="%e%", min_salary=100000).select(F.lit(True).alias("all"), F.col("id").alias("job_id"))
    named = asked.select("query_id", F.lit(True).alias("all")).join(F.broadcast(found), "all").drop("all")  # 30 postings at most
    return V.vector_rank_within(chunks, asked, named, bound=R.question_bound(asked)).withColumn("similarity", F.round("similarity", 6))
