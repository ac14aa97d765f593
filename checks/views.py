"""Job-posting views over the test tables, in Spark and as SQL common table expressions.

Whole tables throughout: every order is a posting, every document a posting with text, every embedding a chunk, and the
questions are the mean vectors of the embedding labels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.session import shared_folder
from tallywork.sources.tables import scan, scan_dealt


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A test table, with its schema given so that no job is spent on reading footers.

    `spread` is for queries with costly work per row over these single-split files, see `scan_dealt`.
    """
    path, schema = f"{sf_dir}/{name}.parquet", SCHEMAS[name]
    if spread:
        return scan_dealt(spark, path, schema, schema.split()[0], spark.sparkContext.defaultParallelism)
    return scan(spark, path, schema)


# ---- postings: one per order ---------------------------------------------------------------------

_JOB_COLUMNS = """
 o.o_orderkey AS id, concat('src', CAST(o.o_orderkey % 3 AS STRING)) AS source, CAST(o.o_orderkey AS STRING) AS source_id,
 concat(c.c_mktsegment, ' ', o.o_orderpriority) AS title, concat('Company ', CAST(o.o_custkey % 97 AS STRING)) AS company,
 CASE n.n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('Remote - ', n.n_name) ELSE n.n_name END AS location,
 CASE o.o_orderkey % 6 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'internship'
  WHEN 4 THEN 'freelance' END AS job_type,
 (o.o_orderkey % 4 = 1) AS is_remote,
 CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice) AS INT) END AS min_salary,
 CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
  ELSE CAST(floor(o.o_totalprice) AS INT) + CAST((o.o_orderkey % 7) * 1000 AS INT) END AS max_salary,
 concat('http://jobs.example/', CAST(o.o_orderkey AS STRING)) AS url,
 {array}(c.c_mktsegment, o.o_orderpriority, n.n_name) AS skills, o.o_orderdate AS fetched_at, o.o_orderdate AS created_at
"""
_JOB_FROM = (
    " FROM {o} o JOIN {c} c ON c.c_custkey = o.o_custkey JOIN {n} n ON n.n_nationkey = c.c_nationkey"
)


def jobs(spark: SparkSession, sf_dir: str, spread: bool = False, among: DataFrame | None = None) -> DataFrame:
    """`among` holds the ids (its one column) that the caller joins with: orders are cut to them before anything is added to them."""
    orders = table(spark, sf_dir, "orders", spread)
    if among is not None:
        orders = orders.join(among.toDF("o_orderkey"), "o_orderkey", "left_semi")
    return spark.sql(
        "SELECT " + _JOB_COLUMNS.format(array="array") + _JOB_FROM.format(o="{o}", c="{c}", n="{n}"),
        o=orders,
        c=table(spark, sf_dir, "customer"),
        n=table(spark, sf_dir, "nation"),
    )


JOBS = (
    "jobs AS (SELECT " + _JOB_COLUMNS.format(array="list_value") + _JOB_FROM.format(o="orders", c="customer", n="nation") + ")"
)

# ---- postings with text: one per document --------------------------------------------------------

_POSTING_COLUMNS = """
 j.*, d.text AS description, d.lang AS lang,
 CASE WHEN j.id % 3 = 0 THEN concat(j.title, ' summary') END AS summary,
 CASE WHEN j.id % 4 = 0 THEN '$' || CAST(j.min_salary AS STRING) || ' per year' END AS salary,
 CASE WHEN j.id % 6 < 2 THEN {array}(concat('Know ', j.title), 'Speak well') ELSE {empty} END AS requirements,
 CASE WHEN j.id % 6 IN (1, 2) THEN {array}('Ship things', concat('Serve ', j.company)) ELSE {empty} END AS responsibilities,
 CASE WHEN j.id % 6 = 3 THEN {array}('Dental', 'Vision') ELSE {empty} END AS benefits,
 CASE WHEN j.id % 2 = 0 THEN j.skills ELSE {empty} END AS job_skills
"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings; a fifth of them has no structured field at all."""
    columns = _POSTING_COLUMNS.format(array="array", empty="CAST(array() AS ARRAY<STRING>)")
    rows = spark.sql(
        "SELECT " + columns + " FROM {d} d JOIN {j} j ON j.id = d.doc_id",
        d=table(spark, sf_dir, "documents", spread=True),
        # whichever side is broadcast, the other is spread
        j=jobs(spark, sf_dir, spread=True, among=table(spark, sf_dir, "documents", spread=True).select("doc_id")),
    )
    return rows.drop("skills").withColumnRenamed("job_skills", "skills")


POSTINGS = (
    JOBS
    + ", postings AS (SELECT * EXCLUDE (skills, job_skills), job_skills AS skills FROM (SELECT "
    + _POSTING_COLUMNS.format(array="list_value", empty="CAST([] AS VARCHAR[])")
    + " FROM documents d JOIN jobs j ON j.id = d.doc_id))"
)

# ---- chunks and question vectors -----------------------------------------------------------------

_CHUNK_COLUMNS = """
 e.vec_id AS chunk_id, CAST(floor(e.vec_id / 4) AS BIGINT) AS job_id,
 CASE e.vec_id % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'requirements' WHEN 2 THEN 'responsibilities' ELSE 'benefits' END
  AS chunk_type,
 concat('chunk ', CAST(e.vec_id AS STRING)) AS chunk_text, e.embedding AS embedding, e.label AS label
"""
_QUESTION_COLUMNS = """
 concat('q', CAST(v.label + 1 AS STRING)) AS query_id, v.label AS label, v.label AS position,
 CASE v.label % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' WHEN 2 THEN 'filtering' WHEN 3 THEN 'aggregation'
  ELSE 'noisy' END AS category,
 CASE v.label % 5 WHEN 0 THEN 'find building jobs' WHEN 1 THEN 'jobs with good benefits and which skills'
  WHEN 2 THEN 'what salary and requirements' WHEN 3 THEN 'how many duties and responsibilities are there'
  ELSE 'looking for a framework or tool with insurance' END AS question,
 v.vector AS vector
"""

THRESHOLD = 0.2


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT " + _CHUNK_COLUMNS + " FROM {e} e", e=table(spark, sf_dir, "embeddings"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per embedding label, its vector the mean of the label's embeddings.

    Questions are embedded once and stored, as every step of a search reads them again: they are written to the shared
    folder on first use in a session.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED_QUESTIONS:
        path = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
        _mean_questions(spark, sf_dir).coalesce(1).write.parquet(path)
        _STORED_QUESTIONS[key] = path
    return scan(spark, _STORED_QUESTIONS[key], QUESTION)


_STORED_QUESTIONS: dict[tuple[str, str], str] = {}
QUESTION = "query_id STRING, label INT, position INT, category STRING, question STRING, vector ARRAY<DOUBLE>"


def _mean_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = entries.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("entries"))
    vectors = vectors.select("label", F.transform("entries", lambda e: e["x"]).alias("vector"))
    return spark.sql("SELECT " + _QUESTION_COLUMNS + " FROM {v} v", v=vectors)


CHUNKS = "chunks AS (SELECT " + _CHUNK_COLUMNS + " FROM embeddings e)"
QUESTIONS = (
    """means AS (SELECT label, list(x ORDER BY pos) AS vector FROM (
 SELECT label, pos, avg(x) AS x FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x,
  generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label),
questions AS (SELECT """
    + _QUESTION_COLUMNS
    + " FROM means v)"
)
# All pairs, in the oracle only: the plain statement of what the search must return.
PAIRS = """pairs AS (SELECT q.query_id, q.label AS query_label, c.chunk_id, c.job_id, c.chunk_type, c.chunk_text, c.label,
 round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.vector), 9) AS similarity FROM questions q, chunks c)"""


def top_chunks_sql(k: int, threshold: float = THRESHOLD) -> str:
    return (
        "hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) "
        f"AS rank FROM pairs WHERE similarity >= {threshold}) WHERE rank <= {k})"
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
