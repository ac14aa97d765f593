"""Labels, judging, retrieval metrics and judge agreement.

Verdicts are synthetic: a chunk of the question's label is relevant, of a neighbouring label marginal. The second judge
shifts the label by the question's number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views
from checks.registry import add, check
from checks.views import THRESHOLD, top_chunks_sql, with_ctes
from tallywork import constants as K
from tallywork.catalogue import EVAL_QUERIES
from tallywork.operators.ranking import head_and_tail
from tallywork.plans import calibration as C
from tallywork.plans import evaluation as E
from tallywork.plans import labeling as L
from tallywork.session import shared_folder
from tallywork.sinks.tables import Store
from tallywork.sources.tables import catalogue

_SEARCH = (views.CHUNKS, views.QUESTIONS, views.PAIRS)

# ---- labels --------------------------------------------------------------------------------------

# Words that occur in the documents, as single tokens, phrases and with special characters.
GROUPS = {
    "k1": [["the", "der"]],
    "k2": [["the"], ["of", "and", "las"]],
    "k3": [["mail", "example.com"], ["the", "la", "und"]],
    "k4": [["of the", "de la"]],
    "k5": [["nothing-like-this"]],
    "k6": [["c#", ".net"], ["of", "la", "der", "the"]],
}
EXPECTED = {"k7": ["und", "les", "el"], "k8": []}
_MINIMUM, _CAPS = 5, {"k1": 12, "k3": 50}


def label_questions(spark):
    rows = [
        (q, "exact", q, EXPECTED.get(q, []), GROUPS.get(q), _MINIMUM, _CAPS.get(q), i)
        for i, q in enumerate([*GROUPS, *EXPECTED])
    ]
    from tallywork import schemas

    return spark.createDataFrame(rows, schemas.EVAL_QUERY)


_TITLE = "concat(lang, CASE doc_id % 4 WHEN 0 THEN ' the C# dev' WHEN 1 THEN ' asp.net and la' WHEN 2 THEN ' der c#x' ELSE '' END)"


def label_jobs(spark, sf):
    return views.table(spark, sf, "documents", spread=True).selectExpr("doc_id AS id", f"{_TITLE} AS title", "text AS description")


def _pattern(keyword: str) -> str:
    """Consuming form of the whole-token match, as the oracle's patterns have no look-around."""
    word = "abcdefghijklmnopqrstuvwxyz0123456789_"
    lead = "(^|[^a-z0-9_])" if keyword[0] in word else "[a-z0-9_]"
    tail = "($|[^a-z0-9_])" if keyword[-1] in word else "($|[^a-z0-9])"
    quoted = keyword.replace(".", "\\.")
    return lead + quoted + tail


def _group_score(words: list[str]) -> str:
    if not words:
        return "0"
    pattern = "|".join(_pattern(w) for w in words)
    return f"(CASE WHEN regexp_matches(t, '{pattern}') THEN 2 WHEN regexp_matches(d, '{pattern}') THEN 1 ELSE 0 END)"


def _scored_sql(groups=None, caps=_CAPS, title=_TITLE) -> str:
    """CTEs ending in `labels`; `groups` gives each question's AND groups."""
    parts = []
    for q, words in (groups or {**GROUPS, **{q: [w] for q, w in EXPECTED.items()}}).items():
        scores = [_group_score(g) for g in words]
        all_match = " AND ".join(f"{s} > 0" for s in scores)
        parts.append(
            f"SELECT '{q}' AS query_id, id, CASE WHEN {all_match} THEN {' + '.join(scores)} ELSE 0 END AS score, "
            f"{caps.get(q, K.LABEL_CAP)} AS cap FROM low"
        )
    return (
        f"low AS (SELECT doc_id AS id, lower({title}) AS t, lower(text) AS d FROM documents),\n"
        "scored AS (" + "\nUNION ALL ".join(parts) + "),\n"
        "labels AS (SELECT * FROM (SELECT query_id, id, score, cap, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank "
        "FROM scored WHERE score > 0) WHERE rank <= cap)"
    )


_LABELS_SQL = "SELECT query_id, id, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM labels"


@check("E01_label_candidates", with_ctes(_scored_sql()) + _LABELS_SQL)
def _(spark, sf):
    return L.label_candidates(label_jobs(spark, sf), label_questions(spark))


@check("J11_labels_by_token_join", with_ctes(_scored_sql()) + _LABELS_SQL)
def _(spark, sf):
    """The same labels by the way taken for a question table of any size."""
    return L.label_candidates(label_jobs(spark, sf), label_questions(spark))


@check(
    "W11_capped_labels",
    with_ctes(_scored_sql()) + "SELECT query_id, id FROM labels WHERE query_id IN ('k1', 'k3')",
)
def _(spark, sf):
    capped = label_questions(spark).filter(F.col("max_relevant").isNotNull())
    return L.label_candidates(label_jobs(spark, sf), capped).select("query_id", "id")


@check(
    "E01_label_summary",
    with_ctes(
        _scored_sql(),
        "qs AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in [*GROUPS, *EXPECTED]) + "]) AS query_id)",
        "n AS (SELECT qs.query_id, count(id) AS n, CASE qs.query_id WHEN 'k1' THEN 12 WHEN 'k3' THEN 50 ELSE 40 END AS cap "
        "FROM qs LEFT JOIN labels USING (query_id) GROUP BY 1)",
    )
    + f"SELECT query_id, n AS label_count, CASE WHEN n < {_MINIMUM} THEN concat('Only ', n, ' jobs matched (expected >= {_MINIMUM})') "
    "WHEN n = cap THEN concat('Capped at ', cap, ' candidates — consider tuning max_relevant') END AS label_warning FROM n",
)
def _(spark, sf):
    questions = label_questions(spark)
    return L.label_summary(L.label_candidates(label_jobs(spark, sf), questions), questions)


_POSTED = (
    "concat(lang, CASE doc_id % 8 WHEN 0 THEN ' Registered Nurse, Denver' WHEN 1 THEN ' CDL-A truck driver in San Antonio' "
    "WHEN 2 THEN ' house parents with relocation' WHEN 3 THEN ' youth counselor' WHEN 4 THEN ' learning healthcare' "
    "WHEN 5 THEN ' patient care, Texas delivery' WHEN 6 THEN ' mental health mentor' ELSE '' END)"
)


@check(
    "S11_catalogue_labels",
    with_ctes(
        _scored_sql(
            {q["id"]: q.get("keyword_groups") or [q["expected_keywords"]] for q in EVAL_QUERIES},
            {q["id"]: q["max_relevant"] for q in EVAL_QUERIES if "max_relevant" in q},
            _POSTED,
        )
    )
    + _LABELS_SQL,
)
def _(spark, sf):
    """The built-in questions labelled against all documents."""
    jobs = views.table(spark, sf, "documents", spread=True).selectExpr("doc_id AS id", f"{_POSTED} AS title", "text AS description")
    return L.label_candidates(jobs, catalogue(spark))


# ---- retrieval and judging -----------------------------------------------------------------------

_JUDGE = "CASE WHEN {a} = {b} THEN 'relevant' WHEN abs({a} - {b}) = 1 THEN 'marginal' ELSE 'not_relevant' END"
_RETRIEVED = (
    "best AS (SELECT * FROM (SELECT query_id, query_label, chunk_id, job_id, label, similarity, row_number() OVER (PARTITION BY query_id, job_id "
    "ORDER BY similarity DESC, chunk_id) AS n FROM hits) WHERE n = 1),\n"
    "ret AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM best)"
)
# A posting's verdict is that of its chunk with the smallest id; postings of every ninth id are not judged yet.
_JUDGMENTS = (
    "lab AS (SELECT job_id, arg_min(label, chunk_id) AS label FROM chunks GROUP BY 1),\n"
    f"judg AS (SELECT 'local' AS judge, q.query_id, l.job_id, {_JUDGE.format(a='q.label', b='l.label')} AS verdict FROM questions q, lab l WHERE l.job_id % 9 > 0\n"
    f" UNION ALL SELECT 'remote', q.query_id, l.job_id, {_JUDGE.format(a='q.label', b='(l.label + l.job_id % 3)')} FROM questions q, lab l WHERE l.job_id % 9 > 0)"
)
_JUDGED = (
    "judged AS (SELECT r.*, coalesce(j.verdict, 'not_relevant') AS verdict FROM ret r LEFT JOIN judg j "
    "ON j.judge = 'local' AND j.query_id = r.query_id AND j.job_id = r.job_id)"
)
_EVAL = (*_SEARCH, top_chunks_sql(10), _RETRIEVED, _JUDGMENTS, _JUDGED)


def retrieved(spark, sf):
    return E.retrieve_for_eval(views.chunks(spark, sf), views.questions(spark, sf), threshold=THRESHOLD)


def judgments(spark, sf, pairs):
    """Stored verdicts of both judges for the given (query_id, job_id) pairs, with gaps."""
    first = views.chunks(spark, sf).groupBy("job_id").agg(F.min_by("label", "chunk_id").alias("job_label"))
    labels = views.questions(spark, sf).select("query_id", F.col("label").alias("query_label"))
    rows = pairs.select("query_id", "job_id").distinct().join(first, "job_id").join(labels, "query_id").filter("job_id % 9 > 0")

    def verdict(judge, shift):
        text = _JUDGE.format(a="query_label", b=f"(job_label + {shift})")
        return rows.select(F.lit(judge).alias("judge"), "query_id", "job_id", F.expr(text).alias("verdict"))

    return verdict("local", "0").unionByName(verdict("remote", "job_id % 3"))


def judged(spark, sf):
    found = retrieved(spark, sf)
    return E.with_verdicts(found, judgments(spark, sf, found), "local")


_RET_SQL = "SELECT query_id, job_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM ret"


@check("E02_retrieve_for_eval", with_ctes(*_SEARCH, top_chunks_sql(10), _RETRIEVED) + _RET_SQL)
def _(spark, sf):
    return retrieved(spark, sf).select("query_id", "job_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@check(
    "J12_question_chunk_similarity",
    with_ctes(*_SEARCH, top_chunks_sql(10)) + "SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM hits",
)
def _(spark, sf):
    hits = E.vector_top_k(views.chunks(spark, sf), views.questions(spark, sf), K.EVAL_MAX_K, THRESHOLD)
    return hits.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@check(
    "W05_best_chunk_per_job",
    with_ctes(*_SEARCH, top_chunks_sql(10), _RETRIEVED) + "SELECT query_id, job_id, chunk_id FROM best",
)
def _(spark, sf):
    return retrieved(spark, sf).select("query_id", "job_id", "chunk_id")


@check("E03_cached_verdicts", with_ctes(*_EVAL) + "SELECT r.query_id, r.job_id, j.verdict FROM ret r LEFT JOIN judg j ON j.judge = 'remote' AND j.query_id = r.query_id AND j.job_id = r.job_id")
def _(spark, sf):
    found = retrieved(spark, sf)
    return E.cached_verdicts(found, judgments(spark, sf, found), "remote").select("query_id", "job_id", "verdict")


@check("J13_unjudged", with_ctes(*_EVAL) + "SELECT query_id, job_id FROM ret WHERE job_id % 9 = 0")
def _(spark, sf):
    found = retrieved(spark, sf)
    return E.unjudged(found, judgments(spark, sf, found), "local").select("query_id", "job_id")


def length_judge(question, title, start):
    """A stand-in for a judge: answers by text lengths, in prose."""
    import pandas as pd

    n = question.str.len() + title.str.len() + start.str.len()
    return pd.Series([("Relevant.", "it is marginal", "not relevant", "hm")[x % 4] for x in n])


@check(
    "E03_judge_misses",
    with_ctes(views.JOBS, *_EVAL)
    + "SELECT 'length' AS judge, r.query_id, r.job_id, CASE (length(q.question) + length(j.title) + least(length(j.company || ' ' || repeat(j.title, 30)), 300)) % 4 "
    "WHEN 0 THEN 'relevant' WHEN 1 THEN 'marginal' ELSE 'not_relevant' END AS verdict "
    "FROM ret r JOIN questions q USING (query_id) JOIN jobs j ON j.id = r.job_id WHERE r.job_id % 9 = 0",
)
def _(spark, sf):
    found = retrieved(spark, sf)
    missing = E.unjudged(found, judgments(spark, sf, found), "local")
    jobs = views.jobs(spark, sf).withColumn("description", F.concat("company", F.lit(" "), F.repeat("title", F.lit(30))))
    return E.judge_pairs(missing, views.questions(spark, sf), jobs, "length", length_judge, rows=10 * 1024)


# ---- metrics -------------------------------------------------------------------------------------


def _round_sql(x: str) -> str:
    return f"floor(({x}) * 1000.0 + 0.5) / 1000.0"


_METRICS = f"""ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
atk AS (SELECT query_id, k, count(*) AS n, count(*) FILTER (WHERE verdict = 'relevant') AS rel, min(rank) FILTER (WHERE verdict = 'relevant') AS first,
 sum(CASE WHEN verdict = 'relevant' THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg FROM judged, ks WHERE rank <= k GROUP BY 1, 2),
scored AS (SELECT query_id, k, n, {_round_sql('rel / n')} AS p, {_round_sql('coalesce(1.0 / first, 0.0)')} AS m,
 {_round_sql('dcg / list_sum(list_transform(range(1, greatest(rel, 1) + 1), lambda i: 1.0 / log2(i + 1.0)))')} AS d FROM atk),
metrics AS (SELECT q.query_id, q.category, ks.k, coalesce(n, 0) AS retrieved, coalesce(p, 0.0) AS precision, coalesce(m, 0.0) AS mrr, coalesce(d, 0.0) AS ndcg
 FROM questions q CROSS JOIN ks LEFT JOIN scored s ON s.query_id = q.query_id AND s.k = ks.k),
vc AS (SELECT q.query_id, count(*) FILTER (WHERE verdict = 'relevant') AS relevant, count(*) FILTER (WHERE verdict = 'marginal') AS marginal,
 count(*) FILTER (WHERE verdict = 'not_relevant') AS not_relevant FROM questions q LEFT JOIN judged j USING (query_id) GROUP BY 1)"""


def _mean_sql(m: str) -> str:
    return f"coalesce(floor(sum(CAST(round({m} * 1000) AS BIGINT)) / count({m}) + 0.5) / 1000.0, 0.0)"


_MEANS = ", ".join(f"{_mean_sql(m)} AS {m}" for m in E.METRICS)


def metrics(spark, sf):
    return E.per_query_metrics(judged(spark, sf), views.questions(spark, sf))


@check("E04_precision_at_k", with_ctes(*_EVAL, _METRICS) + "SELECT query_id, k, retrieved, precision FROM metrics")
def _(spark, sf):
    return metrics(spark, sf).select("query_id", "k", "retrieved", "precision")


@check("E05_mrr_ndcg", with_ctes(*_EVAL, _METRICS) + "SELECT query_id, category, k, mrr, ndcg FROM metrics")
def _(spark, sf):
    return metrics(spark, sf).select("query_id", "category", "k", "mrr", "ndcg")


@check(
    "W08_first_relevant_rank",
    with_ctes(*_EVAL) + "SELECT query_id, CAST(min(rank) FILTER (WHERE verdict = 'relevant') AS INT) AS first_relevant FROM judged GROUP BY 1",
)
def _(spark, sf):
    first = F.min(F.when(F.col("verdict") == "relevant", F.col("rank")))
    return judged(spark, sf).groupBy("query_id").agg(first.alias("first_relevant"))


@check(
    "E06_overall",
    with_ctes(*_EVAL, _METRICS)
    + f"SELECT {_MEANS}, count(*) AS query_count, count(*) FILTER (WHERE retrieved > 0) AS queries_with_results, "
    "count(*) FILTER (WHERE relevant = 0) AS queries_with_zero_relevant, CAST(sum(marginal) AS BIGINT) AS marginal_count FROM metrics JOIN vc USING (query_id) WHERE k = 5",
)
def _(spark, sf):
    found = judged(spark, sf)
    asked = views.questions(spark, sf)
    return E.overall(E.per_query_metrics(found, asked), E.verdict_counts(found, asked))


@check(
    "E07_by_category",
    with_ctes(*_EVAL, _METRICS)
    + f"SELECT category, {_MEANS}, count(query_id) AS count FROM (SELECT unnest(['exact', 'semantic', 'filtering', 'aggregation', 'noisy']) AS category) "
    "LEFT JOIN (SELECT * FROM metrics WHERE k = 5 AND category <> 'noisy') m USING (category) GROUP BY 1",
)
def _(spark, sf):
    """Without the noisy questions: their category is present with zeros."""
    return E.by_category(metrics(spark, sf).filter("category <> 'noisy'"))


@check("E08_by_k", with_ctes(*_EVAL, _METRICS) + f"SELECT k, {_MEANS} FROM metrics GROUP BY 1")
def _(spark, sf):
    return E.by_k(metrics(spark, sf))


@check("E09_verdict_counts", with_ctes(*_EVAL, _METRICS) + "SELECT query_id, relevant, marginal, not_relevant FROM vc")
def _(spark, sf):
    return E.verdict_counts(judged(spark, sf), views.questions(spark, sf))


for _metric in ("precision", "mrr"):
    add(
        f"E10_category_k_{_metric}",
        lambda spark, sf, m=_metric: E.category_k_matrix(metrics(spark, sf), m),
        with_ctes(*_EVAL, _METRICS)
        + "SELECT category, "
        + ", ".join(_mean_sql(f"(CASE WHEN k = {k} THEN {_metric} END)") + f" AS k{k}" for k in K.EVAL_KS)
        + " FROM metrics GROUP BY 1",
    )


@check(
    "E02_report_rows",
    with_ctes(*_EVAL)
    + f"SELECT query_id, CAST(rank AS INT) AS rank, job_id, {_round_sql('similarity')} AS score, verdict FROM judged WHERE rank <= 5",
)
def _(spark, sf):
    return E.top_results(judged(spark, sf))


_LENGTH_JUDGED = (
    "judged AS (SELECT r.*, CASE (length(q.question) + length(j.title) + least(length(j.company || ' ' || repeat(j.title, 30)), 300)) % 4 "
    "WHEN 0 THEN 'relevant' WHEN 1 THEN 'marginal' ELSE 'not_relevant' END AS verdict "
    "FROM ret r JOIN questions q USING (query_id) JOIN jobs j ON j.id = r.job_id)"
)


@check(
    "E00_run_evaluation",
    with_ctes(views.JOBS, *_SEARCH, top_chunks_sql(10), _RETRIEVED, _LENGTH_JUDGED, _METRICS)
    + "SELECT query_id, category, k, retrieved, precision, mrr, ndcg FROM metrics",
)
def _(spark, sf):
    """A whole run on an empty store: one search, every pair judged and stored, all report tables from the stored result."""
    store = Store(spark, f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}")
    jobs = views.jobs(spark, sf).withColumn("description", F.concat("company", F.lit(" "), F.repeat("title", F.lit(30))))
    jobs = jobs.withColumn("id", F.col("id").cast("string"))
    chunks = views.chunks(spark, sf).withColumn("job_id", F.col("job_id").cast("string"))
    report = E.run_evaluation(store, chunks, jobs, views.questions(spark, sf), "length", length_judge, threshold=THRESHOLD)
    return report["per_query"].select("query_id", "category", "k", "retrieved", "precision", "mrr", "ndcg")


# ---- judge agreement -----------------------------------------------------------------------------

# Pools: a question's candidates are the postings of its label, best first by id.
_POOLS = "pools AS (SELECT q.query_id, q.position, l.job_id FROM questions q JOIN lab l ON l.label = q.label)"
_SAMPLES = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY job_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY job_id DESC) AS z,
 count(*) OVER (PARTITION BY query_id) AS n FROM pools),
samples AS (SELECT query_id, CAST(job_id AS VARCHAR) AS job_id, job_id AS pool_job_id, 'top' AS tier FROM r WHERE a <= 2
 UNION ALL SELECT query_id, CAST(job_id AS VARCHAR), job_id, 'bottom' FROM r WHERE z <= 2 AND n > 2
 UNION ALL SELECT q.query_id, 'cross_' || r.job_id, r.job_id, 'cross' FROM questions q JOIN r ON r.position = (q.position + 1) % (SELECT count(*) FROM questions) WHERE r.a <= 2)"""
_CALIBRATION = (views.CHUNKS, views.QUESTIONS, _JUDGMENTS, _POOLS, _SAMPLES)
_CROSS_JUDGE = (
    "pairs AS (SELECT s.query_id, s.job_id, s.tier, a.verdict AS local, b.verdict AS remote FROM samples s "
    "JOIN judg a ON a.judge = 'local' AND a.query_id = s.query_id AND a.job_id = s.pool_job_id "
    "JOIN judg b ON b.judge = 'remote' AND b.query_id = s.query_id AND b.job_id = s.pool_job_id)"
)


def pools(spark, sf):
    first = views.chunks(spark, sf).groupBy("job_id").agg(F.min_by("label", "chunk_id").alias("label"))
    return first.join(views.questions(spark, sf).select("label", "query_id"), "label").select("query_id", "job_id")


def samples(spark, sf):
    order = ([F.asc("job_id")], [F.desc("job_id")])
    return C.sample(pools(spark, sf), views.questions(spark, sf).select("query_id", "position"), *order)


def paired(spark, sf):
    drawn = samples(spark, sf)
    known = judgments(spark, sf, drawn.select("query_id", F.col("pool_job_id").alias("job_id")))
    names = drawn.select("query_id", "job_id", "pool_job_id").distinct()
    sampled = known.withColumnRenamed("job_id", "pool_job_id").join(names, ["query_id", "pool_job_id"])
    return C.paired_verdicts(drawn, sampled.drop("pool_job_id"), "local", "remote")


@check(
    "W09_head_and_tail",
    with_ctes(*_CALIBRATION) + "SELECT query_id, pool_job_id AS job_id, tier FROM samples WHERE tier <> 'cross'",
)
def _(spark, sf):
    top, bottom = head_and_tail(pools(spark, sf), ["query_id"], [F.asc("job_id")], [F.desc("job_id")], 2)
    return top.withColumn("tier", F.lit("top")).unionByName(bottom.withColumn("tier", F.lit("bottom")))


@check("E11_calibration_sample", with_ctes(*_CALIBRATION) + "SELECT * FROM samples")
def _(spark, sf):
    return samples(spark, sf)


@check("J15_next_question_pool", with_ctes(*_CALIBRATION) + "SELECT query_id, pool_job_id FROM samples WHERE tier = 'cross'")
def _(spark, sf):
    return samples(spark, sf).filter("tier = 'cross'").select("query_id", "pool_job_id")


@check("J14_paired_verdicts", with_ctes(*_CALIBRATION, _CROSS_JUDGE) + "SELECT query_id, job_id, tier, local, remote FROM pairs")
def _(spark, sf):
    return paired(spark, sf).select("query_id", "job_id", "tier", "local", "remote")


@check(
    "E12_agreement",
    with_ctes(*_CALIBRATION, _CROSS_JUDGE)
    + f"SELECT count(*) AS sample_size, {_round_sql('count(*) FILTER (WHERE local = remote) / count(*)')} AS agreement FROM pairs",
)
def _(spark, sf):
    return C.agreement(paired(spark, sf))


@check(
    "E12_agreement_by_tier",
    with_ctes(*_CALIBRATION, _CROSS_JUDGE)
    + f"SELECT tier, count(query_id) AS total, count(query_id) FILTER (WHERE local = remote) AS agreed, "
    f"coalesce({_round_sql('count(query_id) FILTER (WHERE local = remote) / nullif(count(query_id), 0)')}, 0.0) AS agreement "
    "FROM (SELECT unnest(['top', 'bottom', 'cross']) AS tier) LEFT JOIN (SELECT * FROM pairs WHERE tier <> 'bottom') USING (tier) GROUP BY 1",
)
def _(spark, sf):
    """Without the bottom samples: their tier is present with zeros."""
    return C.agreement_by_tier(paired(spark, sf).filter("tier <> 'bottom'"))


@check(
    "E13_confusion_matrix",
    with_ctes(*_CALIBRATION, _CROSS_JUDGE)
    + "SELECT local, "
    + ", ".join(f"count(*) FILTER (WHERE remote = '{v}') AS {v}" for v in K.VERDICTS)
    + " FROM (SELECT unnest(['relevant', 'marginal', 'not_relevant']) AS local) LEFT JOIN pairs USING (local) GROUP BY 1",
)
def _(spark, sf):
    return C.confusion_matrix(paired(spark, sf))


@check(
    "E14_disagreements",
    with_ctes(*_CALIBRATION, _CROSS_JUDGE) + "SELECT query_id, job_id, tier, local, remote FROM pairs WHERE local <> remote",
)
def _(spark, sf):
    return C.disagreements(paired(spark, sf))


@check(
    "A23_judgments_by_judge",
    with_ctes(views.CHUNKS, views.QUESTIONS, _JUDGMENTS, _POOLS)
    + "SELECT judge, count(*) AS judgments FROM judg JOIN pools USING (query_id, job_id) GROUP BY 1",
)
def _(spark, sf):
    from tallywork.sinks.tables import judgment_counts

    return judgment_counts(judgments(spark, sf, pools(spark, sf)))
