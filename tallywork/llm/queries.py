"""The operators as queries over the test tables, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import (
    attribution,
    binary,
    bytebpe,
    collocations,
    html,
    importance,
    jaccard,
    langid,
    licences,
    mixing,
    quality,
    topk,
    urls,
)
from tallywork.llm.common import settings
from tallywork.session import shared_folder
from tallywork.sources.tables import scan

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(settings(spark), f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every sentence of every document."""
    return attribution.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # products of whole numbers are exact
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.filter(F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("vector"))
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    binary.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return binary.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bytebpe.encode_and_decode(table(spark, sf_dir, "documents"), path)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark texts, 5 % of those of 20 words drawn."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of the documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


URL_RULES = [
    urls.Rule(urls.ALLOW, "com", "/"),
    urls.Rule(urls.BLOCK, "example.com", "/en/"),
    urls.Rule(urls.ALLOW, "www.example.com", "/en/"),
    urls.Rule(urls.BLOCK, "net", "/es/"),
    urls.Rule(urls.BLOCK, "net", "/fr/"),
]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urls of all pages by five rules; urls that none fits are allowed."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_attribution": op1_token_attribution,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_main_text": op4_main_text,
    "op5_token_files": op5_token_files,
    "op6_licence_scan": op6_licence_scan,
    "op7_source_mix": op7_source_mix,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_url_filters": op13_url_filters,
}

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS stop FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
   - coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER ()
   - coalesce(sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(stop, weight * max(level) OVER ()) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 1000000000) ELSE 0 END::HUGEINT AS expected,
 (('0x' || substr(md5(coalesce(source, '') || '/7'), 1, 8))::BIGINT % 1000000000)::HUGEINT AS start FROM t),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(log2(size + 1) * 8),
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/7'), 1, 8))::BIGINT % 256, doc_id NULLS FIRST, size)::HUGEINT AS place FROM d)
SELECT g.doc_id, g.size, e.source_size, e.target,
 (((place * expected + start) // 1000000000 - ((place - 1) * expected + start) // 1000000000) * g.size)::BIGINT AS taken
FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source
"""
_RUNGS = ", ".join(
    f"('{rule.name}', {step}, {cutoff}::DOUBLE)" for rule in quality.RULES for step, cutoff in enumerate(rule.cutoffs)
)
_FAILS = " ".join(
    f"WHEN rule = '{rule.name}' THEN {rule.part} / nullif({rule.whole}, 0) {'>' if rule.above else '<'} cutoff" for rule in quality.RULES
)
OP8_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
 list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w),
v AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + 4]) AS n FROM p),
c AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM v WHERE n > 1) GROUP BY rid),
f AS (SELECT w.rid, doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
 FROM w LEFT JOIN c ON c.rid = w.rid),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
a AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
g AS (SELECT * EXCLUDE (turn) FROM (SELECT b.*, quality, row_number() OVER (PARTITION BY b.doc_id ORDER BY n_words, word_chars, n_symbols, n_lines,
 n_dup_lines, n_repeat_words, stratum NULLS FIRST) AS turn FROM b JOIN a ON a.doc_id = b.doc_id WHERE NOT base_failed) WHERE turn = 1),
rungs AS (SELECT * FROM (VALUES {_RUNGS}) AS x(rule, step, cutoff)),
k AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS n,
 count(*) FILTER (quality = 1 AND (CASE {_FAILS} END)) AS good_out, count(*) FILTER (quality = 0 AND (CASE {_FAILS} END)) AS poor_out
 FROM g, rungs GROUP BY ALL),
m AS (SELECT *, CASE WHEN n = 0 OR good_out >= n * {quality.ALPHA} THEN 1 ELSE
 (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.ALPHA}) + (n - i) * ln(1 - {quality.ALPHA})))
  FROM (SELECT unnest(range(0, good_out + 1)) AS i)) END AS p_value FROM k),
q AS (SELECT *, bool_and(p_value <= {quality.DELTA} / ({len(quality.RULES)} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM g))))
 OVER (PARTITION BY stratum, rule ORDER BY step) AS certified FROM m),
s AS (SELECT stratum, rule, arg_max(cutoff, (poor_out - {quality.COST} * good_out) * 1000 - step) AS cutoff FROM q
 WHERE certified AND poor_out > {quality.COST} * good_out GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT EXISTS (SELECT 1 FROM s WHERE s.stratum IS NOT DISTINCT FROM b.stratum AND coalesce((CASE {_FAILS} END), false)) AS kept FROM b
"""
OP2_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vector FROM embeddings
 WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
p AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.vector) = 0 THEN 0 ELSE list_inner_product(q.vector, c.vector) END::BIGINT AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS NOT NULL AND c.place <> q.place AND len(q.vector) = len(c.vector))
SELECT query_id, rank::INT AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LONGEST, _LEAST = collocations.Mining.longest, collocations.Mining.least
OP12_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_ALPHABET}) AS text FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, words[i:i + k - 1] AS words, k, count(*) AS f
 FROM s, (SELECT unnest(range(1, {_LONGEST + 1})) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL),
f AS (SELECT lang, words, k, f, array_to_string(words, ' ') AS phrase FROM g WHERE f >= {_LEAST}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, words, k, phrase, f AS a FROM f WHERE k >= 2),
o AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c b ON s.lang = b.lang AND b.k > s.k
 AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= {collocations.Mining.drop_percent} * s.a),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c ANTI JOIN o USING (lang, phrase)),
x AS (SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * u.a * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score
 FROM u JOIN f l ON l.lang = u.lang AND l.words = u.words[1:cut] JOIN f r ON r.lang = u.lang AND r.words = u.words[cut + 1:] JOIN n ON n.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM x)
SELECT lang, rank, phrase, a, l, r, n, score FROM
 (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1) WHERE rank <= {collocations.Mining.top}
"""
_RULES = ", ".join(f"('{rule.verdict}', '{rule.host}', '{rule.path}')" for rule in URL_RULES)
OP13_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_ALPHABET}) AS host,
 regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES {_RULES}) AS x(verdict, rule_host, rule_path)),
f AS (SELECT rid, arg_max(rule_host || rule_path, length(rule_host) * 100000 + length(rule_path)) AS rule,
 arg_max(verdict, length(rule_host) * 100000 + length(rule_path)) AS verdict
 FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (rid)
"""
SQL: dict[str, str] = {"op2_exact_top_k": OP2_SQL, "op7_source_mix": OP7_SQL, "op8_quality_rules": OP8_SQL, "op12_phrase_collocations": OP12_SQL, "op13_url_filters": OP13_SQL}
