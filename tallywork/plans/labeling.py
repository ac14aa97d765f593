"""Candidate labels: which postings match an evaluation question's keywords, and how well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.text import WORD, label_warning
from tallywork.operators.joins import bounded_join, hot_key_join, row_bound
from tallywork.operators.ranking import top_per_key

_TOKEN = f"{WORD}+"
_ALNUM = "^[a-z0-9]"
# Stands before the first sign of a keyword without letters or digits, where others have their first token.
_SIGN = "\x00"
# Up to so many first tokens are looked for before the places in a text become rows.
MOST_KEYS = 1024


# ---- phrases -------------------------------------------------------------------------------------


def keyword_table(queries: DataFrame) -> DataFrame:
    """(query_id, n_groups, g, keyword): the AND groups of OR keywords; without groups the expected keywords are the only one."""
    groups = F.when(F.coalesce(F.size("keyword_groups"), F.lit(0)) > 0, F.col("keyword_groups")).otherwise(F.array("expected_keywords"))
    rows = queries.select(F.col("id").alias("query_id"), F.size(groups).alias("n_groups"), F.posexplode(groups).alias("g", "keywords"))
    rows = rows.select("query_id", "n_groups", "g", F.explode("keywords").alias("keyword")).withColumn("keyword", F.lower("keyword"))
    return rows.filter("keyword <> ''").distinct()


def phrase_parts(keywords: DataFrame) -> DataFrame:
    """Adds what a `keyword` is made of: `key` (its first token), `lead` and `tail` (signs before and behind), `further` tokens and the
    signs `between` them."""
    tokens, signs = F.regexp_extract_all("keyword", F.lit(f"({_TOKEN})"), F.lit(1)), F.split("keyword", _TOKEN, -1)
    n = F.size(tokens)
    return keywords.select(
        "*",
        F.when(n > 0, F.get(tokens, F.lit(0))).otherwise(F.concat(F.lit(_SIGN), F.substring("keyword", 1, 1))).alias("key"),
        F.get(signs, F.lit(0)).alias("lead"),
        F.when(n > 0, F.get(signs, n)).otherwise(F.lit("")).alias("tail"),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("further"),
        F.slice(signs, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("between"),
    )


def _places(texts: DataFrame, longest: int, wanted: list[str] | None = None) -> DataFrame:
    """Every token of a `text` (lowered) with what stands around it: `key`, `before` (signs, null at the start), `tokens` and `signs`
    behind it, as many as the longest keyword has. Signs that follow a token have a place of their own under their first one.

    With the keys that are `wanted` only their places become rows.
    """
    split = texts.withColumns({"_t": F.regexp_extract_all("text", F.lit(f"({_TOKEN})"), F.lit(1)), "_s": F.split("text", _TOKEN, -1)})
    kept = [c for c in texts.columns if c != "text"]

    def place(key: Column, at: Column) -> list[Column]:
        further = [F.slice(c, at + 2, F.lit(longest)) for c in ("_t", "_s")]
        return [key.alias("key"), F.when(at > 0, F.get("_s", at)).alias("before"), further[0].alias("tokens"), further[1].alias("signs")]

    if wanted is None:
        tokens = split.select(*kept, "_t", "_s", F.posexplode("_t").alias("at", "key")).select(*kept, *place(F.col("key"), F.col("at")))
    else:
        at = F.array_compact(F.transform("_t", lambda t, i: F.when(t.isin(wanted), i)))
        found = split.select(*kept, "_t", "_s", at.alias("_at")).filter(F.size("_at") > 0)
        # not exploded beside the arrays, which would be copied for every place
        places = F.transform("_at", lambda i: F.struct(*place(F.get("_t", i), i)))
        tokens = found.select(*kept, F.explode(places).alias("p")).select(*kept, "p.*")
        if not any(key.startswith(_SIGN) for key in wanted):
            return tokens
    # blanks begin no keyword
    behind = F.slice("_s", F.lit(2), F.size("_s"))

    def sign(s: Column, i: Column) -> Column:
        named = F.struct(s.alias("before"), F.coalesce(F.get("_t", i + 1).rlike(_ALNUM), F.lit(False)).alias("runs_on"))
        return named if wanted is None else F.when(_sign_key(s).isin(wanted), named)

    follow = F.transform(behind, sign) if wanted is None else F.array_compact(F.transform(behind, sign))
    signs = split.select(*kept, F.explode(F.array_distinct(F.filter(follow, lambda f: f["before"].rlike(r"^\S")))).alias("f"))
    signs = signs.select(
        *kept,
        _sign_key(F.col("f.before")).alias("key"),
        F.col("f.before").alias("before"),
        F.when(F.col("f.runs_on"), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("tokens"),
        F.array().cast("array<string>").alias("signs"),
    )
    return tokens.unionByName(signs)


def _sign_key(signs: Column) -> Column:
    return F.concat(F.lit(_SIGN), F.substring(signs, 1, 1))


def _stands_here() -> Column:
    """Whether the keyword of a joined row stands at its place. The same as `keyword_regex`: signs at its start follow a token at once,
    signs at its end may not run on into a letter or digit."""
    n, tail = F.size("further"), F.col("tail")

    def ends(signs: Column, wanted: Column, behind: Column) -> Column:
        longer = F.length(signs) > F.length(wanted)
        return signs.startswith(wanted) & (longer | ~F.coalesce(behind.rlike(_ALNUM), F.lit(False)))

    led = (F.col("lead") == "") | F.coalesce(F.col("before") == F.col("lead"), F.lit(False))
    middle = (F.slice("tokens", F.lit(1), n) == F.col("further")) & (F.slice("signs", F.lit(1), n) == F.col("between"))
    closed = (tail == "") | F.coalesce(ends(F.get("signs", n), tail, F.get("tokens", n)), F.lit(False))
    bare = ends(F.col("before"), F.col("lead"), F.get("tokens", F.lit(0)))
    return F.when(F.col("key").startswith(_SIGN), F.coalesce(bare, F.lit(False))).otherwise(led & middle & closed)


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """The columns of `texts` but `text` (lowered), with each `keyword` that stands in it as whole tokens.

    Texts are cut into tokens once and meet the keywords on their first token; a phrase is checked on the neighbours that come along,
    so no text is shuffled or read again. Few keywords go to the tasks; many meet the tokens in a shuffle of these alone. With at most
    MOST_KEYS first tokens, the places of all others are dropped inside the text, before they are rows.
    """
    known = phrase_parts(keywords.select("keyword").distinct())
    longest = known.agg(F.max(F.size("further"))).first()[0]
    if longest is None:
        return texts.drop("text").withColumn("keyword", F.lit("")).limit(0)
    keys = [row["key"] for row in known.select("key").distinct().limit(MOST_KEYS + 1).collect()]
    places = _places(texts, longest + 1, keys if len(keys) <= MOST_KEYS else None)
    few = row_bound(known)
    if few is not None:
        met = bounded_join(places, known, "key", "inner", few)
    else:
        met = hot_key_join(places, known, "key", "inner", ["tokens", "before"])
    return met.filter(_stands_here()).select(*[c for c in texts.columns if c != "text"], "keyword")


def scores(jobs: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, created_at if there is one, query_id, score): 2 points per group for a title, else 1 for a description; all groups must
    be met."""
    carried = [c for c in ("id", "created_at") if c in jobs.columns]
    keywords = keyword_table(queries)
    parts = F.array(
        F.struct(F.lit(2).alias("points"), F.lower("title").alias("text")), F.struct(F.lit(1).alias("points"), F.lower("description").alias("text"))
    )
    texts = jobs.select(*carried, F.explode(parts).alias("t")).select(*carried, "t.points", "t.text")
    hits = keyword_hits(texts, keywords)
    met = bounded_join(hits, keywords, "keyword", "inner", row_bound(keywords))
    best = met.groupBy(*carried, "query_id", "n_groups", "g").agg(F.max("points").alias("points"))
    summed = best.groupBy(*carried, "query_id", "n_groups").agg(F.count(F.lit(1)).alias("met"), F.sum("points").cast("int").alias("score"))
    return summed.filter("met = n_groups").select(*carried, "query_id", "score")


def _caps(queries: DataFrame) -> DataFrame:
    return queries.select(
        F.col("id").alias("query_id"), "min_relevant", F.coalesce("max_relevant", F.lit(K.LABEL_CAP)).alias("cap")
    )


def label_candidates(jobs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score, rank): matching postings per question, best score first, up to the question's cap.

    Ties go to the newest posting where there is a created_at, then to the lower id. `jobs` has id, title, description.
    """
    scored = scores(jobs, queries)
    most = queries.agg(F.max(F.coalesce("max_relevant", F.lit(K.LABEL_CAP)))).first()[0]
    newest = [F.desc_nulls_last("created_at")] if "created_at" in scored.columns else []
    ranked = top_per_key(scored, ["query_id"], [F.desc("score"), *newest, F.asc("id")], most or K.LABEL_CAP, rank="rank")
    capped = bounded_join(ranked, _caps(queries), "query_id", "inner", row_bound(queries)).filter(F.col("rank") <= F.col("cap"))
    return capped.select("query_id", "id", "score", "rank")


def label_summary(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, label_count, label_warning) for every question, also those without a match."""
    counts = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _caps(queries).join(counts, "query_id", "left").withColumn("label_count", F.coalesce("n", F.lit(0)))
    return rows.select(
        "query_id",
        "label_count",
        label_warning(F.col("label_count"), F.col("min_relevant"), F.col("cap")).alias("label_warning"),
    )


def labelled_postings(candidates: DataFrame, jobs: DataFrame, rows: int | None = None) -> DataFrame:
    """Candidates with title and description, fetched after ranking. `rows` bounds the candidates, if known."""
    return bounded_join(jobs.select("id", "title", "description"), candidates, "id", "inner", rows)
