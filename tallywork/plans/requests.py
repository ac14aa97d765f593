"""Any number of statistics and compound filters at once: requests are a table, joined to the postings by what they ask for.

Patterns meet the distinct values of a column and not the postings. A pattern without wildcards is found by the value itself, any other
by the first letters of its longest stretch without wildcards, which are among the stretches of every value it can match; what meets
is then compared in full. Patterns without such a stretch meet all values, in blocks. Of a request's conditions the one with the
fewest postings fetches them, the others are checked on the rows, and only the first rows of each request go on. Postings are looked
at from the first on, in rounds that grow, by the requests that still lack some. So the plan has one size for all numbers of requests,
no request is looped over, and no id passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.operators.filters import LISTING
from tallywork.operators.ranking import top_n, top_per_key
from tallywork.plans.analytics import TEMPLATES, mean_of, run_template
from tallywork.session import cut_lineage, shared_folder

# Lengths of the stretches that patterns are found by, the longest that fits first.
STRETCHES = (8, 5, 3)
# Patterns compared with a value at a time.
BLOCK = 256
# Copies of the patterns that meet every value, so that these are spread over tasks.
SALTS = 16
# Postings that the first round looks at, and how many times as many the next one does.
FIRST_ROUND, GROWTH = 1024, 8
# Stretches of upper ends of salaries.
STRETCHES_OF_PAY = 256
TEXTS = ("title", "company", "location", "job_type")
CONDITIONS = (*TEXTS, "skill", "low", "high")

# Template to the condition its first parameters fill; the others have no parameters.
_FILLED = {
    "list_jobs_by_title": ("title",),
    "list_jobs_by_location": ("location",),
    "list_jobs_by_company": ("company",),
    "list_jobs_by_type": ("job_type",),
    "list_jobs_by_skill": ("skill",),
    "jobs_above_salary": ("low",),
    "jobs_between_salary": ("low", "high"),
    "salary_stats_by_title": ("title",),
    "list_distinct_titles": ("title",),
    "list_distinct_companies": ("company",),
}
_NEWEST = [name for name in _FILLED if name.startswith("list_jobs")]
LISTED, FILTERED, DISTINCT = 20, 30, 30  # rows of an answer


# A backslash stands before a wildcard or another one.
_PATTERN = r"(?s)^(?:[^\\]|\\[%_\\])*$"


def _like(value: Column, pattern: Column) -> Column:
    """ILIKE with patterns that are data: one that is none, as a backslash ends it or stands before a letter, matches nothing."""
    return F.when(pattern.rlike(_PATTERN), F.ilike(value, pattern)).otherwise(F.lit(False))


# ---- patterns and values -------------------------------------------------------------------------


def like_pairs(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(column, value, pattern) for distinct (column, value) and (column, pattern): value ILIKE pattern. Nulls match nothing."""
    low = F.lower("pattern")
    runs = F.transform(F.regexp_extract_all(low, F.lit(r"((?:[^%_\\]|\\.)+)"), F.lit(1)), lambda r: F.regexp_replace(r, r"\\(.)", "$1"))
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"], F.lit(""))
    key = F.when(~low.rlike(r"(?s)^(?:\\.|[^%_\\])*[%_]"), F.concat(F.lit("="), F.array_join(runs, "")))
    for size in STRETCHES:
        key = key.when(F.length(longest) >= size, F.concat(F.lit(f"{size}:"), F.substring(longest, 1, size)))
    known = patterns.filter(F.col("pattern").isNotNull()).withColumn("key", key.otherwise(F.lit("*")))
    # the patterns of a key in arrays of about BLOCK at most, whatever their number
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks")
    sizes = known.groupBy("column", "key").agg(blocks)
    known = known.join(sizes, ["column", "key"]).withColumn("_block", F.pmod(F.xxhash64("pattern"), F.col("_blocks")))
    known = known.groupBy("column", "key", "_block").agg(F.collect_list("pattern").alias("patterns")).drop("_block")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copies = F.when(F.col("key") == "*", F.transform(every, lambda s: F.concat(F.lit("*"), s.cast("string")))).otherwise(F.array("key"))
    known = known.withColumn("key", F.explode(copies))

    value = F.lower("value")

    def stretches(size: int) -> Column:
        at = F.sequence(F.lit(1), F.length(value) - (size - 1))
        cut = F.transform(at, lambda i: F.concat(F.lit(f"{size}:"), F.substring(value, i, F.lit(size))))
        return F.when(F.length(value) >= size, cut).otherwise(F.array().cast("array<string>"))

    salt = F.concat(F.lit("*"), F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("string"))
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("="), value), salt), *map(stretches, STRETCHES)))
    keyed = values.filter(F.col("value").isNotNull()).select("column", "value", F.explode(keys).alias("key"))
    met = keyed.join(known, ["column", "key"])
    matching = F.filter("patterns", lambda p: _like(F.col("value"), p))
    return met.select("column", "value", F.explode(matching).alias("pattern"))


def _long(rows: DataFrame, names: tuple[str, ...], alias: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(alias)) for c in names]))


def without_empty(requests: DataFrame) -> DataFrame:
    """Empty conditions count as not given, as in a compound filter."""
    return requests.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in (*TEXTS, "skill")})


def _conditions(requests: DataFrame) -> DataFrame:
    """(request, column, pattern): the text conditions of all requests."""
    asked = requests.select("request", _long(requests, (*TEXTS, "skill"), "pattern").alias("c")).select("request", "c.*")
    return asked.filter("pattern IS NOT NULL")


def matching_values(jobs: DataFrame, conditions: DataFrame) -> DataFrame:
    """The distinct conditions: `column`, `pattern`, `value` (of the postings) and `n` postings with it.

    A skill is asked for the other way round: the posting's skill is the pattern.
    """
    counted = jobs.select(_long(jobs, TEXTS, "value").alias("c")).select("c.*").filter("value IS NOT NULL")
    counted = counted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    skills = jobs.select(F.explode(F.array_distinct("skills")).alias("value")).filter("value IS NOT NULL")
    skills = skills.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit("skill").alias("column"), "value", "n")
    wanted = conditions.select("column", "pattern").distinct()
    texts = like_pairs(counted.select("column", "value"), wanted.filter("column <> 'skill'"))
    turned = like_pairs(
        wanted.filter("column = 'skill'").withColumnRenamed("pattern", "value"), skills.select("column", F.col("value").alias("pattern"))
    ).select("column", F.col("pattern").alias("value"), F.col("value").alias("pattern"))
    return texts.unionByName(turned).join(counted.unionByName(skills), ["column", "value"])


def matches(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """The text conditions of all requests: `request`, `column`, `pattern`, `value` (of the postings) and `n` postings with it."""
    asked = _conditions(requests)
    return asked.join(matching_values(jobs, asked), ["column", "pattern"])


# ---- postings of requests ------------------------------------------------------------------------


def first_of(jobs: DataFrame, requests: DataFrame, order: list[Column], n: int, found: DataFrame | None = None) -> DataFrame:
    """The first `n` postings in `order` that meet all conditions of a request: its columns, `job` and `pos` from 1.

    `requests` has a `request` that tells them apart and CONDITIONS: patterns for ILIKE, a skill, and bounds inside which a posting's
    range must lie; conditions that are null are not asked for. A request without any has no postings. `found` are the matches of the
    requests if they are known.

    The postings are stored in `order` and looked at in rounds, each GROWTH times as many as before. A request that has its `n` is left
    out of the further rounds, so that it meets a few times `n` postings and not all that fit. Requests with the same conditions are one
    kind, and kinds with the same texts, which differ in their bounds, fetch their postings together.
    """
    spark = jobs.sparkSession
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"

    def step(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    texts = (*TEXTS, "skill")
    given = F.size(F.array_compact(F.array(*texts)))
    narrow = jobs.select("id", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), "fetched_at", *LISTING)
    stored = step(narrow.sort(*order).withColumn("place", F.monotonically_increasing_id()), "postings")
    # one row per task of the sort; a place is its number and the position in it
    parts = stored.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)), F.max("min_salary"), F.min("max_salary"))
    parts = sorted(parts.collect())
    most = max((float(p[2]) for p in parts if p[2] is not None), default=None)
    least = min((float(p[3]) for p in parts if p[3] is not None), default=None)

    asked = requests.select(*CONDITIONS).filter(F.coalesce(*[F.col(c).cast("string") for c in CONDITIONS]).isNotNull()).distinct()
    groups = step(asked.select(*texts).distinct().select("*", _same(*texts).alias("_texts"), F.monotonically_increasing_id().alias("group")), "groups")
    kinds = asked.select("*", _same(*texts).alias("_texts"), _same(*CONDITIONS).alias("_kind")).join(groups.select("_texts", "group"), "_texts")
    kinds = step(kinds.select("_kind", "group", "low", "high").withColumn("kind", F.monotonically_increasing_id()), "kinds")

    conditions = _conditions(groups.withColumnRenamed("group", "request"))
    pairs = matching_values(stored, conditions) if found is None else found.select("column", "pattern", "value", "n").distinct()
    met = step(conditions.join(pairs, ["column", "pattern"]).withColumnRenamed("request", "group"), "matches")
    # of the conditions the one with the fewest postings; without any for one of them there is no answer
    sums = met.groupBy("group", "column").agg(F.sum("n").alias("n"))
    rarest = sums.groupBy("group").agg(F.min_by("column", F.struct("n", "column")).alias("column"), F.count(F.lit(1)).alias("_met"))
    by_text = groups.join(rarest, "group").filter(F.col("_met") == given).select("group", *texts, "column")
    by_text = step(by_text.join(met.select("group", "column", "value"), ["group", "column"]), "by_text")
    bare = groups.filter(given == 0).select("group")

    possible = by_text.select("group").distinct().unionByName(bare)
    left = kinds.select("kind", "group", "low", "high").join(possible, "group", "left_semi")
    left = left.filter(F.col("low").isNull() | (F.col("low") <= F.lit(most).cast("double")))
    left = step(left.filter(F.col("high").isNull() | (F.col("high") >= F.lit(least).cast("double"))), "left")

    total, begin, size, rounds = sum(p[1] for p in parts), 0, FIRST_ROUND, 0
    places = spark.createDataFrame([], "kind BIGINT, place BIGINT")
    while begin < total and not left.isEmpty():
        rows = stored.filter((F.col("place") >= _place(parts, begin)) & (F.col("place") < _place(parts, begin + size)))
        best = top_per_key(_met_in(rows, left, by_text, bare), ["kind"], [F.asc("place")], n)
        best.write.parquet(f"{folder}/places/round={rounds}")
        places = spark.read.schema("kind BIGINT, place BIGINT, round INT").parquet(f"{folder}/places").drop("round")
        begin, size, rounds = begin + size, size * GROWTH, rounds + 1
        if begin < total:
            done = places.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
            left = step(left.join(done, "kind", "left_anti"), f"left_{rounds}")

    best = top_per_key(places, ["kind"], [F.asc("place")], n)
    # equal rows of a request stand for one each, and with texts for one per pair of them, of which no more than n are of use
    rows = requests.filter((given == 0) | F.col("request").isNotNull()).groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("_times"))
    times = F.least(F.when(given > 0, F.col("_times") * F.col("_times")).otherwise(F.col("_times")), F.lit(n)).cast("int")
    rows = rows.withColumn("_times", F.explode(F.array_repeat(F.lit(0), times))).withColumn("_kind", _same(*CONDITIONS))
    rows = rows.join(kinds.select("_kind", "kind"), "_kind").drop("_kind", "_times").join(best, "kind").drop("kind")
    rows = top_per_key(rows, ["request"], [F.asc("place")], n, rank="pos")
    wanted = stored.select("place", F.struct(*narrow.columns).alias("job"))
    return rows.join(wanted, "place").select(*requests.columns, "job", "pos")


def _same(*columns: str) -> Column:
    """Equal for rows that are equal in these columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _place(parts: list, position: int) -> int:
    """The place of the posting at a position from 0, behind all places if there is none."""
    for part, count, *_ in parts:
        if position < count:
            return (part << 33) + position
        position -= count
    return 1 << 62


def _met_in(jobs: DataFrame, kinds: DataFrame, by_text: DataFrame, bare: DataFrame) -> DataFrame:
    """(kind, place): every one of these postings for every kind whose conditions it meets.

    Texts are looked at once per group. Groups of more than BLOCK kinds have their postings spread over SALTS tasks, each with a copy of
    the kinds. `bare` is the group without texts, if there is one.
    """
    many = F.count(F.lit(1))
    sizes = kinds.groupBy("group").agg(F.ceil(many / BLOCK).alias("_blocks"), F.when(many > BLOCK, SALTS).otherwise(1).alias("_salts"))
    blocks = kinds.join(sizes, "group").withColumn("_block", F.pmod(F.xxhash64("kind"), F.col("_blocks")))
    blocks = blocks.groupBy("group", "_salts", "_block").agg(F.collect_list(F.struct("kind", "low", "high")).alias("kinds"))
    blocks = blocks.select("group", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "kinds")

    values = F.concat(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in TEXTS]),
        F.transform(F.array_distinct("skills"), lambda s: F.struct(F.lit("skill").alias("column"), s.alias("value"))),
    )
    pay = ["place", "min_salary", "max_salary"]
    job = F.struct(*pay, *TEXTS, "skills").alias("job")
    met = jobs.select(job, F.explode(values).alias("c")).select("job", "c.*").join(by_text.join(sizes, "group"), ["column", "value"])
    # more than one skill of a posting may meet the one asked for
    first = F.get(F.filter(F.col("job.skills"), lambda s: _like(F.col("skill"), s)), 0)
    met = met.filter((F.col("column") != "skill") | (F.col("value") == first))
    checks = [F.col(c).isNull() | (F.col("column") == c) | F.coalesce(_like(F.col(f"job.{c}"), F.col(c)), F.lit(False)) for c in TEXTS]
    skilled = F.col("skill").isNull() | F.exists(F.col("job.skills"), lambda s: _like(F.col("skill"), s))
    met = met.filter(reduce(Column.__and__, [*checks, skilled])).select("group", "_salts", *[f"job.{c}" for c in pay])
    alone = jobs.filter("min_salary IS NOT NULL OR max_salary IS NOT NULL").select(*pay)
    alone = alone.crossJoin(F.broadcast(bare.join(sizes, "group"))).select(*met.columns)  # one row at most

    spread = met.unionByName(alone).withColumn("_salt", F.pmod(F.xxhash64("place"), F.col("_salts")).cast("int"))
    rows = spread.join(blocks, ["group", "_salt"]).select(*pay, F.explode("kinds").alias("k"))
    return rows.filter(_within(F.struct("min_salary", "max_salary"), F.col("k.low"), F.col("k.high"))).select("k.kind", "place")


def _within(job: Column, low: Column, high: Column) -> Column:
    from_low = low.isNull() | F.coalesce(job["min_salary"] >= low, F.lit(False))
    return from_low & (high.isNull() | F.coalesce(job["max_salary"] <= high, F.lit(False)))


def newest_of(jobs: DataFrame, requests: DataFrame, n: int, found: DataFrame | None = None) -> DataFrame:
    """The `n` newest postings of each request: its columns, `job` and `pos` from 1."""
    return first_of(jobs, requests, [F.desc_nulls_last("fetched_at"), F.asc("id")], n, found)


def best_paid_between(jobs: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """The `n` best paid postings inside the bounds (`low`, `high`) of each request: its columns, `job` and `pos` from 1.

    A lower bound only cuts the end of what the upper one allows, so the best are found per upper bound: those of all stretches of
    upper ends below its own, each reduced to its best `n`, and those of its own stretch one by one.
    """
    order = [F.desc("min_salary"), F.asc("id")]
    paid = jobs.filter("min_salary IS NOT NULL AND max_salary IS NOT NULL").select("id", *LISTING)
    ends = cut_lineage(top_per_key(paid, ["max_salary"], order, n))
    shares = [i / STRETCHES_OF_PAY for i in range(1, STRETCHES_OF_PAY)]
    cuts = sorted(set(ends.agg(F.percentile_approx("max_salary", shares)).first()[0] or []))

    def stretch(value: str) -> Column:
        return F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col(value)))

    ends = ends.withColumn("stretch", stretch("max_salary"))
    highs = requests.select("high").filter("high IS NOT NULL").distinct().withColumn("stretch", stretch("high"))
    below = top_per_key(ends, ["stretch"], order, n).filter(F.col("stretch") < len(cuts))
    below = below.withColumn("stretch", F.explode(F.sequence(F.col("stretch") + 1, F.lit(len(cuts)))))
    below = top_per_key(below, ["stretch"], order, n)
    own = highs.join(ends, "stretch").filter(F.col("max_salary") <= F.col("high"))
    best = top_per_key(own.unionByName(highs.join(below, "stretch")), ["high"], order, n)
    best = best.select("high", F.struct("id", *LISTING).alias("job"))
    met = requests.join(best, "high").filter(F.col("job.min_salary") >= F.col("low")).select(*requests.columns, "job")
    return top_per_key(met, ["request"], [F.desc("job.min_salary"), F.asc("job.id")], n, rank="pos")


# ---- answers as JSON -----------------------------------------------------------------------------


def rows_json(df: DataFrame) -> DataFrame:
    """A short result as one JSON text, in its order; `[]` when empty. For template results only."""
    numbered = df.select(F.monotonically_increasing_id().alias("i"), F.struct(*df.columns).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"])
    return numbered.agg(_json(rows).alias("rows"))


def to_rows(found: DataFrame, columns: dict[str, Column], order: str = "pos") -> DataFrame:
    """(request, rows): the few rows of each request as one JSON text, in order."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    lists = found.groupBy("request").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), row.alias("row")))).alias("all"))
    return lists.select("request", _json(F.transform("all", lambda r: r["row"])).alias("rows"))


def _json(rows: Column) -> Column:
    return F.to_json(rows, {"ignoreNullFields": "false"})


def listed(names: list[str]) -> dict[str, Column]:
    return {name: F.col(f"job.{name}") for name in names}


def as_conditions(requests: DataFrame) -> DataFrame:
    """`request`, `intent` and CONDITIONS from `request`, `intent` and `params`. A request with a bound that is no whole number, or
    without a parameter it needs, is left out."""

    def given(condition: str) -> Column:
        value = F.lit(None).cast("string")
        for name, filled in _FILLED.items():
            if condition in filled:
                value = F.when(F.col("intent") == name, F.get("params", filled.index(condition))).otherwise(value)
        return F.trim(value).try_cast("bigint").cast("double") if condition in ("low", "high") else value

    rows = requests.select("request", "intent", *[given(c).alias(c) for c in CONDITIONS])
    needed = [(F.col("intent") != name) | reduce(Column.__and__, [F.col(c).isNotNull() for c in filled]) for name, filled in _FILLED.items()]
    return rows.filter(F.col("intent").isin(list(_FILLED)) & reduce(Column.__and__, needed))


def answered(jobs: DataFrame, requests: DataFrame, run: Callable[..., DataFrame] = run_template) -> DataFrame:
    """(request, rows): the result of every request (`request`, `intent`, `params`) as JSON, `[]` without rows.

    Templates without parameters run once each, so at most as often as there are templates; all others together are one join.
    Requests that lack a parameter have no rows.
    """
    requests = cut_lineage(requests)
    intents = sorted(row["intent"] for row in requests.select("intent").distinct().limit(len(TEMPLATES) + 1).collect())
    unknown = [name for name in intents if name not in TEMPLATES]
    if unknown:
        raise KeyError(f"Unknown aggregation template: {unknown[0]}")
    answers = []
    if filled := [name for name in intents if name in _FILLED]:
        asked = as_conditions(requests).filter(F.col("request").isNotNull())
        same = asked.columns[1:]  # all but the request
        asked = asked.groupBy(*asked.columns).agg(F.count(F.lit(1)).alias("times")).withColumn("kind", _same(*same, "times"))
        asked = cut_lineage(asked)
        # requests that ask for the same are answered once
        once = asked.groupBy(F.col("kind").alias("request")).agg(*[F.first(c).alias(c) for c in (*same, "times")])
        once = once.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times")
        once = cut_lineage(once)
        found = reduce(DataFrame.unionByName, _filled_answers(jobs, once, cut_lineage(matches(jobs, once)), filled))
        answers.append(asked.select("request", "kind").join(found.withColumnRenamed("request", "kind"), "kind").select("request", "rows"))
    alike = [rows_json(run(jobs, name)).withColumn("intent", F.lit(name)) for name in intents if name not in _FILLED]
    if alike:
        # one row per template
        once = F.broadcast(reduce(DataFrame.unionByName, alike))
        answers.append(requests.select("request", "intent").join(once, "intent").select("request", "rows"))
    if not answers:
        return requests.select("request", F.lit(None).cast("string").alias("rows"))
    rows = requests.select("request").join(reduce(DataFrame.unionByName, answers), "request", "left")
    return rows.withColumn("rows", F.coalesce("rows", F.lit("[]")))


def _filled_answers(jobs: DataFrame, asked: DataFrame, found: DataFrame, intents: list[str]) -> list[DataFrame]:
    def of(*names: str) -> DataFrame:
        return asked.filter(F.col("intent").isin(list(names)))

    answers = []
    if any(name in _NEWEST for name in intents):
        answers.append(to_rows(newest_of(jobs, of(*_NEWEST), LISTED, found), listed(LISTING)))
    if "jobs_between_salary" in intents:
        answers.append(to_rows(best_paid_between(jobs, of("jobs_between_salary"), LISTED), listed(LISTING)))
    if "jobs_above_salary" in intents:
        # whatever the bound, the best paid above it are the best paid of all
        best = top_n(jobs.filter("min_salary IS NOT NULL").select("id", *LISTING), LISTED, F.desc("min_salary"), F.asc("id"))
        best = best.agg(F.collect_list(F.struct((-F.col("min_salary").cast("bigint")).alias("order"), "id", F.struct(*LISTING).alias("row"))).alias("best"))
        above = of("jobs_above_salary").withColumn("all", F.lit(0)).join(F.broadcast(best.withColumn("all", F.lit(0))), "all")
        kept = F.filter(F.array_sort("best"), lambda b: b["row"]["min_salary"] >= F.col("low"))
        answers.append(above.select("request", _json(F.transform(kept, lambda b: b["row"])).alias("rows")))
    for column, name in (("title", "list_distinct_titles"), ("company", "list_distinct_companies")):
        if name in intents:
            values = found.join(of(name).select("request"), "request", "left_semi")
            first = top_per_key(values, ["request"], [F.asc("value")], DISTINCT, rank="pos")
            answers.append(to_rows(first, {column: F.col("value")}))
    if "salary_stats_by_title" in intents:
        answers.append(_pay_by_title(jobs, of("salary_stats_by_title"), found))
    return answers


def _pay_by_title(jobs: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """Salaries are summed up by title first, so that patterns meet titles and no postings."""
    titles = jobs.filter("min_salary IS NOT NULL").groupBy(F.col("title").alias("value")).agg(
        F.min("min_salary").alias("min"),
        F.max("max_salary").alias("max"),
        F.sum(F.col("min_salary").cast("bigint")).alias("total"),
        F.count(F.lit(1)).alias("known"),
    )
    met = asked.select("request").join(found.join(titles, "value").drop("n"), "request", "left")
    stats = met.groupBy("request").agg(
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        mean_of(F.sum("total"), F.coalesce(F.sum("known"), F.lit(0))).alias("avg"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("job_count"),
    )
    return stats.select("request", _json(F.array(F.struct("min", "max", "avg", "job_count"))).alias("rows"))
