"""Typed structs from model answers. Types are checked before reading: a number is never taken for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.binding import let
from tallywork.functions.postings import dedupe_substrings
from tallywork.functions.text import one_of, trim_all


def parse_json_block(raw: Column) -> Column:
    """The answer as a variant: code fences dropped; failing that, the widest `{…}` block; else null."""
    bare = F.replace(F.regexp_replace(trim_all(raw), r"(?i)```(?:json)?\s*", ""), F.lit("```"), F.lit(""))
    return let(
        bare,
        lambda text: F.coalesce(
            F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
        ),
    )


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _string(value: Column, path: str) -> Column:
    return F.when(
        _kind(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string")
    )


def _boolean(value: Column, path: str) -> Column:
    return F.when(
        _kind(F.try_variant_get(value, path, "variant")) == "BOOLEAN", F.try_variant_get(value, path, "boolean")
    )


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _strings(value: Column, path: str) -> Column:
    """The string items of an array, null when there are none."""
    kept = F.transform(
        F.filter(_items(value, path), lambda x: _kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")
    )
    return let(kept, lambda strings: F.when(F.size(strings) > 0, strings))


def _or_empty(strings: Column) -> Column:
    return F.coalesce(strings, F.array().cast("array<string>"))


def extract_job(raw: Column) -> Column:
    """A parsed posting from an answer; every field null where the answer cannot be read."""
    return let(parse_json_block(raw), _job_fields)


def _job_fields(v: Column) -> Column:
    return F.struct(
        _string(v, "$.summary").alias("summary"),
        _string(v, "$.salary").alias("salary"),
        _strings(v, "$.responsibilities").alias("responsibilities"),
        _strings(v, "$.requirements").alias("requirements"),
        _strings(v, "$.benefits").alias("benefits"),
        dedupe_substrings(_strings(v, "$.skills")).alias("skills"),
        one_of(_string(v, "$.jobType"), K.JOB_TYPES).alias("job_type"),
        _boolean(v, "$.isRemote").alias("is_remote"),
    )


def extract_resume(raw: Column) -> Column:
    """A parsed resume; experience needs a company or a title, education an institution."""
    return let(parse_json_block(raw), _resume_fields)


def _resume_fields(v: Column) -> Column:
    def text(item: Column, field: str) -> Column:
        return F.coalesce(_string(item, f"$.{field}"), F.lit(""))

    def job(item: Column) -> Column:
        return F.struct(
            text(item, "company").alias("company"),
            text(item, "title").alias("title"),
            _string(item, "$.startDate").alias("start_date"),
            _string(item, "$.endDate").alias("end_date"),
            text(item, "description").alias("description"),
        )

    def school(item: Column) -> Column:
        return F.struct(
            text(item, "institution").alias("institution"),
            _string(item, "$.degree").alias("degree"),
            _string(item, "$.field").alias("field"),
            _string(item, "$.graduationYear").alias("graduation_year"),
        )

    experience = F.filter(
        F.transform(_items(v, "$.experience"), job), lambda e: (e["company"] != "") | (e["title"] != "")
    )
    education = F.filter(F.transform(_items(v, "$.education"), school), lambda e: e["institution"] != "")
    return F.struct(
        *[_string(v, f"$.{f}").alias(f) for f in ("name", "email", "linkedin", "phone", "location", "summary")],
        _or_empty(_strings(v, "$.skills")).alias("skills"),
        F.coalesce(experience, F.filter(F.array(job(v)), lambda e: F.lit(False))).alias("experience"),
        F.coalesce(education, F.filter(F.array(school(v)), lambda e: F.lit(False))).alias("education"),
        _or_empty(_strings(v, "$.certifications")).alias("certifications"),
    )


def extract_route(raw: Column, intents: list[str]) -> Column:
    """A classifier's answer as (type, intent, params, filters); unreadable answers mean retrieval.

    Salaries that are text are read as numbers; a bound that is no number is left out.
    """
    return let(F.try_parse_json(trim_all(raw)), lambda v: _route_fields(v, intents))


def _route_fields(v: Column, intents: list[str]) -> Column:
    kind = one_of(_string(v, "$.type"), K.ROUTES)
    intent = F.when(kind.isNotNull(), one_of(_string(v, "$.intent"), ("filter_jobs", *intents)))

    def number(path: str) -> Column:
        return F.try_variant_get(v, path, "string").try_cast("double")

    filters = F.struct(
        _string(v, "$.filters.title").alias("title"),
        number("$.filters.minSalary").alias("min_salary"),
        number("$.filters.maxSalary").alias("max_salary"),
        _string(v, "$.filters.location").alias("location"),
        _string(v, "$.filters.jobType").alias("job_type"),
    )
    has_filters = _kind(F.try_variant_get(v, "$.filters", "variant")).startswith("OBJECT")
    return F.struct(
        F.coalesce(kind, F.lit("retrieval")).alias("type"),
        intent.alias("intent"),
        F.when(kind.isNotNull(), _strings(v, "$.params")).alias("params"),
        F.when((intent == "filter_jobs") & has_filters, filters).alias("filters"),
    )
