"""Normalisation of posting fields: job type, salary, skills, content hash."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.binding import let
from tallywork.functions.text import trim_all

SALARY = "struct<min_salary:int,max_salary:int>"


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


# ---- job type ------------------------------------------------------------------------------------


def normalize_job_type(raw: Column) -> Column:
    """One of five job types from its known spellings, else null."""
    return F.try_element_at(_lookup(K.JOB_TYPE_OF_SPELLING), trim_all(F.lower(raw)))


def pick_job_type(raw: Column, parsed: Column) -> Column:
    """The source's job type, where it can be read, before the one read from the text."""
    return F.coalesce(normalize_job_type(raw), parsed)


def pick_remote(raw: Column, parsed: Column) -> Column:
    return F.coalesce(raw, parsed, F.lit(False))


# ---- salary --------------------------------------------------------------------------------------


def _salary(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("min_salary"), hi.cast("int").alias("max_salary"))


def normalize_salary(lo: Column, hi: Column, period: Column) -> Column:
    """Yearly whole-number salary range; zero means unknown, a one-sided range is closed with itself."""
    factor = F.coalesce(F.try_element_at(_lookup(K.ANNUAL_FACTOR_OF_PERIOD), F.lower(period)), F.lit(1))

    def yearly(amount: Column) -> Column:
        return F.nullif(F.floor(amount.cast("double") * factor + F.lit(0.5)), F.lit(0))

    lo_year, hi_year = yearly(lo), yearly(hi)
    return _salary(F.coalesce(lo_year, hi_year), F.coalesce(hi_year, lo_year))


def parse_salary_text(raw: Column) -> Column:
    """Yearly salary range from free text: the first two plausible amounts after scaling by the period.

    Amounts below 1,000 a year are taken for other numbers (dates, counts) and dropped, so "60-80k" gives
    80,000 twice. Amounts beyond a 32-bit integer cannot be stored and are dropped likewise.
    """
    factor = F.lit(1)
    for multiplier, pattern in reversed(K.SALARY_TEXT_PERIODS):
        factor = F.when(raw.rlike(pattern), F.lit(multiplier)).otherwise(factor)

    def amount(token: Column) -> Column:
        plain = F.replace(F.lower(token), F.lit(","), F.lit(""))
        number = F.replace(plain, F.lit("k"), F.lit("")).try_cast("double")
        return F.floor(number * F.when(plain.endswith("k"), F.lit(1000.0)).otherwise(F.lit(1.0)) * factor + F.lit(0.5))

    amounts = F.filter(
        F.transform(F.regexp_extract_all(raw, F.lit(K.SALARY_NUMBER), F.lit(1)), amount),
        lambda n: n.between(F.lit(K.MIN_ANNUAL_SALARY), F.lit(K.MAX_ANNUAL_SALARY)),
    )

    def first_two(found: Column) -> Column:
        first = F.try_element_at(found, F.lit(1))
        return _salary(first, F.coalesce(F.try_element_at(found, F.lit(2)), first))

    return let(amounts, first_two)


def pick_salary(lo: Column, hi: Column, text: Column) -> Column:
    """Numbers from the source win over amounts read from text."""
    return F.when(F.coalesce(lo, hi).isNotNull(), _salary(lo, hi)).otherwise(parse_salary_text(text))


def salary_header(lo: Column, hi: Column) -> Column:
    """` | Salary: $a–$b`, `$a+` when open-ended, empty without a lower bound."""
    upper = F.when(F.coalesce(hi, F.lit(0)) != 0, F.concat(F.lit("–$"), F.format_number(hi, 0))).otherwise(F.lit("+"))
    return F.when(
        F.coalesce(lo, F.lit(0)) != 0, F.concat(F.lit(" | Salary: $"), F.format_number(lo, 0), upper)
    ).otherwise(F.lit(""))


# ---- skills --------------------------------------------------------------------------------------


def _array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def filter_keywords(keywords: Column) -> Column:
    """Keep plausible tool names: two characters or more, no stop word, not only digits."""

    def plausible(keyword: Column) -> Column:
        key = trim_all(F.lower(keyword))
        return (F.length(key) >= 2) & ~key.isin(*K.KEYWORD_STOPWORDS) & ~key.rlike("^[0-9]+$")

    return F.filter(keywords, plausible)


def dedupe_insensitive(items: Column) -> Column:
    """Drop repeats regardless of case; the first spelling stays."""

    def first_spellings(given: Column) -> Column:
        lowered = F.transform(given, lambda x: F.lower(x))
        return let(
            lowered, lambda low: F.filter(given, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
        )

    return let(items, first_spellings)


def dedupe_substrings(items: Column) -> Column:
    """Drop items that are part of a longer item, regardless of case."""

    def in_longer(low: Column, x: Column) -> Column:
        return F.exists(low, lambda other: (F.length(other) > F.length(x)) & F.contains(other, x))

    def whole(given: Column) -> Column:
        lowered = F.transform(given, lambda x: F.lower(x))
        return let(lowered, lambda low: F.filter(given, lambda x: ~in_longer(low, F.lower(x))))

    return let(items, whole)


def merge_skills(parsed: Column, keywords: Column) -> Column:
    """Skills read from the text followed by the source's keywords, without repeats."""
    return dedupe_substrings(dedupe_insensitive(F.concat(_array(parsed), filter_keywords(_array(keywords)))))


# ---- identity ------------------------------------------------------------------------------------


def content_hash(title: Column, company: Column, description: Column, location: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, company, description, location)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def short_id(full_hash: Column) -> Column:
    """First 16 hex digits, the source id of postings entered by hand."""
    return F.substring(full_hash, 1, 16)


def job_id(source: Column, source_id: Column) -> Column:
    """Deterministic id of a posting, so that a retried batch writes the same row."""
    return F.sha2(F.concat_ws("|", source, source_id), 256)
