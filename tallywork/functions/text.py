"""Text cleaning and matching as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork import constants as K

# A word character without reference to the JVM's locale rules.
WORD = "[A-Za-z0-9_]"


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(K.WHITESPACE))


def _tags_to_blank(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def _squeeze(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, K.WHITESPACE_CLASS + "+", " "))


def strip_html(c: Column) -> Column:
    """Tags become blanks, runs of white space one blank."""
    return _squeeze(_tags_to_blank(c))


def strip_html_entities(c: Column) -> Column:
    """`strip_html` with eight named entities decoded, `&amp;` first."""
    decoded = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), K.HTML_ENTITIES, _tags_to_blank(c)
    )
    return _squeeze(decoded)


def strip_thinking(c: Column) -> Column:
    """Drop `<think>…</think>` blocks and the line breaks after them."""
    return trim_all(F.regexp_replace(c, r"(?s)<think>.*?</think>\n*", ""))


def contains_insensitive(c: Column, needle: str) -> Column:
    """Case-insensitive substring test in which `%` and `_` are ordinary characters."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def round_half_up(c: Column, digits: int) -> Column:
    """Round to `digits` on the scaled binary value, halves upwards."""
    scale = 10**digits
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


# ---- keyword matching --------------------------------------------------------------------------


def keyword_regex(keyword: str) -> str:
    """A case-insensitive whole-token pattern for one keyword.

    Both ends are word boundaries; a keyword ending in a non-word character (`c#`) must only not run on
    into a letter or digit.
    """
    keyword = keyword.lower()
    lead = rf"(?<!{WORD})" if re.match(WORD, keyword) else rf"(?<={WORD})"
    tail = rf"(?!{WORD})" if re.search(WORD + r"\Z", keyword) else "(?![a-z0-9])"
    return f"{lead}{re.escape(keyword)}{tail}"


def matches_any(lowered: Column, keywords: list[str]) -> Column:
    """`lowered` holds at least one keyword.

    A plain substring test, which is much cheaper, comes before each pattern; the patterns are literals and compiled
    once per task.
    """
    tests = [F.contains(lowered, F.lit(k.lower())) & lowered.rlike(keyword_regex(k)) for k in keywords]
    return reduce(lambda a, b: a | b, tests)


def keyword_regex_column(keyword: Column) -> Column:
    """`keyword_regex` for keywords that are data."""
    low = F.lower(keyword)
    quoted = F.regexp_replace(low, r"([^A-Za-z0-9_\s])", r"\\$1")
    lead = F.when(low.rlike(rf"^{WORD}"), F.lit(rf"(?<!{WORD})")).otherwise(F.lit(rf"(?<={WORD})"))
    tail = F.when(low.rlike(rf"{WORD}$"), F.lit(rf"(?!{WORD})")).otherwise(F.lit("(?![a-z0-9])"))
    return F.concat(lead, quoted, tail)


def match_keyword(text: Column, keyword: Column) -> Column:
    """Row-wise keyword match for keywords that are data."""
    return F.rlike(F.lower(text), keyword_regex_column(keyword))


# ---- question fields, verdicts, label warnings ---------------------------------------------------


def detect_fields(question: Column) -> Column:
    """The posting fields a question asks about, as an array in a fixed order."""
    hits = [
        F.when(question.rlike(rf"(?i)(?<!{WORD})(?:{prefixes})"), F.lit(field)) for field, prefixes in K.FIELD_PREFIXES
    ]
    return F.array_compact(F.array(*hits))


def normalize_verdict(raw: Column) -> Column:
    """A judge's answer as one of three verdicts; anything unreadable counts as not relevant.

    "not relevant", whose blank is lost when the answer is cleaned, is read as `not_relevant`.
    """
    clean = F.regexp_replace(F.lower(trim_all(raw)), "[^a-z_]", "")
    return (
        F.when(clean.contains("not_relevant") | clean.contains("notrelevant"), F.lit("not_relevant"))
        .when(clean.contains("marginal"), F.lit("marginal"))
        .when(clean.contains("relevant"), F.lit("relevant"))
        .otherwise(F.lit("not_relevant"))
    )


def label_warning(count: Column, minimum: Column, cap: Column) -> Column:
    """Why a label set deserves a look, or null."""
    return F.when(
        count < minimum,
        F.concat(
            F.lit("Only "), count.cast("string"), F.lit(" jobs matched (expected >= "), minimum.cast("string"), F.lit(")")
        ),
    ).when(
        count == cap,
        F.concat(F.lit("Capped at "), cap.cast("string"), F.lit(" candidates — consider tuning max_relevant")),
    )


def one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    """The value where it is allowed, else null."""
    return F.when(c.isin(*allowed), c)
