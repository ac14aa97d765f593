"""Posting → typed text chunks, as Column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.text import trim_all

_LISTS = ("responsibilities", "requirements", "benefits", "skills")


def _has(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _has_any(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def _chunk(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def _heading(title: Column, company: Column) -> Column:
    return F.concat(title, F.lit(" at "), company)


def _joined(*parts: Column) -> Column:
    """Sentences joined by `. `; absent (null) parts leave no gap."""
    return F.concat_ws(". ", *parts)


def has_structure(summary: Column, salary: Column, *lists: Column) -> Column:
    """Any structured field is present."""
    present = _has(summary) | _has(salary)
    for items in lists:
        present = present | _has_any(items)
    return present


def identity_text(title: Column, company: Column, location: Column, job_type: Column, remote: Column, summary: Column) -> Column:
    """Who, where, what kind, and the summary."""
    remote = F.coalesce(remote, F.lit(False))
    kind = F.when(_has(job_type), F.concat(job_type, F.when(remote, F.lit(", remote")).otherwise(F.lit("")))).when(
        remote, F.lit("remote")
    )
    place = F.when(_has(location), F.concat(F.lit("in "), location)).otherwise(F.lit("Remote"))
    return F.concat(_joined(_heading(title, company), place, kind, F.when(_has(summary), summary)), F.lit("."))


def structured_chunks(job: dict[str, Column]) -> Column:
    """Up to four chunks from structured fields: identity, requirements, responsibilities+skills, benefits+salary."""
    sentences = {name: F.array_join(job[name], ". ") for name in ("responsibilities", "requirements", "benefits")}
    work = _joined(
        F.when(_has_any(job["responsibilities"]), F.concat(F.lit("Responsibilities: "), sentences["responsibilities"])),
        F.when(_has_any(job["skills"]), F.concat(F.lit("Skills: "), F.array_join(job["skills"], ", "))),
    )
    pay = _joined(
        F.when(
            _has_any(job["benefits"]),
            F.concat(F.lit("Benefits at "), job["company"], F.lit(": "), sentences["benefits"]),
        ),
        F.when(_has(job["salary"]), F.concat(F.lit("Compensation: "), job["salary"])),
    )
    identity = identity_text(
        job["title"], job["company"], job["location"], job["job_type"], job["is_remote"], job["summary"]
    )
    needs = F.concat(
        F.lit("Requirements for "), _heading(job["title"], job["company"]), F.lit(": "), sentences["requirements"]
    )
    return F.array_compact(
        F.array(
            _chunk("identity", identity),
            F.when(_has_any(job["requirements"]), _chunk("requirements", needs)),
            F.when(work != "", _chunk("responsibilities", work)),
            F.when(pay != "", _chunk("benefits", pay)),
        )
    )


# ---- text windows --------------------------------------------------------------------------------


def segments(text: Column, window: int = K.WINDOW_CHARS) -> Column:
    """Paragraphs; those beyond a window by bullets; those beyond a window by sentences. Blank ones go."""

    def sentences(bullet: Column) -> Column:
        return F.transform(F.split(bullet, r"(?<=[.!?])" + K.WHITESPACE_CLASS + "+"), lambda s: F.concat(s, F.lit(" ")))

    def bullets(para: Column) -> Column:
        return F.flatten(
            F.transform(
                F.split(para, r"(?=\n[-•*] )"),
                lambda b: F.when(F.length(b) <= window, F.array(b)).otherwise(sentences(b)),
            )
        )

    parts = F.flatten(
        F.transform(
            F.split(text, r"\n\n+"),
            lambda p: F.when(F.length(p) <= window, F.array(F.concat(p, F.lit("\n\n")))).otherwise(bullets(p)),
        )
    )
    return F.filter(parts, lambda s: trim_all(s) != "")


def windows(
    text: Column, window: int = K.WINDOW_CHARS, overlap: int = K.WINDOW_OVERLAP, max_windows: int | None = None
) -> Column:
    """Greedy windows of at most `window` characters, each starting with the last `overlap` of the one before.

    Segments longer than `window - overlap` are first cut to that length, so that one always fits behind an
    overlap and no text is lost. The whole text is cut unless `max_windows` keeps the first windows only.
    """
    room = window - overlap
    pieces = F.flatten(
        F.transform(
            segments(text, window),
            lambda s: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(s) - 1) / F.lit(room)).cast("int")),
                lambda i: F.substring(s, i * room + 1, F.lit(room)),
            ),
        )
    )
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def step(acc: Column, piece: Column) -> Column:
        fits = F.length(acc["current"]) + F.length(piece) <= window
        tail = F.right(acc["current"], F.lit(overlap))
        grow = F.struct(acc["done"].alias("done"), F.concat(acc["current"], piece).alias("current"))
        cut = F.struct(
            F.array_append(acc["done"], trim_all(acc["current"])).alias("done"), F.concat(tail, piece).alias("current")
        )
        full = F.lit(False) if max_windows is None else F.size(acc["done"]) >= max_windows
        return F.when(full, acc).when(fits, grow).otherwise(cut)

    def finish(acc: Column) -> Column:
        last = trim_all(acc["current"])
        return F.when(last != "", F.array_append(acc["done"], last)).otherwise(acc["done"])

    packed = F.aggregate(pieces, empty, step, finish)
    return packed if max_windows is None else F.slice(packed, 1, max_windows)


def window_chunks(job: dict[str, Column], max_windows: int | None = None) -> Column:
    """Chunks for a posting without structured fields: identity, salary sentence, windows over the description."""
    identity = F.concat(
        _joined(
            _heading(job["title"], job["company"]),
            F.when(_has(job["location"]), F.concat(F.lit("in "), job["location"])),
            F.when(_has(job["job_type"]), job["job_type"]),
        ),
        F.lit("."),
    )

    def dollars(c: Column) -> Column:
        return F.concat(F.lit("$"), F.format_number(c, 0))

    amount = F.concat_ws("–", dollars(job["min_salary"]), dollars(job["max_salary"]))
    salary = F.concat(_heading(job["title"], job["company"]), F.lit(". Salary: "), amount, F.lit(" per year."))
    texts = windows(job["description"], max_windows=max_windows)
    body = F.transform(
        texts,
        lambda t, i: F.struct(
            F.when(i == 0, F.lit("requirements")).otherwise(F.lit("description")).alias("type"), t.alias("text")
        ),
    )
    head = F.array_compact(
        F.array(
            _chunk("identity", identity),
            F.when(F.coalesce(job["min_salary"], job["max_salary"]).isNotNull(), _chunk("salary", salary)),
        )
    )
    return F.concat(head, F.coalesce(body, F.array().cast("array<struct<type:string,text:string>>")))


def build_chunks(job: dict[str, Column], max_windows: int | None = None) -> Column:
    """Structured chunks where any structured field is present, else text windows."""
    structured = has_structure(job["summary"], job["salary"], *[job[name] for name in _LISTS])
    return F.when(structured, structured_chunks(job)).otherwise(window_chunks(job, max_windows))
