"""Landed JSON pages of the three job boards → raw postings.

Fetching is outside: a page file holds one API answer, its number is the digits of the file name. An adapter is a
plain function from a page table to raw postings, so the same code serves batch and streaming reads.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.functions.postings import normalize_job_type, normalize_salary, parse_salary_text
from tallywork.functions.text import contains_insensitive, strip_html, strip_html_entities
from tallywork.operators.ranking import first_seen, top_n

POSITION = ["page", "pos"]


def _raw(jobs: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Raw postings with every contract column, plus the reading position."""
    types = dict(part.split(" ", 1) for part in schemas.RAW_JOB.split(", "))
    columns = {"source": F.lit(source), **columns}
    return jobs.select(
        *[columns.get(name, F.lit(None)).cast(types[name]).alias(name) for name in schemas.RAW_JOB_COLUMNS],
        *POSITION,
    )


def _explode(pages: DataFrame, field: str) -> DataFrame:
    return pages.select("page", F.posexplode(field).alias("pos", "j"))


def remotive(pages: DataFrame) -> DataFrame:
    """Job type `remote` is a flag, not a type; a location naming remote sets the flag too. Salary is text.

    Postings without a readable salary are dropped.
    """
    j = F.col("j")
    remote = (j["job_type"] == "remote") | contains_insensitive(j["candidate_required_location"], "remote")
    jobs = _explode(pages, "jobs").withColumn("pay", parse_salary_text(j["salary"]))
    return _raw(
        jobs.filter(F.col("pay.min_salary").isNotNull()),
        "remotive",
        source_id=j["id"].cast("string"),
        title=j["title"],
        company=j["company_name"],
        location=j["candidate_required_location"],
        description=strip_html(j["description"]),
        url=j["url"],
        job_type=normalize_job_type(F.when(j["job_type"] != "remote", j["job_type"])),
        is_remote=F.when(remote, F.lit(True)),
        min_salary=F.col("pay.min_salary"),
        max_salary=F.col("pay.max_salary"),
    )


def jobicy(pages: DataFrame) -> DataFrame:
    """Job type is a string or an array of which the first counts. Postings without salary are dropped."""
    j = F.col("j")
    kind = F.coalesce(
        F.try_variant_get(j["jobType"], "$[0]", "string"),
        F.when(F.schema_of_variant(j["jobType"]) == "STRING", F.try_variant_get(j["jobType"], "$", "string")),
    )
    jobs = _explode(pages, "jobs").withColumn(
        "pay", normalize_salary(j["salaryMin"], j["salaryMax"], j["salaryPeriod"])
    )
    return _raw(
        jobs.filter(F.col("pay.min_salary").isNotNull()),
        "jobicy",
        source_id=j["id"].cast("string"),
        title=j["jobTitle"],
        company=j["companyName"],
        location=j["jobGeo"],
        description=strip_html(F.coalesce(j["jobDescription"], F.lit(""))),
        url=j["url"],
        job_type=normalize_job_type(kind),
        min_salary=F.col("pay.min_salary"),
        max_salary=F.col("pay.max_salary"),
    )


def findwork(pages: DataFrame) -> DataFrame:
    """Postings carry a remote flag, a logo and keywords but no salary; those without a title are dropped."""
    j = F.col("j")
    return _raw(
        _explode(pages, "results").filter(F.coalesce(j["role"], F.lit("")) != ""),
        "findwork",
        source_id=j["id"],
        title=j["role"],
        company=j["company_name"],
        location=j["location"],
        description=strip_html_entities(j["text"]),
        url=j["url"],
        job_type=normalize_job_type(j["employment_type"]),
        is_remote=j["remote"],
        logo=F.nullif(j["logo"], F.lit("")),
        keywords=F.coalesce(j["keywords"], F.array().cast("array<string>")),
    )


Adapter = Callable[[DataFrame], DataFrame]
Sources = Mapping[str, tuple[str, Adapter]]
# The built-in sources: schema of a page and adapter. Callers pass their own mapping for further ones.
SOURCES: dict[str, tuple[str, Adapter]] = {
    "remotive": (schemas.REMOTIVE_PAGE, remotive),
    "jobicy": (schemas.JOBICY_PAGE, jobicy),
    "findwork": (schemas.FINDWORK_PAGE, findwork),
}


def with_page_number(pages: DataFrame) -> DataFrame:
    """The number after "page" in the path, else the first digits of the file name, else 0."""
    after_page = F.regexp_extract(F.col("_metadata.file_path"), r"page[=_-]?([0-9]+)", 1)
    in_name = F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)", 1)
    number = F.coalesce(F.nullif(after_page, F.lit("")), F.nullif(in_name, F.lit("")), F.lit("0"))
    return pages.withColumn("page", number.try_cast("bigint"))


# One API answer per file, in folders of any depth.
PAGE_OPTIONS = {"multiLine": "true", "recursiveFileLookup": "true"}


def read_pages(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """Every page file of a folder; an unreadable file yields no postings."""
    return with_page_number(spark.read.schema(schema).options(**PAGE_OPTIONS).json(path))


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a landing folder (or pattern) is there, on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target))


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def read_source(spark: SparkSession, name: str, path: str, cap: int | None = None, sources: Sources = SOURCES) -> DataFrame:
    """One source's postings, the first of each source id, optionally only the first `cap` in page order."""
    schema, adapter = sources[name]
    jobs = first_seen(adapter(read_pages(spark, schema, path)), ["source", "source_id"], POSITION)
    return jobs if cap is None else top_n(jobs, cap, F.asc("page"), F.asc("pos"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def split_landed(spark: SparkSession, folders: Mapping[str, str]) -> tuple[dict[str, str], list[str]]:
    """(the folders that are there, names of the sources whose folder is missing)."""
    there = {name: path for name, path in folders.items() if folder_exists(spark, path)}
    return there, [name for name in folders if name not in there]


def read_landing(
    spark: SparkSession, folders: Mapping[str, str], findwork_cap: int | None = None, sources: Sources = SOURCES
) -> tuple[DataFrame, list[str]]:
    """(all raw postings, names of the sources that failed). A source whose folder is missing does not stop the others.

    An unreadable page yields no postings; an error in an adapter is raised. Everything landed is read unless `findwork_cap`
    sets that board's paging stop.
    """
    there, failed = split_landed(spark, folders)
    parts = [read_source(spark, name, path, findwork_cap if name == "findwork" else None, sources) for name, path in there.items()]
    if not parts:
        parts = [spark.createDataFrame([], schemas.RAW_JOB + ", page BIGINT, pos INT")]
    return union_sources(parts), failed
