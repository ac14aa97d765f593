"""Incoming postings → jobs and chunks, set at a time. The same functions serve batch and streaming runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywork import constants as K
from tallywork import schemas
from tallywork.functions.chunks import build_chunks
from tallywork.functions.postings import content_hash, job_id, merge_skills, pick_job_type, pick_remote, pick_salary
from tallywork.functions.responses import extract_job
from tallywork.operators.embedding import Embedder, embed_column
from tallywork.operators.joins import hot_key_join
from tallywork.operators.ranking import crowded_buckets, first_seen, latest_wins, with_single
from tallywork.session import remove_folder, shared_folder
from tallywork.sinks.tables import Store, chunk_rows, expire_cache, keep_created_at, truncate_and_reload
from tallywork.sinks.versioned import VersionedTable

SKIPPED, RE_EMBED, NEW, STORED = "skipped", "re-embed", "new", "stored"
POSITION = ["source", "page", "pos"]
STAGED = schemas.RAW_JOB + ", page BIGINT, pos INT, content_hash STRING, existing_id STRING, status STRING"

# raw postings → the same rows with a `response` column holding a model's answer about the description
Parser = Callable[[DataFrame], DataFrame]


# ---- what to do with each posting ----------------------------------------------------------------


def with_content_hash(raw: DataFrame) -> DataFrame:
    return raw.withColumn(
        "content_hash", content_hash(F.col("title"), F.col("company"), F.col("description"), F.col("location"))
    )


def has_embedding(jobs: DataFrame, chunks: DataFrame, id_column: str = "id") -> DataFrame:
    """Postings that have chunks."""
    return jobs.join(chunks.select(F.col("job_id").alias(id_column)), id_column, "left_semi")


def known_content(stored: DataFrame, chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """(content_hash, existing_id, embedded) for the incoming contents that are stored, whatever their source.

    Only ids and hashes are read, and only the incoming hashes survive the first join; the chunk table is reduced to the
    postings that were found.
    """
    wanted = incoming.select("content_hash").distinct()
    found = (
        stored.select("content_hash", "id")
        .join(wanted, "content_hash", "left_semi")
        .groupBy("content_hash")
        .agg(F.min("id").alias("existing_id"))
    )
    embedded = has_embedding(found, chunks, "existing_id").select("existing_id", F.lit(True).alias("embedded"))
    return found.join(embedded, "existing_id", "left").select(
        "content_hash", "existing_id", F.coalesce("embedded", F.lit(False)).alias("embedded")
    )


def classify(incoming: DataFrame, stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Incoming postings with `existing_id` and `status`: skipped, re-embed or new.

    `incoming` has content_hash and the columns source and source_id.
    """
    known = known_content(stored, chunks, incoming)
    joined = hot_key_join(incoming, known, "content_hash", "left", ["source", "source_id"])
    status = (
        F.when(F.col("existing_id").isNull(), F.lit(NEW))
        .when(F.col("embedded"), F.lit(SKIPPED))
        .otherwise(F.lit(RE_EMBED))
    )
    return joined.withColumn("status", status).drop("embedded")


def new_contents(classified: DataFrame) -> DataFrame:
    """The postings to store: the last per posting key within the run, then the first of each new content among these.

    In this order no content is lost: a posting that is replaced within the run does not take the place of another with its
    former content.
    """
    last = latest_wins(classified.filter(F.col("status") == NEW), ["source", "source_id"], ["page", "pos", "content_hash"])
    return first_seen(last, ["content_hash"], POSITION)


def run_counts(classified: DataFrame, stored_rows: DataFrame) -> DataFrame:
    """One row: postings fetched, stored and skipped."""
    marks = classified.select("status").unionByName(stored_rows.select(F.lit(STORED).alias("status")))

    def number_of(*statuses: str) -> Column:
        return F.count(F.when(F.col("status").isin(*statuses), 1))

    return marks.agg(
        number_of(NEW, RE_EMBED, SKIPPED).alias("fetched"),
        number_of(STORED).alias("stored"),
        number_of(SKIPPED).alias("skipped"),
    )


# ---- rows to store -------------------------------------------------------------------------------


def to_jobs(raw: DataFrame, now: Column) -> DataFrame:
    """Stored rows from new postings. `response` (may be absent) is a model's answer about the description.

    An unreadable answer leaves the parsed fields null; the posting is stored all the same.
    """
    response = F.col("response") if "response" in raw.columns else F.lit(None).cast("string")
    rows = raw.withColumn("parsed", extract_job(response))
    parsed = F.col("parsed")
    pay = pick_salary(F.col("min_salary"), F.col("max_salary"), parsed["salary"])
    rows = rows.withColumn("pay", pay)
    empty = F.array().cast("array<string>")
    columns = {
        "id": job_id(F.col("source"), F.col("source_id")),
        "job_type": pick_job_type(F.col("job_type"), parsed["job_type"]),
        "is_remote": pick_remote(F.col("is_remote"), parsed["is_remote"]),
        "min_salary": F.col("pay.min_salary"),
        "max_salary": F.col("pay.max_salary"),
        "summary": parsed["summary"],
        "salary": parsed["salary"],
        "skills": merge_skills(parsed["skills"], F.col("keywords")),
        **{c: F.coalesce(parsed[c], empty) for c in ("responsibilities", "requirements", "benefits")},
        "fetched_at": now,
        "created_at": now,
    }
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in schemas.JOB_COLUMNS])


def to_chunks(jobs: DataFrame, max_windows: int | None = None) -> DataFrame:
    """(job_id, pos, chunk_type, chunk_text) of stored rows, over whole texts unless `max_windows` limits their windows."""
    fields = {c: F.col(c) for c in jobs.columns}
    return jobs.select(F.col("id").alias("job_id"), F.posexplode(build_chunks(fields, max_windows)).alias("pos", "chunk")).select(
        "job_id", "pos", F.col("chunk.type").alias("chunk_type"), F.col("chunk.text").alias("chunk_text")
    )


# ---- one run -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Embedding:
    """A user's embedder with its name and width.

    `tasks` sets how many tasks call it at a time, `max_windows` how many windows of a text are embedded (None: all).
    """

    embedder: Embedder
    model: str
    dim: int = K.EMBEDDING_DIM
    tasks: int | None = None
    max_windows: int | None = None


class _Steps:
    """The steps of one run in a folder of its own, each written once and read back, so that later steps do not repeat earlier ones."""

    def __init__(self, spark: SparkSession):
        self._spark, self._folder = spark, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"

    def __call__(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{self._folder}/{name}")
        return self._spark.read.schema(rows.schema).parquet(f"{self._folder}/{name}")

    def remove(self) -> None:
        remove_folder(self._spark, self._folder)


def _store_vectors(cache: VersionedTable, mark: str) -> Callable[[DataFrame], DataFrame]:
    def store(vectors: DataFrame) -> DataFrame:
        cache.commit(vectors, mark)
        return cache.read_commit(mark)

    return store


def _embedded_chunks(store: Store, jobs: DataFrame, mark: str, embedding: Embedding, now: Column, steps: _Steps) -> DataFrame:
    """Stored form of the jobs' chunks. Texts with a fresh vector in the cache are not embedded again."""
    texts = steps(to_chunks(jobs, embedding.max_windows), "chunks")
    embedded, _ = embed_column(
        texts,
        "chunk_text",
        embedding.embedder,
        embedding.model,
        ["job_id", "pos"],
        embedding.dim,
        cache=store.embedding_cache.read(before=store.embedding_cache.version_of(mark)),
        now=now,
        store=_store_vectors(store.embedding_cache, mark),
        tasks=embedding.tasks,
        keep=steps,
    )
    return chunk_rows(embedded, embedding.model, now)


def _at(now: Column | None, spark: SparkSession) -> Column:
    """The time of a run, one value for all its steps and repeats within it."""
    if now is None:
        now = F.lit(spark.sql("SELECT current_timestamp()").first()[0]).cast("timestamp").cast("timestamp_ntz")
    return now


def ingest_batch(
    store: Store, raw: DataFrame, mark: str, embedding: Embedding, parser: Parser | None = None, now: Column | None = None
) -> DataFrame:
    """Store one batch of raw postings (with page and pos); returns its counts.

    `mark` names the batch, such as a stream's checkpoint and batch number. Each step is written once and read back. Stored
    tables are read as they were before the batch, so one that is delivered again overwrites its own commits with the same
    rows, whatever was committed in between. At the end small commits are folded.
    """
    now, mark = _at(now, store.spark), str(mark)
    steps = _Steps(store.spark)
    stored = store.jobs.read(before=store.jobs.version_of(mark))
    chunks = store.chunks.read(before=store.chunks.version_of(mark))
    incoming = steps(with_content_hash(raw), "incoming")
    status = classify(incoming, stored, chunks).select(*StructType.fromDDL(STAGED).names)
    classified = steps(status, "classified")

    fresh = new_contents(classified)
    if parser is not None:
        fresh = steps(parser(fresh), "parsed")
    store.jobs.commit(keep_created_at(to_jobs(fresh, now), stored), mark)
    written = store.jobs.read_commit(mark)

    healed = classified.filter(F.col("status") == RE_EMBED).select(F.col("existing_id").alias("id")).distinct()
    # a posting that this batch has written anew is chunked from its new content
    healed = stored.join(healed, "id", "left_semi").join(written.select("id"), "id", "left_anti")
    to_embed = written.unionByName(healed)
    store.chunks.commit(_embedded_chunks(store, to_embed, mark, embedding, now, steps), mark)

    number = F.lit(store.runs.version_of(mark)).cast("bigint")
    store.runs.commit(run_counts(classified, written).withColumn("version", number), mark)
    counts = store.runs.read_commit(mark)
    expire_cache(store, now, f"{mark}/expired")
    for table in (store.jobs, store.chunks, store.embedding_cache):
        table.fold()
    steps.remove()
    return counts


def reset_from_csv(store: Store, raw: DataFrame, embedding: Embedding, now: Column | None = None) -> None:
    """Empty the tables and load CSV postings; nothing is parsed, salaries are taken as they are."""
    now, mark = _at(now, store.spark), f"reset/{uuid.uuid4().hex}"
    typed = {f.name: f.dataType for f in StructType.fromDDL(schemas.JOB)}
    empty = F.array().cast("array<string>")
    given = {c: F.col(c) for c in [*schemas.RAW_JOB_COLUMNS, "content_hash"] if c != "keywords"} | {
        "id": job_id(F.col("source"), F.col("source_id")),
        "is_remote": F.coalesce("is_remote", F.lit(False)),
        "fetched_at": now,
        "created_at": now,
        **{c: empty for c in ("responsibilities", "requirements", "benefits", "skills")},
    }

    def rows_of(raw: DataFrame) -> DataFrame:
        return with_content_hash(raw).select(
            *[given.get(c, F.lit(None)).cast(typed[c]).alias(c) for c in schemas.JOB_COLUMNS]
        )

    # only postings whose key may occur again travel to meet their like
    steps, keys = _Steps(store.spark), ["source", "source_id"]
    marked = with_single(raw, keys, steps(crowded_buckets(raw.select(*keys)), "crowded_keys"))
    single, others = (rows_of(marked.filter(c).drop("_single")) for c in (F.col("_single"), ~F.col("_single")))
    truncate_and_reload(store, single.unionByName(latest_wins(others, keys, ["content_hash"])), mark)
    store.chunks.replace_all(_embedded_chunks(store, store.jobs.read(), mark, embedding, now, steps), mark)
    steps.remove()
