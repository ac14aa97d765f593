"""Writes: posting upserts and edits, chunk replacement, bookmarks, resumes, judgments, CSV export."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork import schemas
from tallywork.functions.postings import content_hash, job_id, short_id
from tallywork.operators.joins import existing_only, hot_key_join
from tallywork.operators.ranking import latest_wins
from tallywork.sinks.versioned import VersionedTable

EXPORT_COLUMNS = {
    "id": "id",
    "source_id": "sourceId",
    "source": "source",
    "title": "title",
    "company": "company",
    "location": "location",
    "description": "description",
    "url": "url",
    "job_type": "jobType",
    "min_salary": "minSalary",
    "max_salary": "maxSalary",
    "fetched_at": "fetchedAt",
    "created_at": "createdAt",
}
# What an edit may change.
PATCHABLE = [
    "title", "company", "location", "description", "url", "job_type", "min_salary", "max_salary",
]


@dataclass(frozen=True)
class Store:
    """The tables under one root folder."""

    spark: SparkSession
    root: str

    def _table(self, name: str, schema: str, *keys: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", schema, keys)

    @property
    def jobs(self) -> VersionedTable:
        return self._table("jobs", schemas.JOB, "id")

    @property
    def chunks(self) -> VersionedTable:
        """Keyed by posting: a posting's chunks are replaced together."""
        return self._table("chunks", schemas.CHUNK, "job_id")

    @property
    def favorites(self) -> VersionedTable:
        return self._table("favorites", schemas.FAVORITE, "user_id", "job_id")

    @property
    def resumes(self) -> VersionedTable:
        return self._table("resumes", schemas.RESUME, "user_id")

    @property
    def judgments(self) -> VersionedTable:
        return self._table("judgments", schemas.JUDGMENT, "judge", "query_id", "job_id")

    @property
    def runs(self) -> VersionedTable:
        """Counts of every ingestion run."""
        return self._table("runs", schemas.RUN, "version")

    @property
    def embedding_cache(self) -> VersionedTable:
        return self._table("embedding_cache", schemas.EMBEDDING_CACHE, "text_hash", "model")


# ---- postings ------------------------------------------------------------------------------------


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The stored table with the last incoming row per key put in. Incoming rows must have the stored columns."""
    last = latest_wins(incoming, keys, sequence).select(*stored.columns)
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def keep_created_at(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """An updated posting keeps the time it was first stored. The stored table is cut to the incoming ids first."""
    first = stored.select("id", F.col("created_at").alias("_created")).join(jobs.select("id"), "id", "left_semi")
    return (
        jobs.join(first, "id", "left")
        .withColumn("created_at", F.coalesce("_created", "created_at"))
        .drop("_created")
    )


def manual_jobs(rows: DataFrame, now: Column) -> DataFrame:
    """Postings entered by hand: their content hash gives id and source id."""
    full = content_hash(F.col("title"), F.col("company"), F.col("description"), F.col("location"))
    empty = F.array().cast("array<string>")
    made = rows.withColumn("content_hash", full).withColumn("source_id", short_id(F.col("content_hash")))
    given = {c: F.col(c) for c in PATCHABLE} | {
        "source_id": F.col("source_id"),
        "source": F.lit("manual"),
        "content_hash": F.col("content_hash"),
        "id": job_id(F.lit("manual"), F.col("source_id")),
        "is_remote": F.lit(False),
        "fetched_at": now,
        "created_at": now,
        **{c: empty for c in ("responsibilities", "requirements", "benefits", "skills")},
    }
    typed = dict(part.split(" ", 1) for part in schemas.JOB.split(", "))
    return made.select(*[given.get(c, F.lit(None)).cast(typed[c]).alias(c) for c in schemas.JOB_COLUMNS])


def fold_patches(changes: DataFrame) -> DataFrame:
    """One patch per id: for each column the last given value."""
    last = [
        F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        for c in PATCHABLE
    ]
    return changes.filter("op = 'patch'").groupBy("id").agg(*last)


def apply_changes(jobs: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to add or replace, ids to delete) for a table of changes.

    `changes`: op (insert, patch, delete), id, seq and the patchable columns. A patch's null means "unchanged". Patches
    and deletes of unknown ids change nothing; an id both patched and deleted is deleted.
    """
    deleted = changes.filter("op = 'delete'").select("id").distinct()
    patches = fold_patches(changes).join(deleted, "id", "left_anti")
    renamed = patches.select("id", *[F.col(c).alias(f"_{c}") for c in PATCHABLE])
    patched = jobs.join(renamed, "id", "inner")
    for c in PATCHABLE:
        patched = patched.withColumn(c, F.coalesce(f"_{c}", c))
    patched = patched.select(*schemas.JOB_COLUMNS)
    inserted = latest_wins(
        manual_jobs(changes.filter("op = 'insert'"), now).withColumn("seq", F.lit(0)), ["id"], ["seq"]
    ).drop("seq")
    return patched.unionByName(inserted.join(deleted, "id", "left_anti")), deleted


def edit_postings(store: Store, changes: DataFrame, now: Column, mark: str | None = None) -> None:
    """Apply a table of changes to the store. What is deleted takes its chunks and bookmarks along.

    `mark` names the edit, so that one applied again does not count twice.
    """
    mark = uuid.uuid4().hex if mark is None else mark
    jobs = store.jobs.read(before=store.jobs.version_of(mark))
    written, deleted = apply_changes(jobs, changes, now)
    gone = deleted.withColumnRenamed("id", "job_id")
    saved = store.favorites.read(before=store.favorites.version_of(mark))
    bookmarks = saved.join(gone, "job_id", "left_semi").select("user_id", "job_id")
    store.favorites.commit(saved.limit(0), mark, bookmarks)
    store.chunks.commit(store.spark.createDataFrame([], schemas.CHUNK), mark, gone)
    store.jobs.commit(written, mark, deleted)


def apply_bookmarks(store: Store, events: DataFrame, mark: str | None = None) -> None:
    """Apply a table of save and unsave events to the store; those for unknown postings are left out."""
    mark = uuid.uuid4().hex if mark is None else mark
    known = existing_only(events, store.jobs.read().select(F.col("id").alias("job_id")), "job_id", ["seq"])
    written, gone = bookmark_state(store.favorites.read(before=store.favorites.version_of(mark)), known)
    store.favorites.commit(written, mark, gone)


def truncate_and_reload(store: Store, jobs: DataFrame, mark: str) -> None:
    """Replace every posting; chunks go with their postings."""
    store.chunks.replace_all(store.spark.createDataFrame([], schemas.CHUNK), f"{mark}/empty")
    store.jobs.replace_all(jobs, mark)


def export_csv(jobs: DataFrame, path: str, compression: str = "none") -> None:
    """All postings as quoted CSV with a header; nulls become empty fields, arrays `, `-joined text.

    `compression` is a codec of Spark's CSV files, such as gzip, which `read_csv_rows` reads as well.
    """
    types = dict(jobs.dtypes)
    columns = [
        (F.array_join(name, ", ") if types[name].startswith("array") else F.col(name).cast("string")).alias(header)
        for name, header in EXPORT_COLUMNS.items()
    ]
    (
        jobs.select(*columns)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("compression", compression)
        .csv(path)
    )


# ---- chunks --------------------------------------------------------------------------------------


def chunk_rows(chunks: DataFrame, model: str, now: Column) -> DataFrame:
    """Stored form of (job_id, pos, chunk_type, chunk_text, embedding)."""
    return chunks.select(
        F.sha2(F.concat_ws("|", "job_id", F.col("pos").cast("string"), "chunk_text"), 256).alias("id"),
        "job_id",
        "chunk_type",
        "chunk_text",
        F.lit(model).alias("embedding_model"),
        F.lit(K.EMBEDDING_VERSION).alias("embedding_version"),
        now.alias("created_at"),
        "embedding",
    )


def replace_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table with the chunks of the new rows' postings replaced as a whole."""
    replaced = new.select("job_id").distinct()
    return stored.join(replaced, "job_id", "left_anti").unionByName(new.select(*stored.columns))


# ---- bookmarks, resumes, judgments ---------------------------------------------------------------


def bookmark_state(saved: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs to write, pairs to delete) after a table of save/unsave events (user_id, job_id, action, ts, seq).

    Saving again keeps the first time since the last unsave; a pair whose last event is unsave is deleted.
    """
    keys = ["user_id", "job_id"]
    order = F.struct("ts", "seq")
    per_pair = events.groupBy(*keys).agg(
        F.max(F.when(F.col("action") == "unsave", order)).alias("last_unsave"),
        F.max(F.when(F.col("action") == "save", order)).alias("last_save"),
    )
    gone = per_pair.filter(
        F.col("last_unsave").isNotNull()
        & (F.col("last_save").isNull() | (F.col("last_unsave") > F.col("last_save")))
    ).select(*keys)
    saves = hot_key_join(
        events.filter("action = 'save'"), per_pair.select(*keys, "last_unsave"), keys, "inner", ["seq"]
    ).filter(F.col("last_unsave").isNull() | (order > F.col("last_unsave")))
    first = saves.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("last_unsave").isNotNull().alias("_reset"))
    kept = saved.select(*keys, "saved_at")
    written = first.join(kept, keys, "left").select(
        *keys, F.when(F.col("_reset"), F.col("_first")).otherwise(F.coalesce("saved_at", "_first")).alias("saved_at")
    )
    return written, gone


def upsert_resumes(store: Store, resumes: DataFrame, sequence: list[str], mark: str | None = None) -> None:
    """One resume per user, the last one given; vectors of another width are refused when embedded."""
    store.resumes.commit(latest_wins(resumes, ["user_id"], sequence), mark)


def record_judgments(store: Store, verdicts: DataFrame, sequence: list[str], mark: str | None = None) -> None:
    """Add verdicts; the last per judge, question and posting wins."""
    store.judgments.commit(latest_wins(verdicts, ["judge", "query_id", "job_id"], sequence), mark)


def clear_judgments(store: Store) -> None:
    store.judgments.replace_all(store.spark.createDataFrame([], schemas.JUDGMENT))


def expire_cache(store: Store, now: Column, mark: str | None = None, days: int = K.EMBEDDING_CACHE_DAYS) -> bool:
    """Drop cached vectors of `days` and older, and all but the newest of a text and model; returns whether there were any of age."""
    cache = store.embedding_cache.read()
    fresh = F.col("cached_at") > now - F.make_dt_interval(F.lit(days))
    if cache.filter(~fresh).isEmpty():
        return False
    store.embedding_cache.replace_all(latest_wins(cache.filter(fresh), ["text_hash", "model"], ["cached_at"]), mark)
    return True


def judgment_counts(judgments: DataFrame) -> DataFrame:
    """Stored verdicts by judge."""
    return judgments.groupBy("judge").agg(F.count(F.lit(1)).alias("judgments"))
