"""Incremental ingestion: every new page file exactly once, by the stream's own checkpoint.

The trigger takes what has landed and stops (run it every six hours, or on demand); a checkpoint admits one run at a
time. Deduplication needs no stream state: each micro-batch is compared with the stored tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallywork.operators.ranking import first_seen
from tallywork.plans.ingest import Embedding, Parser, ingest_batch
from tallywork.sinks.tables import Store
from tallywork.sources.landing import PAGE_OPTIONS, POSITION, SOURCES, Sources, make_folder, split_landed, union_sources, with_page_number


def stream_source(
    spark: SparkSession, name: str, path: str, max_files: int | None = None, sources: Sources = SOURCES
) -> DataFrame:
    schema, adapter = sources[name]
    reader = spark.readStream.schema(schema).options(**PAGE_OPTIONS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return adapter(with_page_number(reader.json(path)))


def start_ingestion(
    spark: SparkSession,
    folders: Mapping[str, str],
    store: Store,
    checkpoint: str,
    embedding: Embedding,
    parser: Parser | None = None,
    max_files: int | None = None,
    now: Column | None = None,
    sources: Sources = SOURCES,
) -> StreamingQuery:
    """Start a run over what has landed. Each batch leaves its counts (fetched, stored, skipped) in `store.runs`.

    `sources` maps a name to the schema of a page and its adapter. A missing folder is made, empty: its source brings
    nothing yet, the others go on, and the stream's checkpoint knows the same sources in every run.
    """
    for path in split_landed(spark, folders)[1]:
        make_folder(spark, folders[path])
    raw = union_sources([stream_source(spark, name, path, max_files, sources) for name, path in folders.items()])

    def handle(batch: DataFrame, batch_id: int) -> None:
        once = first_seen(batch, ["source", "source_id"], POSITION)
        ingest_batch(store, once, f"{checkpoint}#{batch_id}", embedding, parser, now)

    return (
        raw.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .queryName("posting_ingestion")
        .start()
    )


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row per key of those that arrive within `delay` of each other by `time`.

    Each key is held until the watermark has passed its expiry, so the state is that of one `delay` and not of all that was ever
    seen. It stands in front of the comparison with the stored tables, which finds what is older.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def distinct_contents(stream: DataFrame) -> DataFrame:
    """Pure stream form of content deduplication. Its state grows with the distinct contents ever seen."""
    return stream.dropDuplicates(["content_hash"])
