"""Helpers the operators share: settings, worker state, staged tables, running sums."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywork.operators.joins import bounded_join, row_bound
from tallywork.session import shared_folder

# A vocabulary file above this size is not sent to the tasks.
VOCABULARY_BYTES = 64 << 20
# Arrow batches end at whichever comes first, so that a task holds a few megabytes of text and not ten thousand long ones.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def settings(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python tasks receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process makes once and keeps for its later tasks: compiled vocabularies and caches of bounded size.

    A worker serves one operator after another; only the state of the last one is kept.
    """
    state = _worker_state()
    if key not in state:
        release()
        state[key] = make()
    return state[key]


def release() -> None:
    """Drop what an earlier operator left in this worker; operators without state of their own start with this."""
    state = _worker_state()
    if state:
        state.clear()
        gc.collect()


def _worker_state() -> dict:
    module = sys.modules.setdefault("_tallywork_worker", types.ModuleType("_tallywork_worker"))
    return module.__dict__.setdefault("state", {})


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return data


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read back: a step that several later ones read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._staged_path
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def running_total(df: DataFrame, order: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """Adds the sum of `value` over all rows of lower `order` (a whole number, unique).

    Blocks of `order` are summed first, so that no task sees more than the blocks or one block.
    """
    blocks = df.groupBy(F.floor(F.col(order) / block).alias("_block")).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_inside", F.coalesce(inside, F.lit(0)))
    return rows.join(blocks, "_block").withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row, from 1, among those of its `group` (columns without nulls) by `order`.

    Rows are sorted by ranges over all tasks and numbered there; the counts of the ranges, one row per range and group, give what
    stands before each. So a group of any size is spread over tasks, unlike in a window. Ties beyond `order` are dealt out as they come.
    """
    by = [*(F.col(c).asc() for c in group), *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    # written once, as the bounds of ranges are sampled anew each time
    placed = staged(placed, "placed").withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_range", *group).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    placed = bounded_join(placed, ranges, ["_range", *group], "inner", row_bound(ranges))
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_first", "_before")


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch], least: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold `least` bytes, for work that gains from many rows at once. Larger ones are cut by rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rows = max(1, batch.num_rows * least // max(least, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            size += held[-1].nbytes
            if size >= least:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def in_pieces(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded weight."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= most or len(held) >= BATCH_ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
