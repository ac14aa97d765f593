"""Token ids on disk: one zstandard frame per document, a dictionary shared by all, and an offset index per shard.

A folder holds two Parquet tables, written and read by Spark, so it may lie in any store Spark reaches:

* `dictionary`: one row, `hash` (SHA-256 of the content in hex) and `content`, at most `DICTIONARY_BYTES`;
* `shards`: rows of bounded size in ascending order of `shard`. A shard holds `doc_ids` in ascending order, `counts` (ids per
  document), `frames` (the frames end to end), `offsets` (where each frame starts, and the end), `width` (bytes per id, 2 or
  4, little-endian), `n_tokens` of the whole shard and `dictionary`, the hash of the dictionary its frames need.

A single short document is read by its offset, without the rest of its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.common import forget, gathered, in_pieces, per_process, read_vocabulary, running_total, settings, staged
from tallywork.llm.segments import BEHIND_ROOM, IDS, BatchEncoder, LibrarySegments, TextEncoder
from tallywork.operators.joins import bounded_join, row_bound

# The dictionary is trained on at most this many documents (those of the lowest hash), of each at most this many ids.
SAMPLE_DOCUMENTS = 2000
SAMPLE_IDS = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
# A shard is closed at whichever comes first; one document may be larger than this and is then a shard of its own.
SHARD_BYTES = 4 << 20
SHARD_DOCUMENTS = 8192

SHARD = (
    "shard BIGINT, doc_ids ARRAY<BIGINT>, counts ARRAY<BIGINT>, offsets ARRAY<BIGINT>, frames BINARY, width INT, "
    "n_tokens BIGINT, dictionary STRING"
)
DICTIONARY = "hash STRING, content BINARY"


def encoder(path: str, vocabulary: bytes) -> BatchEncoder:
    """The worker's encoder by the tokenizers library."""

    def make() -> BatchEncoder:
        segments = LibrarySegments(vocabulary)
        return BatchEncoder(TextEncoder(segments.match, segments.encode, segments.word, BEHIND_ROOM))

    return per_process(("library", path, len(vocabulary)), make)


def _encoded(docs: DataFrame, path: str, end_id: int | None, finish: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """`key`, `n_tokens` and what a function made in the task, `finish()`, makes of the packed ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    out = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, finished = encoder(path, vocabulary.value), finish()

        def each() -> Iterator[tuple]:
            for batch in gathered(batches):
                for key, ids in zip(batch.column("key").to_pylist(), texts.encode(batch.column("text")), strict=True):
                    ids += end
                    yield key, len(ids) // 4, finished(ids)

        return in_pieces(each(), out, lambda row: len(row[2]))

    rows = docs.select(docs["doc_id"].alias("key"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "key BIGINT, n_tokens BIGINT, data BINARY")


def encode(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """`doc_id`, `n_tokens` and packed 32-bit `ids` of whole texts by the tokenizers file at `path`, with `end_id` appended.

    A null text is empty and has the end id alone. Rows are encoded one by one.
    """
    return _encoded(docs, path, end_id, lambda: bytes).withColumnsRenamed({"key": "doc_id", "data": "ids"})


def width_of(path: str) -> int:
    """Bytes per stored id: two if the vocabulary has no larger id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(read_vocabulary(path).decode()).get_vocab_size() <= 1 << 16 else 4


def serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, IDS).astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str, end_id: int | None, width: int) -> bytes:
    """A dictionary from the serialized ids of a bounded sample; empty if there is too little to learn from.

    The sample is at most `SAMPLE_DOCUMENTS` rows with at most `SAMPLE_IDS` ids each, so at most 16 MB reach the driver.
    """
    order = F.xxhash64("doc_id", F.lit(5))
    # the highest hash of the sample first, so that no text is sorted
    last = docs.select(order.alias("hash")).orderBy("hash").limit(SAMPLE_DOCUMENTS).agg(F.max("hash")).first()[0]
    if last is None:
        return b""
    picked = docs.filter(order <= last).limit(SAMPLE_DOCUMENTS)
    ids = encode(picked, path, end_id).select(F.substring("ids", 1, 4 * SAMPLE_IDS).alias("ids"))
    samples = sorted(serialized(bytes(row["ids"]), width) for row in ids.collect())
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 8192:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes()
    except zstandard.ZstdError:  # samples all alike
        return b""


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content) if content else None, write_checksum=True
    )


def _decompressor(content: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = None) -> None:
    """Encode `doc_id` and `text` of `docs` and write the folder. Null doc_ids come first; repeated rows are all kept."""
    spark = settings(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    width = width_of(path)
    content = train_dictionary(docs, path, end_id, width)
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(name, bytearray(content))], DICTIONARY).coalesce(1).write.parquet(f"{folder}/dictionary")

    # frames before the sort, so that compressed ids travel and not texts; once on disk, as a sort by ranges reads twice
    def compress() -> Callable[[bytes], bytes]:
        compressor = _compressor(content)
        return lambda ids: compressor.compress(serialized(ids, width))

    frames = staged(_encoded(docs, path, end_id, compress), "frames")
    ordered = frames.repartitionByRange("key", "n_tokens", F.xxhash64("data")).sortWithinPartitions("key", "n_tokens", "data")
    _shards(ordered, name, width).write.parquet(f"{folder}/shards")
    forget(frames)


def _shards(ordered: DataFrame, dictionary: str, width: int) -> DataFrame:
    many = pa.list_(pa.int64())
    out = pa.schema(
        [
            ("shard", pa.int64()), ("doc_ids", many), ("counts", many), ("offsets", many), ("frames", pa.binary()),
            ("width", pa.int32()), ("n_tokens", pa.int64()), ("dictionary", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def shards() -> Iterator[tuple]:
            number, size, held = first, 0, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (size + len(row[2]) > SHARD_BYTES or len(held) >= SHARD_DOCUMENTS):
                        yield _shard(number, held, width, dictionary)
                        number, size, held = number + 1, 0, []
                    held.append(row)
                    size += len(row[2])
            if held:
                yield _shard(number, held, width, dictionary)

        return in_pieces(shards(), out, lambda row: len(row[4]), most=1)

    return ordered.mapInArrow(run, SHARD)


def _shard(number: int, rows: list[tuple], width: int, dictionary: str) -> tuple:
    keys, counts, frames = zip(*rows, strict=True)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
    return number, list(keys), list(counts), offsets, b"".join(frames), width, sum(counts), dictionary


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a folder: `doc_id`, `start` (ids of all documents before it), `n_tokens`, packed 32-bit `ids`."""
    settings(spark)
    content = _dictionary(spark, folder)
    shards = spark.read.schema(SHARD).parquet(f"{folder}/shards")
    starts = running_total(shards.select("shard", "n_tokens"), "shard", "n_tokens", "before").select("shard", "before")
    # one row per shard of some megabytes: broadcast while they are few
    found = bounded_join(_documents(shards, content), starts, "shard", "inner", row_bound(shards.select("shard")))
    return found.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """`doc_id`, `n_tokens` and `ids` of some documents: only their frames are decompressed, found by the offset index."""
    shards = spark.read.schema(SHARD).parquet(f"{folder}/shards")
    spots = shards.select(
        "shard", "frames", "width", "dictionary", "offsets", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("at", "doc")
    ).filter(F.col("doc.doc_ids").isin([int(d) for d in doc_ids]))
    size = F.element_at("offsets", F.col("at") + 2) - F.element_at("offsets", F.col("at") + 1)
    one = spots.select(
        "shard",
        F.array("doc.doc_ids").alias("doc_ids"),
        F.array("doc.counts").alias("counts"),
        F.array(F.lit(0).cast("bigint"), size).alias("offsets"),
        F.substring("frames", F.element_at("offsets", F.col("at") + 1).cast("int") + 1, size.cast("int")).alias("frames"),
        "width",
        F.col("doc.counts").alias("n_tokens"),
        "dictionary",
    )
    return _documents(one, _dictionary(spark, folder)).select("doc_id", "n_tokens", "ids")


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    """The one row of the dictionary table, checked against its hash."""
    rows = spark.read.schema(DICTIONARY).parquet(f"{folder}/dictionary").limit(2).collect()
    content = bytes(rows[0]["content"])
    if len(rows) != 1 or hashlib.sha256(content).hexdigest() != rows[0]["hash"]:
        raise ValueError(f"{folder}/dictionary does not hold one dictionary that fits its hash")
    return rows[0]["hash"], content


def _documents(shards: DataFrame, dictionary: tuple[str, bytes]) -> DataFrame:
    """The documents of shards; `inside` counts the ids before each in its shard."""
    name, content = dictionary
    out = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _decompressor(content).decompress

        def each() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["dictionary"] != name:
                        raise ValueError(f"shard {row['shard']} was written with another dictionary")
                    inside, frames, kind = 0, memoryview(row["frames"]), f"<u{row['width']}"
                    for at, (doc_id, count) in enumerate(zip(row["doc_ids"], row["counts"], strict=True)):
                        plain = decompress(frames[row["offsets"][at] : row["offsets"][at + 1]])
                        ids = np.frombuffer(plain, kind)
                        if len(ids) != count:
                            raise ValueError(f"shard {row['shard']}: {len(ids)} ids in place of {count}")
                        yield row["shard"], doc_id, inside, count, ids.astype(IDS).tobytes()
                        inside += count

        return in_pieces(each(), out, lambda row: len(row[4]))

    return shards.mapInArrow(run, "shard BIGINT, doc_id BIGINT, inside BIGINT, n_tokens BIGINT, ids BINARY")
