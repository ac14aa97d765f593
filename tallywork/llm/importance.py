"""Importance resampling towards a target set by hashed word features.

Words come from the tokenizers library: an untrained `Split` by a pattern over ASCII-lowered text returns words with offsets. Runs
of 1 to 3 consecutive words, each an extension of the run one word shorter by the bytes of the next offset pair, are hashed by CRC-32
into a fixed number of buckets. Histograms of the corpus and of the target give each bucket a gain, a document weighs the sum of the
gains of its features, and the highest weights under fixed Gumbel noise are drawn, which is sampling without replacement in
proportion to the exponents of the weights.

Texts are read twice, for the histogram and for the weights; what lies between is one number per bucket. Features are never stored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import in_pieces, ranked, release, settings, staged

# What stands between words: ASCII that is neither a digit nor a lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
# Texts are split in pieces of about this many letters, each ending where a word ends: the library keeps some dozens of bytes per byte.
PIECE = 2048


@dataclass(frozen=True)
class Sampling:
    """Features (`words` per run at most, `buckets`), and the draw (`percent` of documents of at least `min_words`, by `seed`)."""

    words: int = 3
    buckets: int = 10_000
    percent: int = 5
    min_words: int = 20
    seed: int = 42


def _splitter() -> Callable[[str], list[tuple[int, int]]]:
    """From a text to the byte offsets of its words."""
    from tokenizers import PreTokenizedString, Regex, pre_tokenizers

    pattern = pre_tokenizers.Split(Regex(BETWEEN), "removed")

    def split(text: str) -> list[tuple[int, int]]:
        cut = PreTokenizedString(text)
        pattern.pre_tokenize(cut)
        return [offsets for _, offsets, _ in cut.get_splits("original", "byte")]

    return split


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        cut = _BETWEEN.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def features(split: Callable[[str], list[tuple[int, int]]], text: str | None, longest: int) -> Iterator[tuple[int, list[int]]]:
    """Per piece of a text: its number of words and the CRC-32 of every run of up to `longest` words that ends in it."""
    before: list[int] = []  # of the runs of 1, 2, … words that end with the last word
    # of bytes, lower() changes A-Z alone
    for piece in _pieces((text or "").encode().lower().decode()):
        spans = split(piece)
        if not spans:
            continue
        raw = piece.encode()
        words = [raw[start:end] for start, end in spans]
        further = [b" " + word for word in words]
        runs = list(map(crc32, words))
        found, ends = list(runs), [runs[-1]]
        for width in range(1, longest):
            shorter = before[width - 1 : width] + runs[:-1]
            if not shorter:
                break
            runs = list(map(crc32, further[len(further) - len(shorter) :], shorter))
            found += runs
            ends.append(runs[-1])
        before = ends
        yield len(words), found


def histogram(texts: DataFrame, sampling: Sampling = Sampling()) -> list[int]:
    """How many features of all `text` rows fall into each bucket; one row per bucket reaches the driver."""
    buckets, longest = sampling.buckets, sampling.words
    out = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        split, total, held = _splitter(), np.zeros(buckets, np.int64), []

        def count() -> None:
            total[:] += np.bincount(np.array(held, np.int64) % buckets, minlength=buckets)
            held.clear()

        for batch in batches:
            for text in batch.column("text"):
                for _, found in features(split, text.as_py(), longest):
                    held += found
                    if len(held) > 500_000:
                        count()
        count()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=out)

    settings(texts.sparkSession)
    counts = texts.select(texts["text"].alias("text")).mapInArrow(run, "bucket INT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {row.bucket: row.n for row in counts.collect()}
    return [found.get(bucket, 0) for bucket in range(buckets)]


def gains(corpus: Sequence[int], target: Sequence[int]) -> list[int]:
    """Per bucket floor(1000 ln) of the target's smoothed share over the corpus' one."""
    all_corpus, all_target = float(sum(corpus) + len(corpus)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in zip(corpus, target, strict=True)]


def noise(seed: int, doc_id: int | None) -> int:
    """floor(1000 g) of a standard Gumbel number g that seed and id fix; a null id counts as an empty one."""
    drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: Sequence[int], sampling: Sampling = Sampling()) -> DataFrame:
    """`doc_id`, `n_words`, `n_features`, `weight` and `score` (weight plus noise) of every row of `docs`."""
    longest, buckets, seed = sampling.words, sampling.buckets, sampling.seed
    gain = np.array(gain, np.int64)
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    out = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        split = _splitter()

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    n_words = n_features = weight = 0
                    for words, found in features(split, text.as_py(), longest):
                        n_words += words
                        n_features += len(found)
                        weight += int(gain[np.array(found, np.int64) % buckets].sum())
                    yield doc_id, n_words, n_features, weight, weight + noise(seed, doc_id)

        return in_pieces(each(), out, lambda row: 64)

    settings(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{name} BIGINT" for name in names))


def resample(docs: DataFrame, target: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Every row of `docs` (`doc_id`, `text`) weighed against the texts of `target`: `doc_id`, `n_words`, `n_features`, `weight`,
    `score` and `rank`, which is null unless the row is drawn.

    Drawn are floor(percent N / 100) of the N rows with at least `min_words` words, by score, ties to the smaller doc_id (null
    first). A null or empty text has no features, weight 0 and is never drawn. Repeated rows are rows of their own, with
    neighbouring ranks. Empty tables count as such: without a target each gain is the corpus' own smoothing, without documents there
    are no rows. Columns other than doc_id and text play no part.
    """
    scored = staged(weigh(docs, gains(histogram(docs, sampling), histogram(target, sampling)), sampling), "importance")
    scored = scored.withColumn("_open", F.col("n_words") >= sampling.min_words)
    draw = scored.filter("_open").count() * sampling.percent // 100
    placed = ranked(scored, ["_open"], [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")], "_place")
    rank = F.when(F.col("_open") & (F.col("_place") <= draw), F.col("_place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
