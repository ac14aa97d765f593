"""Phrases whose words stand together more often than their parts explain.

Every word starts one window: itself and the words behind it, up to the longest phrase, padded with nulls where the piece ends. Only
these longest windows are counted; a ROLLUP over the columns of the window sums ever shorter prefixes, which are the counts of all
shorter phrases, of single words and of all words of a language. No phrase is taken from the texts by its length.

A window also ends before a pair or a triple of words that cannot be frequent, and one of a rare word counts for the total alone.
That is known beforehand: single words and pairs, then triples of frequent pairs, are counted in a fixed number of hash buckets, and
the buckets that reach the least count travel to the tasks as one bit each, 16 MB at any size of the input. What is frequent is
never in a bucket below that count, and all parts of a frequent phrase are frequent, so the counts of frequent phrases stay exact.
With more text more buckets reach the count and windows get longer, up to all of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import ranked, release, settings, staged
from tallywork.operators.joins import bounded_join, row_bound

BREAKS = b".,;:!?\n\x0b\x0c\r"
# ASCII letters lowered, what ends a piece as \n, tabs as blanks.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(BREAKS) + b" ")
# Bits of the hash of a word, pair or triple. 2^27 buckets are 16 MB as bits.
HASH_BITS = 27
BLOCK = 32_768  # bits in one row of Spark's bitmap aggregate
# A task looks at this many bytes of words at a time, and forgets its words beyond this many.
CHUNK = 4 << 20
VOCABULARY = 200_000
GAP, END = 0, 1


@dataclass(frozen=True)
class Mining:
    """Least count and longest length of candidates, share of a longer phrase that drops a candidate, phrases kept per language."""

    least: int = 100
    longest: int = 5
    drop_percent: int = 100
    top: int = 2000


class _Words(dict):
    """Numbers for words, with the words and a hash of each."""

    def __init__(self):
        super().__init__({b"": GAP, b"\n": END})
        self.words, self.hashes = [b"", b"\n"], [0, 0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


@dataclass
class _Stretch:
    """Numbers of words and of ends of pieces in a stretch of text, the language at each, and how many of them are to start windows."""

    words: list[bytes]
    hashes: np.ndarray
    langs: list[str]
    numbers: np.ndarray
    lang: np.ndarray
    starts: int

    def buckets(self, size: int) -> np.ndarray:
        """The bucket of the `size` words from each place on that has so many places behind it."""
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=size) for x in self.langs], np.uint64)
        places, words = max(0, len(self.numbers) - size + 1), self.hashes[self.numbers]
        mixed = seeds[self.lang[:places]]
        for k in range(size):
            mixed = (mixed ^ words[k : places + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def open(self, size: int, frequent: np.ndarray | None = None) -> np.ndarray:
        """For every place whether `size` words without an end follow, in a bucket that is frequent."""
        found = np.zeros(len(self.numbers), bool)
        buckets = self.buckets(size)
        places = len(buckets)
        found[:places] = np.all([self.numbers[k : places + k] > END for k in range(size)], axis=0)
        if frequent is not None:
            found[:places] &= ((frequent[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1).astype(bool)
        return found

    def spelled(self, numbers: np.ndarray) -> pa.Array:
        """The words, null for what is none."""
        return pa.array(self.words, pa.binary()).cast(pa.string()).take(pa.array(numbers, mask=numbers <= END))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """Lowered texts by language, some megabytes at a time. A longer text is cut between words; True if it goes on."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data, start = (text or "").encode().translate(_TABLE), 0
            while len(data) - start > CHUNK:
                ends = [e for e in (data.find(c, start + CHUNK) for c in (b" ", b"\n")) if e >= 0]
                if not ends:  # one huge word
                    break
                yield [(lang, data[start : min(ends)])], True
                start = min(ends)
            held.append((lang, data[start:]))
            size += len(data) - start
            if start or size >= CHUNK:
                yield held[::-1] if start else held, False  # the rest of a long text first
                held, size = [], 0
    yield held, False


def _stretches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Stretch]:
    """The last words of a text that goes on stand before the next stretch once more, to start their windows there."""
    vocabulary, before = _Words(), b""
    for texts, goes_on in _texts(batches):
        if len(vocabulary) > VOCABULARY:
            vocabulary = _Words()
        index: dict[str, int] = {}
        numbers, langs = [], []
        for lang, data in texts:
            words = (before + data + (b"" if goes_on else b"\n")).replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
            numbers.append(found[found != GAP])
            langs.append(np.full(len(numbers[-1]), index.setdefault(lang, len(index)), np.int32))
            before = b""
        if numbers:
            numbers, langs = np.concatenate(numbers), np.concatenate(langs)
            starts = max(0, len(numbers) - longest + 1) if goes_on else len(numbers)
            yield _Stretch(vocabulary.words, np.array(vocabulary.hashes, np.uint64), list(index), numbers, langs, starts)
            if goes_on:
                before = b" ".join(vocabulary.words[i] for i in numbers[starts:]) + b" "


def _rows(docs: DataFrame) -> DataFrame:
    settings(docs.sparkSession)
    return docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"].alias("text"))


def _sliced(columns: list, schema: pa.Schema, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
    yield from table.to_batches(max_chunksize=rows)


def _bits(counts: DataFrame, least: int) -> bytes:
    """One bit per `bucket`: whether its counts `n` sum up to `least`. At most 2^HASH_BITS bits reach the driver."""
    place = F.col("bucket").cast("bigint") + 1
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    blocks = sums.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(((1 << HASH_BITS) // BLOCK, BLOCK // 8), np.uint8)
    for row in blocks.collect():
        bits[row.block - 1] = np.frombuffer(row.bits, np.uint8)
    return bits.tobytes()


_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def frequent_pairs(docs: DataFrame, least: int) -> bytes:
    """Bits of the single words and pairs that may occur `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for stretch in _stretches(batches, 2):
            found = []
            for size in (1, 2):
                starts = np.flatnonzero(stretch.open(size)[: stretch.starts])
                found.append(stretch.buckets(size)[starts])
            yield from _sliced(list(np.unique(np.concatenate(found), return_counts=True)), _COUNTS)

    return _bits(_rows(docs).mapInArrow(run, "bucket INT, n BIGINT"), least)


def frequent_triples(docs: DataFrame, pairs: bytes, least: int) -> bytes:
    """Bits of the triples that may occur `least` times, among those of two frequent pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        frequent = np.frombuffer(shared.value, np.uint8)
        for stretch in _stretches(batches, 3):
            pair = stretch.open(2, frequent)
            pair[:-1] &= pair[1:]
            starts = np.flatnonzero((stretch.open(3) & pair)[: stretch.starts])
            yield from _sliced(list(np.unique(stretch.buckets(3)[starts], return_counts=True)), _COUNTS)

    return _bits(_rows(docs).mapInArrow(run, "bucket INT, n BIGINT"), least)


def windows(docs: DataFrame, pairs: bytes, triples: bytes, longest: int) -> DataFrame:
    """`lang`, `w1` … `w<longest>`, `n`: padded windows and how often they start, single words summed up within a stretch."""
    shared = docs.sparkSession.sparkContext.broadcast((pairs, triples))
    names = [f"w{i}" for i in range(1, longest + 1)]
    out = pa.schema([("lang", pa.string()), *((name, pa.string()) for name in names), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pairs, triples = (np.frombuffer(bits, np.uint8) for bits in shared.value)
        for stretch in _stretches(batches, longest):
            word, pair, triple = stretch.open(1, pairs), stretch.open(2, pairs), stretch.open(3, triples)
            padding = np.zeros(longest, bool)
            pair, triple = np.append(pair, padding), np.append(triple, padding)
            following = np.append(stretch.numbers, np.zeros(longest, np.int32))
            start = np.flatnonzero(stretch.numbers[: stretch.starts] > END)
            goes = word[start]
            # the lead columns: the words behind each start, padded from the first that cannot be part of a frequent phrase on
            columns = [stretch.lang[start], np.where(goes, following[start], GAP)]
            for k in range(1, longest):
                goes = goes & pair[start + k - 1]
                if k > 1:
                    goes &= triple[start + k - 2]
                columns.append(np.where(goes, following[start + k], GAP))
            several = columns[2] > END if longest > 1 else np.zeros(len(start), bool)
            # single words are many times the same, so they are counted here; Spark sums up the rest before it is shuffled
            alone = np.flatnonzero(~several)
            pairs_of, counts = np.unique((columns[0][alone].astype(np.int64) << 32) | columns[1][alone], return_counts=True)
            blank = np.zeros(len(counts), np.int32)
            single = [(pairs_of >> 32).astype(np.int32), (pairs_of & 0xFFFFFFFF).astype(np.int32), *[blank] * (longest - 1)]
            for found, n in ((single, counts), ([c[several] for c in columns], np.ones(int(several.sum()), np.int64))):
                spelled = [pa.array(stretch.langs, pa.string()).take(pa.array(found[0])), *map(stretch.spelled, found[1:])]
                yield from _sliced([*spelled, n], out)

    return _rows(docs).mapInArrow(run, "lang STRING, " + ", ".join(f"{n} STRING" for n in names) + ", n BIGINT")


def phrases(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """`lang`, `size` (words), `phrase`, `words` and `n` (occurrences) of all phrases of up to `longest` words that occur `least` times.

    Size 0 holds the count of all words of each language, whatever it is.
    """
    names = [f"w{i}" for i in range(1, mining.longest + 1)]
    pairs = frequent_pairs(docs, mining.least)
    rows = windows(docs, pairs, frequent_triples(docs, pairs, mining.least), mining.longest)
    top = staged(rows.groupBy("lang", *names).agg(F.sum("n").alias("n")), "windows")
    # the windows of each length by a ROLLUP over their own columns, so that padding is no prefix
    length = F.size(F.array_compact(F.array(*names)))
    prefixes = []
    for size in range(mining.longest + 1):
        shorter = top.filter(length == size).rollup("lang", *names[:size]).agg(F.sum("n").alias("n"), F.grouping_id().alias("blanked"))
        words = F.concat_ws(" ", *names[:size]) if size else F.lit("")
        prefixes.append(shorter.select("lang", (F.lit(size) - F.bit_count("blanked")).alias("size"), words.alias("phrase"), "n"))
    summed = reduce(DataFrame.unionByName, prefixes).filter("size >= 0").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    summed = summed.filter((F.col("size") == 0) | (F.col("n") >= mining.least))
    return summed.withColumn("words", F.split("phrase", " "))


def mine(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """The best phrases of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Words are lowered (A-Z) runs without blank and tab inside pieces that end at `. , ; : ! ?` or a line break. Candidates have 2
    to `longest` words and a = `least` occurrences at least, overlaps included. Of the cuts into a first part (l occurrences) and a
    rest (r) the one of the lowest floor(1000 a n / (l r)) counts, then the one with the shortest first part; n counts all words of
    the language. A candidate goes if a longer one holds it with `drop_percent` per cent of its occurrences at least. `top` are kept
    by score, a and phrase.

    A null language is `und`, one with texts of that name; null and empty texts have no words; repeated rows count each time. An
    empty table gives no rows. Columns other than lang and text play no part.
    """
    known = staged(phrases(docs, mining), "phrases")
    candidates = known.filter(F.col("size") >= 2).withColumnRenamed("n", "a")
    return _best(_scored(_kept(candidates, mining), known), mining)


def _kept(candidates: DataFrame, mining: Mining) -> DataFrame:
    """Without those that a longer candidate explains."""
    if mining.longest < 3:
        return candidates
    spans = [(at, size) for size in range(2, mining.longest) for at in range(1, mining.longest - size + 2)]
    inside = F.filter(
        F.array(*[F.struct(F.lit(at).alias("at"), F.lit(size).alias("size")) for at, size in spans]),
        lambda s: (s["size"] < F.size("words")) & (s["at"] + s["size"] <= F.size("words") + 1),
    )
    held = candidates.filter(F.col("size") > 2).select("lang", "words", "a", F.explode(inside).alias("s"))
    part = F.array_join(F.slice("words", F.col("s.at"), F.col("s.size")), " ")
    longer = held.groupBy("lang", part.alias("phrase")).agg(F.max("a").alias("_longer"))
    explained = F.col("_longer") * 100 >= F.col("a") * mining.drop_percent
    return candidates.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(explained, F.lit(False))).drop("_longer")


def _scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """With the counts of the deciding cut. Whole numbers of up to 38 digits, as products pass 64 bits."""
    parts = known.filter(F.col("size") >= 1)
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("_first"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("_rest"),
    )
    for name, count in (("_first", "l"), ("_rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count)), ["lang", name])
    totals = known.filter(F.col("size") == 0).select("lang", "n")
    cuts = bounded_join(cuts, totals, "lang", "inner", row_bound(totals))
    wide = {c: f"CAST({c} AS DECIMAL(18,0))" for c in ("a", "n", "l", "r")}
    score = F.expr("({a} * {n} * CAST(1000 AS DECIMAL(4,0))) div ({l} * {r})".format(**wide))
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n"))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("best")).select("lang", "phrase", "a", "best.*")


def _best(scored: DataFrame, mining: Mining) -> DataFrame:
    placed = ranked(staged(scored, "scored"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank")
    return placed.filter(F.col("rank") <= mining.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
