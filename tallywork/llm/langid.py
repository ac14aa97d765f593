"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything that is no letter becomes one blank, so that n-grams see word boundaries. An n-gram's hash
is its bucket. The model is a matrix of log probabilities, buckets by languages, small enough to be broadcast; a document's
scores are its sparse bucket counts times the matrix.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import in_pieces, release, settings, staged
from tallywork.operators.joins import bounded_join, row_bound

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
# The classifier is fitted on at most this many labelled documents of each language: the keys are dealt into slices by a hash, and of
# each slice those of the lowest hash are taken, so that no task sees a language as a whole.
FIT_DOCUMENTS = 3000
SLICES = 60
DOCUMENTS_PER_TASK = 2000
# Languages whose matrix is in a task at a time (256 KB each); more are scored one block after the other.
LANGUAGES = 256
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIER = np.uint32(0x9E3779B1)
# Characters scored at a time, so that a very long text needs no more memory than this.
CHUNK = 1 << 18


@dataclass
class Model:
    """`log_likelihood`: buckets by languages; `log_prior`: by language."""

    languages: list[str]
    log_likelihood: np.ndarray
    log_prior: np.ndarray


def bucket_counts(text: str, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a text, all orders together. Reads the whole text, a chunk at a time."""
    total = np.zeros(buckets, np.int64)
    clean = f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "
    reach = max(orders) - 1
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, len(clean), CHUNK):
        # the n-grams that start in this chunk
        codes = np.frombuffer(clean[at : at + CHUNK + reach].encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = min(CHUNK, len(clean) - at)
        rolled = np.zeros(len(codes), np.uint32)
        for order in range(1, max(orders) + 1):
            # the hash of the n-gram that ends `order - 1` places further on
            rolled = rolled[: len(codes) - order + 1] * _MULTIPLIER + codes[order - 1 :]
            if order in orders:
                mixed = (rolled[:starts] + np.uint32(order)) * np.uint32(0x85EBCA6B)
                mixed ^= mixed >> np.uint32(15)
                total += np.bincount((mixed * _MULTIPLIER) >> shift, minlength=buckets)
    return total


def has_letter(text: str) -> bool:
    return bool(_NO_LETTERS.sub("", text))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = FIT_DOCUMENTS) -> Model:
    """The model of the labelled rows of `docs`; rows with a null label or text say nothing.

    At most `per_language` rows per language are read into the model, an equal number from each slice of keys; rows of equal key
    and text are taken or left together, beyond that number if need be. Their counts are summed per task first, so that one row per task,
    language and block of buckets is shuffled, and the driver gets one matrix, 256 KB a language.
    """
    settings(docs.sparkSession)
    slices = max(1, min(SLICES, per_language))
    sliced = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(slices)).cast("int")
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), sliced.alias("slice"), F.xxhash64(key, text, F.lit(17)).alias("hash"))
    # the last hash taken of each language and slice: the texts need no shuffle then
    lowest = Window.partitionBy("label", "slice").orderBy("hash")
    chosen = rows.select("label", "slice", "hash").withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= per_language // slices)
    last = staged(chosen.groupBy("label", "slice").agg(F.max("hash").alias("last"), F.count("*").alias("rows")), "language-sample")
    sizes = last.agg(F.sum("rows")).first()[0]
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    sample = bounded_join(rows, last.drop("rows"), ["label", "slice"], "inner", row_bound(last)).filter("hash <= last")
    # few tasks, as each gives a whole column of the matrix per language
    counts = _summed(sample.select("label", "text").repartition(1 + sizes // DOCUMENTS_PER_TASK)).collect()
    counts = sorted(counts, key=lambda row: row["label"])
    matrix = np.array([row["counts"] for row in counts], float).T + SMOOTHING
    priors = np.array([row["rows"] for row in counts], float)
    return Model([row["label"] for row in counts], np.log(matrix / matrix.sum(axis=0)), np.log(priors / priors.sum()))


def _summed(rows: DataFrame) -> DataFrame:
    """`label`, `rows` and bucket `counts`, summed over all rows."""
    out = pa.schema([("label", pa.string()), ("rows", pa.int64()), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, list] = {}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held = sums.setdefault(label, [0, np.zeros(BUCKETS, np.int64)])
                held[0] += 1
                held[1] += bucket_counts(text)
        yield from in_pieces(((k, n, c.tolist()) for k, (n, c) in sums.items()), out, lambda row: BUCKETS * 8)

    parts = rows.mapInArrow(run, "label STRING, rows BIGINT, counts ARRAY<BIGINT>")
    # one row per task and language, summed bucket by bucket
    entries = parts.select("label", "rows", F.posexplode("counts").alias("bucket", "n"))
    buckets = entries.groupBy("label", "bucket").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    return buckets.groupBy("label").agg(F.first("rows").alias("rows"), F.transform(ordered, lambda e: e["n"]).alias("counts"))


def predict(docs: DataFrame, model: Model, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carried` columns, `lang_pred` and `score`, the posterior probability of the prediction.

    Only the text is looked at. `und` with score 0 if the text is null or has no letter, or if the model knows no language. Of
    equal scores the language first in code point order wins. Rows are scored one by one.
    """
    rows = _scored(docs, model, text, carried)
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(carried)], "lang_pred", "score")


def known_only(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs`, whatever their columns, whose language is one the model knows, with at least the given score."""
    rows = _scored(docs, model, text, tuple(docs.columns)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def _scored(docs: DataFrame, model: Model, text: str, carried: tuple[str, ...]) -> DataFrame:
    settings(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carried))]
    at = f"c{carried.index(text)}" if text in carried else "t"
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(carried, names, strict=True)], *([docs[text].alias("t")] if at == "t" else []))
    # the best language so far, its log probability, and the sum of all probabilities in units of its own
    rows = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "best": F.lit(float("-inf")), "total": F.lit(0.0)})
    for start in range(0, max(1, len(model.languages)), LANGUAGES):
        block = slice(start, start + LANGUAGES)
        part = Model(model.languages[block], np.ascontiguousarray(model.log_likelihood[:, block]), model.log_prior[block])
        rows = _block_scored(staged(rows, "languages") if start else rows, part, at)
    score = F.when(F.col("lang_pred") == UNKNOWN, F.lit(0.0)).otherwise(1 / F.col("total"))
    return rows.select(*names, "lang_pred", score.alias("score"))


def _block_scored(rows: DataFrame, model: Model, at: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.languages, model.log_likelihood, model.log_prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = Model(*shared.value)
        for batch in batches:
            before = zip(*(batch.column(c).to_pylist() for c in (at, "lang_pred", "best", "total")), strict=True)
            found = [_better(known, *row) for row in before]
            kept = [batch.column(c) for c in batch.schema.names[:-3]]
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(kept + columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _better(model: Model, text: str | None, language: str, best: float, total: float) -> tuple[str, float, float]:
    """The language so far or a better one of the model; of equal ones the first."""
    if not text or not model.languages or not has_letter(text):
        return language, best, total
    counts = bucket_counts(text)
    seen = np.flatnonzero(counts)
    scores = counts[seen] @ model.log_likelihood[seen] + model.log_prior
    top = int(scores.argmax())
    own = float(np.exp(scores - scores[top]).sum())
    if scores[top] > best:
        return model.languages[top], float(scores[top]), own + total * math.exp(best - scores[top])
    return language, best, total + own * math.exp(scores[top] - best)


def held_out(key: Column) -> Column:
    """A third of the keys, kept from the fit: CRC-32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
