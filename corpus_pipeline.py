"""A training corpus from raw documents: known languages, good quality, one document of each group of near copies, sources mixed to
their targets, token ids.

Each stage reads all that the stage before it kept and returns the columns of documents; the last returns token ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import bytebpe, jaccard, langid, mixing, quality
from tallywork.llm.queries import table
from tallywork.session import apply, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a posterior of at least a half, by a model of the labelled rows of `docs`.

    Null texts and texts without a letter go, all rows if none is labelled. Null labels, repeated rows, null ids and an empty table
    are no matter.
    """
    return langid.known_only(docs, langid.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the certified rules keep, by the labels of the documents that are in `docs`.

    Null, empty and short texts go. Repeated rows are judged alike and count as one trial; rows without an id are judged without being
    trials; a null language is a stratum of its own. Without labels only the base decides, an empty table stays empty.
    """
    return quality.kept_only(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that hang together by links, the one of the lowest doc_id, then of the lowest hash of the text.

    Repeated rows go but for one, rows without an id go for their copies with one. Texts without a word are linked with nothing:
    those with an id stay once, those without all stay.
    """
    return jaccard.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice.

    Texts without words have size 0, their source may take them; a source without words takes nothing. Null sources are one source.
    Repeated rows are sampled one by one, ties stand by hash, and a rerun takes the same rows.
    """
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `n_tokens`, packed 32-bit `ids` and the SHA-256 of what they decode to, one row per row taken.

    A null or empty text has no ids; null ids of documents and repeated rows stay as they are.
    """
    rows = bytebpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("quality_rules", good_quality),
    ("near_duplicates", one_of_each_group),
    ("source_mix", mixed_sources),
    ("byte_bpe", token_ids),
]
# Language scores, similarity joins and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read back."""
    apply(spark)
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
