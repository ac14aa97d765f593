"""Token counts of sections: whole documents are encoded once and their tokens allotted to sections by character spans.

Encoding sections one by one would count other tokens than the document has. Here the document's tokens keep their spans, token
spans are joined to section spans by searching the sorted boundaries, and a token that crosses a boundary goes by a rule:

* `most`: to the section with most of its characters, the earlier of equals;
* `first`, `last`: to the first or last section it touches;
* `split`: to all sections it touches, in proportion to the characters.

A token that touches no section, in a gap between two, goes to the section before it (the first, if there is none), so that the
counts of a document always add up to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import in_pieces, per_process, read_vocabulary, settings
from tallywork.llm.segments import IDS, LibrarySegments, TextEncoder

RULES = ("most", "first", "last", "split")
_SENTENCE_END = re.compile(r"[.!?]+\s+")
Spans = Callable[[str], list[tuple[int, int]]]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences in code points. A sentence ends behind the white space that follows a full stop."""
    cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def token_spans(ids: np.ndarray, widths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last code point of every token. Tokens that share a character both cover it."""
    ends = np.cumsum(widths[ids])
    starts = ends - widths[ids]
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode(), np.uint8)
    heads = np.cumsum((data & 0xC0) != 0x80)
    return heads[starts] - 1, heads[ends - 1]


def allot(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]], rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens cross a boundary.

    Sections stand in order of their start; one that reaches into the next ends where that begins.
    """
    first_char = np.array([a for a, _ in spans], np.int64)
    past = np.array([b for _, b in spans], np.int64)
    past[:-1] = np.minimum(past[:-1], first_char[1:])
    low = np.searchsorted(past, starts, "right")
    high = np.searchsorted(first_char, ends, "left") - 1
    counts = np.zeros(len(spans))
    plain = low >= high
    # in a gap `high` is the section before, else `low` and `high` are the same
    np.add.at(counts, np.clip(high[plain], 0, None), 1)
    crossing = np.flatnonzero(~plain)
    two = crossing[high[crossing] - low[crossing] == 1]
    left, right = low[two], high[two]
    before = np.minimum(past[left], ends[two]) - np.maximum(first_char[left], starts[two])
    behind = np.minimum(past[right], ends[two]) - np.maximum(first_char[right], starts[two])
    if rule == "split":
        np.add.at(counts, left, before / (before + behind))
        np.add.at(counts, right, behind / (before + behind))
    else:
        goes_left = {"first": before == before, "last": before != before}.get(rule, before >= behind)
        np.add.at(counts, np.where(goes_left, left, right), 1)
    for at in crossing[high[crossing] - low[crossing] > 1]:
        touched = np.arange(low[at], high[at] + 1)
        overlap = np.minimum(past[touched], ends[at]) - np.maximum(first_char[touched], starts[at])
        if rule == "split":
            counts[touched] += overlap / overlap.sum()
        else:
            counts[touched[{"first": 0, "last": -1}.get(rule, int(overlap.argmax()))]] += 1
    return counts, len(crossing)


def count_tokens(docs: DataFrame, path: str, sections: Spans | str = sentences, rule: str = "most") -> DataFrame:
    """`doc_id`, `n_tokens`, `n_sections`, `n_crossing` and `section_tokens` (doubles, in section order) of every row of `docs`.

    `sections` is a function from a text to its spans, run in the tasks, or the name of a column of `docs` with them, an array of
    (start, end) in code points. A null or empty text has no token and no section. A text without sections (a null or empty
    array) has its tokens in `n_tokens` alone. Empty sections have no tokens unless they are the first before a gap. Rows are
    worked on one by one; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    spark = settings(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    given = isinstance(sections, str)
    spans_column = [docs[sections].alias("spans")] if given else []
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), *spans_column)
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int32()), ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.float64()))]
    )

    def make() -> tuple[TextEncoder, np.ndarray]:
        segments = LibrarySegments(vocabulary.value)
        return TextEncoder(segments.match, segments.encode, segments.word), np.array([len(t) for t in segments.token_bytes()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, widths = per_process(("attribution", path, len(vocabulary.value)), make)

        def each() -> Iterator[tuple]:
            for batch in batches:
                columns = batch.to_pydict()
                for at, text in enumerate(columns["text"]):
                    text = text or ""
                    ids = np.frombuffer(encoder.encode(text), IDS)
                    if given:
                        spans = sorted(tuple(s.values()) for s in columns["spans"][at] or [])
                    else:
                        spans = sections(text)
                    counts, crossing = np.zeros(0), 0
                    if spans and len(ids):
                        counts, crossing = allot(*token_spans(ids, widths, text), spans, rule)
                    elif spans:
                        counts = np.zeros(len(spans))
                    yield columns["doc_id"][at], len(ids), len(spans), crossing, counts.tolist()

        return in_pieces(each(), out, lambda row: 8 * len(row[4]))

    return rows.mapInArrow(run, "doc_id BIGINT, n_tokens BIGINT, n_sections INT, n_crossing BIGINT, section_tokens ARRAY<DOUBLE>")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with a column `spans` from a table (`doc_id`, `start`, `end`); documents without spans have null."""
    grouped = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return docs.join(grouped, "doc_id", "left")
