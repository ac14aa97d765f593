"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

A sequence of tokens is what the merges produce exactly if no merge crosses a boundary between two neighbours, and every
prefix of a text has one such sequence. The nondeterministic transducer reads bytes along the prefixes of the vocabulary
and may close a token wherever the closed token fits the one before it. Its determinisation keeps all open hypotheses in
one state, emits the tokens on which they agree, and holds back the rest: a token leaves after a bounded lookahead, at
most the longest token. Once few tokens can still close a hypothesis, the token before it is reduced to which of those it
forbids, so that states with different pasts meet. States are made when a text first reaches them and are forgotten
together when there are too many.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywork.llm.common import gathered, in_pieces, per_process, read_vocabulary
from tallywork.llm.segments import BEHIND_ROOM, IDS, BatchEncoder, TextEncoder, pieces

# A transducer with more states, or four times as many steps, starts anew; some 1,000 bytes each.
MAX_STATES = 80_000
# Sets of forbidden tokens outlast the states, as they take long to find; some 200 bytes each.
MAX_FORBIDDEN = 100_000
# Pairs of tokens, and ends of tokens, whose merges are remembered.
MAX_PAIRS = 50_000
MAX_EDGES = 20_000
# Bytes of text that are encoded or handed back at a time, and matches whose ids are kept, so that a worker stays small beside the JVM.
STEP_BYTES = 1 << 20
MATCHES_ROOM = 150_000
# With at most this many tokens to close it, a hypothesis keeps the forbidden ones in place of the token before it.
FEW = 96
_NEVER = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Merges:
    """The ranks compiled: how each token comes about, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 single bytes")
        self.ranks = ranks
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        # bytes that begin longer tokens, with those tokens if they are few
        self.starts: dict[bytes, list[bytes] | None] = {}
        for token in sorted(ranks, key=len):
            if len(token) == 1:
                self.halves[token] = None
                continue
            parts = self.merge(token, stop=2)
            if len(parts) == 2 and parts[0] in self.halves and parts[1] in self.halves:
                self.halves[token] = (parts[0], parts[1])
                for end in range(1, len(token)):
                    longer = self.starts.setdefault(token[:end], [])
                    if longer is not None:
                        longer.append(token)
                        if len(longer) > FEW:
                            self.starts[token[:end]] = None
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._left: dict[bytes, list] = {}
        self._right: dict[bytes, list] = {}

    def merge(self, text: bytes, stop: int = 1) -> list[bytes]:
        """The plain procedure: merge the leftmost pair of lowest rank until none is left or `stop` parts remain."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that stand at one end of a token while it is being merged: (part, when it comes, when it goes)."""
        edge, goes = [], _NEVER
        while True:
            halves = self.halves[token]
            comes = -1 if halves is None else self.ranks[token]
            edge.append((token, comes, goes))
            if halves is None:
                return edge
            token, goes = halves[side], comes

    def _edge_of(self, known: dict[bytes, list], token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        edge = known.get(token)
        if edge is None:
            if len(known) > MAX_EDGES:
                known.clear()
            edge = known[token] = self._edge(token, side)
        return edge

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the boundary: none is due while both of its parts stand there."""
        key = (left, right)
        known = self._fits.get(key)
        if known is not None:
            return known
        if len(self._fits) > MAX_PAIRS:
            self._fits.clear()
        free = self._fits[key] = self._is_free(left, right)
        return free

    def _is_free(self, left: bytes, right: bytes) -> bool:
        rank_of, right_edge = self.ranks.get, self._edge_of(self._right, right, 0)
        for a, a_comes, a_goes in self._edge_of(self._left, left, 1):
            for b, b_comes, b_goes in right_edge:
                rank = rank_of(a + b)
                # of equal ranks the leftmost pair goes first
                if rank is not None and (due := max(rank, a_comes, b_comes)) < a_goes and due <= b_goes:
                    return False
        return True


class Transducer:
    """Bytes to packed ids. A state is the set of (token before or what it forbids, bytes since, tokens held back)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self._forbidden: dict[tuple[bytes, bytes], frozenset[bytes]] = {}
        # the few different ones among the many sets of forbidden tokens
        self._sets: dict[frozenset[bytes], frozenset[bytes]] = {}
        self._reset()

    def _reset(self) -> None:
        self._numbers: dict[tuple, int] = {}
        self._states: list[tuple] = []
        # by 256 times the state plus the byte
        self._steps: dict[int, tuple[int, bytes]] = {}
        self._ends: list[bytes] = []
        self._number(((frozenset(), b"", ()),))

    def _number(self, state: tuple) -> int:
        number = self._numbers.get(state)
        if number is None:
            number = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._ends.append(next((self._pack(held) for _, since, held in state if not since), b""))
        return number

    def _pack(self, tokens: Iterable[bytes]) -> bytes:
        return b"".join(self.merges.ranks[t].to_bytes(4, "little") for t in tokens)

    def _guard(self, before: bytes | frozenset[bytes], since: bytes, longer: list[bytes] | None) -> bytes | frozenset[bytes]:
        """What `before` forbids of the tokens that can follow; `before` itself while these are many."""
        if longer is None:
            return before
        if isinstance(before, frozenset):
            return self._shared(before.intersection(longer)) if before else before
        key = (before, since)
        known = self._forbidden.get(key)
        if known is None:
            fits = self.merges.fits
            known = self._forbidden[key] = self._shared(frozenset(t for t in longer if not fits(before, t)))
        return known

    def _shared(self, tokens: frozenset[bytes]) -> frozenset[bytes]:
        return self._sets.setdefault(tokens, tokens)

    def _step(self, number: int, byte: int) -> tuple[int, bytes]:
        merges, after = self.merges, []
        for before, since, held in self._states[number]:
            read = since + bytes((byte,))
            if read in merges.halves and (
                read not in before if isinstance(before, frozenset) else merges.fits(before, read)
            ):
                after.append((read, b"", (*held, read)))
            if read in merges.starts:
                longer = merges.starts[read]
                guard = self._guard(before, read, longer)
                if longer is None or len(guard) < len(longer) or isinstance(guard, bytes):
                    after.append((guard, read, held))
        agreed = os.path.commonprefix([held for _, _, held in after]) if len(after) > 1 else after[0][2]
        cut = len(agreed)
        state = tuple(sorted(((b, s, held[cut:]) for b, s, held in after), key=lambda h: len(h[1])))
        step = (self._number(state) << 8, self._pack(agreed))
        self._steps[number << 8 | byte] = step
        return step

    def run(self, text: bytes) -> bytes:
        if len(self._states) > MAX_STATES or len(self._steps) > 4 * MAX_STATES:
            self._reset()
        if max(len(self._forbidden), len(self._sets)) > MAX_FORBIDDEN:
            self._forbidden.clear()
            self._sets.clear()
        known, at, out = self._steps.get, 0, []
        for byte in text:
            step = known(at | byte) or self._step(at >> 8, byte)
            at = step[0]
            if step[1]:
                out.append(step[1])
        out.append(self._ends[at >> 8])
        return b"".join(out)


class RankSegments:
    """Matches by the transducer; one that is itself a token is that token."""

    def __init__(self, vocabulary: bytes):
        self.ranks = read_ranks(vocabulary)
        self._transducer = Transducer(self.ranks)

    def encode(self, match: str) -> bytes:
        text = match.encode()
        rank = self.ranks.get(text)
        return self._transducer.run(text) if rank is None else rank.to_bytes(4, "little")

    def word(self, word: str) -> bytes:
        return self.encode(" " + word)


class Utf8Machine:
    """Incremental UTF-8: bytes in pieces of any length in, text out as soon as its code points are complete.

    The state is the bits read so far, the continuation bytes still due, and the lowest and highest byte that may come next. What is
    no UTF-8 becomes U+FFFD, one for the longest start of a code point that breaks off.
    """

    def __init__(self) -> None:
        self._code = self._due = 0
        self._low, self._high = 0x80, 0xBF

    @property
    def idle(self) -> bool:
        """Whether no code point is open."""
        return not self._due

    def feed(self, piece: bytes) -> str:
        out: list[str] = []
        for byte in piece:
            if self._due:
                if self._low <= byte <= self._high:
                    self._code, self._due = self._code << 6 | byte & 0x3F, self._due - 1
                    self._low, self._high = 0x80, 0xBF
                    if not self._due:
                        out.append(chr(self._code))
                    continue
                out.append("\ufffd")
                self._due, self._low, self._high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self._code, self._due = byte & 0x1F, 1
            elif 0xE0 <= byte <= 0xEF:
                self._code, self._due = byte & 0x0F, 2
                # neither longer forms of lower code points nor surrogates
                self._low, self._high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self._code, self._due = byte & 0x07, 3
                self._low, self._high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("\ufffd")
        return "".join(out)

    def end(self) -> str:
        open_, self._due = self._due, 0
        self._low, self._high = 0x80, 0xBF
        return "\ufffd" if open_ else ""


# Ids decoded at a time.
DECODE_IDS = 65_536


class TokenDecoder:
    """Ids to text through the UTF-8 machine, which is run over each token once.

    A token that takes the idle machine back to idle without a fault has a text of its own; a row of them is the row of their texts.
    The others, parts of code points, go through the machine byte by byte wherever they occur.
    """

    def __init__(self, tokens: list[bytes]):
        self._tokens, self._texts = tokens, [_whole_text(token) for token in tokens]
        self._open = np.array([text is None for text in self._texts])

    def decode(self, packed: bytes) -> str:
        ids, machine, out = np.frombuffer(packed, IDS), Utf8Machine(), []
        for start in range(0, len(ids), DECODE_IDS):
            self._run(ids[start : start + DECODE_IDS], machine, out)
        return "".join([*out, machine.end()])

    def _run(self, ids: np.ndarray, machine: Utf8Machine, out: list[str]) -> None:
        numbers, at = ids.tolist(), 0
        for stop in [*np.flatnonzero(self._open[ids]).tolist(), len(numbers)]:
            if at < stop and not machine.idle:
                out.append(machine.feed(self._tokens[numbers[at]]))
                at += 1
            if at < stop:
                out.extend(map(self._texts.__getitem__, numbers[at:stop]))
            if stop < len(numbers):
                out.append(machine.feed(self._tokens[numbers[stop]]))
            at = stop + 1


def _whole_text(token: bytes) -> str | None:
    machine = Utf8Machine()
    text = machine.feed(token)
    return text if machine.idle and text.encode() == token else None


def _token_list(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _segments(path: str, vocabulary: bytes) -> tuple[BatchEncoder, TokenDecoder]:
    def make() -> tuple[BatchEncoder, TokenDecoder]:
        segments = RankSegments(vocabulary)
        texts = TextEncoder(pieces, segments.encode, segments.word, BEHIND_ROOM)
        return BatchEncoder(texts, MATCHES_ROOM), TokenDecoder(_token_list(segments.ranks))

    return per_process(("byte bpe", path, len(vocabulary)), make)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of whole texts by the rank file at `path`: the id column, `n_tokens` (long), `ids` (binary, 32-bit little-endian).

    A null or empty text has no ids. Repeated rows, null ids and further columns are no matter: rows are encoded one by one,
    other columns are not read.
    """
    return _round_trip(docs, path, id_column, text_column, False)


def encode_and_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`encode` with a further column `decoded` (binary): the bytes of the text that the ids decode to, from the ids alone."""
    return _round_trip(docs, path, id_column, text_column, True)


def _round_trip(docs: DataFrame, path: str, id_column: str, text_column: str, back: bool) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    rows = docs.select(docs[id_column].alias("key"), docs[text_column].alias("text"))
    out = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.binary())] * back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _segments(path, vocabulary.value)

        def each() -> Iterator[tuple]:
            for batch in gathered(batches, STEP_BYTES):
                for key, ids in zip(batch.column("key").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                    yield (key, len(ids) // 4, ids) + ((decoder.decode(ids).encode(),) if back else ())

        return in_pieces(each(), out, lambda row: sum(len(x) for x in row[2:]), STEP_BYTES)

    kinds = f"key BIGINT, n_tokens BIGINT, ids BINARY{', decoded BINARY' * back}"
    return rows.mapInArrow(run, kinds).withColumnRenamed("key", id_column)


def decode(rows: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Text of packed ids by the rank file at `path`: the id column and `text`. Null ids give an empty text."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    out = pa.schema([("key", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _segments(path, vocabulary.value)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    yield key, decoder.decode(ids or b"")

        return in_pieces(each(), out, lambda row: len(row[1]))

    picked = rows.select(rows[id_column].alias("key"), rows[ids_column].alias("ids"))
    return picked.mapInArrow(run, "key BIGINT, text STRING").withColumnRenamed("key", id_column)
