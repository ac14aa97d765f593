"""Byte-level encoding of whole texts by memoised segments.

The pattern of the byte-level vocabularies starts a new match at every blank that a non-blank follows. A text is therefore
cut there, and the encoding of a segment, which never depends on its neighbours, is kept in a cache of bounded size. The
ids of a text are the joined bytes of its segments' ids. `BatchEncoder` does this for many texts at once in Arrow and numpy.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# How the byte-level vocabularies cut text before merging; the fixed value of the public tokenizer files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = regex.compile(PATTERN)
# White space other than the blank.
_OTHER_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_ASCII_WHITE = [c for c in _OTHER_WHITE if c.isascii()]
# Below this code point the classes of letters, digits and blanks are the same in every Unicode version in use.
_UNSTABLE = re.compile("[\u0530-\U0010ffff]")


def is_unstable(text: str) -> bool:
    return not text.isascii() and _UNSTABLE.search(text) is not None


IDS = np.dtype("<u4")
# Segments per generation of a cache, and the longest segment kept. With its ids an entry takes some 200 bytes, 1,000 at most.
CACHE_ROOM = 250_000
CACHE_LENGTH = 48
# Matches whose ids a batch encoder keeps, some 50 bytes each, and the room of its cache for what is encoded one by one.
KNOWN_ROOM = 400_000
BEHIND_ROOM = 10_000
# Segments whose ids are put together at a time.
JOINED_SEGMENTS = 1 << 16
# Different segments that are cut into matches at a time.
CUT_SEGMENTS = 1 << 17


def byte_letters() -> dict[int, str]:
    """Byte to the visible letter that stands for it in byte-level vocabularies: printable Latin-1 stays, the rest follows 255."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pieces(text: str) -> list[str]:
    """The matches of the pattern, in order."""
    return [text] if text[1:].isalpha() and text[0] == " " else _PIECES.findall(text)


def cut(text: str) -> list[str]:
    """Segments of a text. All but the first have lost the blank that starts them."""
    parts = text.split(" ")
    # a part that is empty or starts with white space belongs to the part before it; a single character is found fast
    white = _ASCII_WHITE if text.isascii() else _OTHER_WHITE
    if "  " not in text and text[0] != " " != text[-1] and not any(" " + c in text for c in white if c in text):
        return parts
    glued = parts[:1]
    for part in parts[1:]:
        if not part or part[0].isspace():
            glued[-1] += " " + part
        else:
            glued.append(part)
    return glued


class SegmentCache(dict):
    """Packed ids of segments, in two generations of bounded size: when the newer is full, the older is forgotten."""

    def __init__(self, encode: Callable[[str], bytes], room: int = CACHE_ROOM):
        super().__init__()
        self._encode, self._room, self._older = encode, room, {}

    def __missing__(self, segment: str) -> bytes:
        packed = self._older.get(segment)
        if packed is None:
            packed = self._encode(segment)
            if len(segment) > CACHE_LENGTH:
                return packed
        if len(self) >= self._room:
            self._older = dict(self)
            self.clear()
        self[segment] = packed
        return packed


class TextEncoder:
    """Whole texts to packed little-endian 32-bit ids, by a cut of segments into matches and the encoding of one match.

    `word` encodes a blank with letters behind it, given the letters. Segments that follow a blank and those that start a line are
    cached apart.
    """

    def __init__(
        self, match: Callable[[str], list[str]], encode: Callable[[str], bytes], word: Callable[[str], bytes], room: int = CACHE_ROOM
    ):
        self._match, self._encode, self._word = match, encode, word
        self._cache = SegmentCache(self._spaced, room)
        self._starts = SegmentCache(self._start, room // 3 + 1)
        self._bare: dict[str, bytes] = {}

    def _spaced(self, word: str) -> bytes:
        """A blank and what follows it. A word with its comma shares the entry of the bare word."""
        if word.isalpha():
            return self._word(word)
        return self._in_parts(word, self._cache) or self._segment(" " + word)

    def _start(self, word: str) -> bytes:
        """What starts a line."""
        if word.isalpha():
            return self._encode(word)
        return self._in_parts(word, self._starts) or self._segment(word)

    def _in_parts(self, word: str, cache: SegmentCache) -> bytes | None:
        """A word with one mark behind it by the entry of the word, and lines one by one: a line break between a letter or mark
        and a letter is a match of its own."""
        last = word[-1]
        if last in ".,;:!?" and word[:-1].isalpha():
            return None if is_unstable(word) else cache[word[:-1]] + self._unspaced(last)
        head, broken, tail = word.partition("\n")
        if broken and tail[:1].isalpha() and (head[-1:].isalpha() or head[-1:] in tuple(".,;:!?")) and not is_unstable(word):
            return cache[head] + self._unspaced("\n") + self._starts[tail]
        return None

    def _segment(self, segment: str) -> bytes:
        matches = self._match(segment)
        if len(matches) == 1:
            return self._encode(segment)
        return b"".join([self._cache[m[1:]] if m[0] == " " and len(m) > 1 else self._unspaced(m) for m in matches])

    def _unspaced(self, match: str) -> bytes:
        packed = self._bare.get(match)
        if packed is None:
            packed = self._encode(match)
            if len(match) <= 4:
                if len(self._bare) > 10_000:
                    self._bare.clear()
                self._bare[match] = packed
        return packed

    def encode_matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches end to end, and how many each has. The cache is not used."""
        word, encode = self._word, self._encode
        return _unpacked([word(m[1:]) if m[0] == " " and m[1:].isalpha() else encode(m) for m in matches])

    def after_blank(self, part: str) -> bytes:
        """What follows a blank, with the blank."""
        return self._cache[part]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = cut(text)
        followed = b"".join(map(self._cache.__getitem__, parts[1:]))
        return self._segment(parts[0]) + followed if parts[0] else followed


# Texts that a cut at every blank does not cut into segments: a blank at an end or before white space.
_GLUED = "^ | $| [ " + "".join(f"\\x{{{ord(c):x}}}" for c in _OTHER_WHITE) + "]"


def _stable_pattern() -> re.Pattern:
    """The pattern with its classes written out, for texts in which these are the same in every Unicode version."""
    stable = "".join(map(chr, range(0x530)))
    letter, digit, white = ("".join(f"\\u{ord(c):04x}" for c in regex.findall(kind, stable)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{digit}]+| ?[^{white}{letter}{digit}]+|[{white}]+(?![^{white}])|[{white}]+"
    )


_STABLE_PIECES = _stable_pattern()


class Known:
    """Ids of the texts that came last, as many as there is room for, in arrays."""

    def __init__(self, room: int):
        self._room, self._texts = room, pa.array([], pa.string())
        self._ids, self._sizes = np.empty(0, IDS), np.empty(0, np.int32)

    def look_up(self, texts: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """Ids end to end, and for each of the different `texts` where they start and how many it has.

        `encode` gives the ids of those not known, end to end, and how many each has.
        """
        spots = pc.index_in(texts, value_set=self._texts).fill_null(-1).to_numpy()
        found, fresh = np.flatnonzero(spots >= 0), np.flatnonzero(spots < 0)
        known_starts = self._sizes.cumsum(dtype=np.int64) - self._sizes
        sizes, starts = np.empty(len(texts), np.int32), np.empty(len(texts), np.int64)
        sizes[found], starts[found] = self._sizes[spots[found]], known_starts[spots[found]]
        if not len(fresh):
            return self._ids, starts, sizes
        more, counts = encode(texts.take(pa.array(fresh)).to_pylist())
        sizes[fresh], starts[fresh] = counts, len(self._ids) + counts.cumsum(dtype=np.int64) - counts
        ids = np.concatenate([self._ids, more])
        short = pc.utf8_length(texts).to_numpy()[fresh] <= CACHE_LENGTH
        known = pa.concat_arrays([self._texts, texts.take(pa.array(fresh[short]))])
        kept = np.concatenate([self._sizes, counts[short]])
        # the first to come are the first to go
        gone = max(0, len(known) - self._room)
        self._texts, self._sizes = known.slice(gone), kept[gone:]
        short_ids = more if short.all() else more[np.repeat(short, counts)]
        self._ids = np.concatenate([self._ids, short_ids])[int(kept[:gone].sum()) :]
        return ids, starts, sizes


class BatchEncoder:
    """Many whole texts to packed ids: of a batch's different segments each different match is looked up once.

    What is no segment of stable alphabets behind a single blank is encoded one by one by `texts`.
    """

    def __init__(self, texts: TextEncoder, room: int = KNOWN_ROOM):
        self._texts, self._matches = texts, Known(room)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The packed ids of each text, in order; a null text is empty."""
        texts = texts.fill_null("")
        glued = pc.match_substring_regex(texts, _GLUED).to_numpy(zero_copy_only=False)
        if glued.any():
            lists = [cut(text) if odd else text.split(" ") for text, odd in zip(texts.to_pylist(), glued.tolist(), strict=True)]
            return self._encode(pa.array(lists, pa.list_(pa.string())))
        return self._encode(pc.split_pattern(texts, " "))

    def _encode(self, lists: pa.Array) -> Iterator[bytes]:
        stops = lists.value_lengths().to_numpy().cumsum(dtype=np.int64)
        if not len(stops):
            return
        parts, begins = lists.flatten(), np.concatenate([[0], stops[:-1]])
        firsts = parts.take(pa.array(begins)).to_pylist()
        behind = np.ones(len(parts), bool)
        behind[begins] = False
        places = parts.filter(pa.array(behind)).dictionary_encode()
        ids, sizes = self._after_blanks(places.dictionary)
        starts = sizes.cumsum(dtype=np.int64) - sizes
        at, stops = places.indices.to_numpy(), stops - np.arange(1, len(stops) + 1)
        del lists, parts, behind, places
        # the pool of Arrow else keeps a batch's arrays, several times its texts, beside the JVM's memory
        pa.default_memory_pool().release_unused()
        first = 0
        while first < len(stops):
            # whole texts, as many as hold some thousands of segments
            begin = stops[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(stops, begin + JOINED_SEGMENTS, "right")))
            picked = at[begin : stops[last - 1]]
            joined, ends = _gather(ids, starts[picked], sizes[picked])
            ends, done = np.concatenate([[0], ends])[stops[first:last] - begin], 0
            for text, end in zip(firsts[first:last], ends.tolist(), strict=True):
                yield self._texts.encode(text) + joined[done:end].tobytes()
                done = end
            first = last

    def _after_blanks(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments that have lost their blank, end to end, and how many each has."""
        ids, sizes = [np.empty(0, IDS)], [np.empty(0, np.int32)]
        for at in range(0, len(parts), CUT_SEGMENTS):
            some = parts.slice(at, CUT_SEGMENTS).to_pylist()
            joined = " " + " ".join(some)
            if not is_unstable(joined) and not _is_glued(joined):
                more, counts = self._joined(joined)
            else:
                odd = [is_unstable(part) or _is_glued(" " + part) for part in some]
                plain = [part for part, strange in zip(some, odd, strict=True) if not strange]
                others = _unpacked([self._texts.after_blank(part) for part, strange in zip(some, odd, strict=True) if strange])
                more, counts = _merged(odd, *self._joined(" " + " ".join(plain)), *others) if plain else others
            ids.append(more)
            sizes.append(counts)
        return np.concatenate(ids), np.concatenate(sizes)

    def _joined(self, segments: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of whole segments of stable alphabets, whose only blanks start them, so that matches with one do."""
        places = pa.array(_STABLE_PIECES.findall(segments), pa.string()).dictionary_encode()
        ids, starts, sizes = self._matches.look_up(places.dictionary, self._texts.encode_matches)
        at = places.indices.to_numpy()
        opening = np.flatnonzero(pc.starts_with(places.dictionary, " ").to_numpy(zero_copy_only=False)[at])
        joined, _ = _gather(ids, starts[at], sizes[at])
        return joined, np.add.reduceat(sizes[at], opening)


def _is_glued(text: str) -> bool:
    """Whether a blank ends the text or stands before white space."""
    return text[-1] == " " or "  " in text or any(" " + c in text for c in _OTHER_WHITE if c in text)


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(packed), IDS), np.fromiter(map(len, packed), np.int32, len(packed)) // 4


def _merged(
    second: list[bool], ids: np.ndarray, sizes: np.ndarray, other_ids: np.ndarray, other_sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of ids as one, in which those of the other stand where `second` is true."""
    order = np.argsort(np.argsort(second, kind="stable"), kind="stable")
    sizes = np.concatenate([sizes, other_sizes])
    starts = sizes.cumsum(dtype=np.int64) - sizes
    return _gather(np.concatenate([ids, other_ids]), starts[order], sizes[order])[0], sizes[order]


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `ids` end to end, and where each ends."""
    ends = sizes.cumsum(dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)], ends


class LibrarySegments:
    """Matches by the tokenizers library: its model on each match, or its whole encoder outside the stable alphabets."""

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(vocabulary.decode())
        # a special token's name inside a document is ordinary text
        self._tokenizer.encode_special_tokens = True
        self._tokenize = self._tokenizer.model.tokenize
        self._letters = byte_letters()
        pre = json.loads(vocabulary)["pre_tokenizer"]
        self._plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    def match(self, segment: str) -> list[str]:
        if not self._plain or is_unstable(segment):
            return [segment]
        return pieces(segment)

    def encode(self, match: str) -> bytes:
        if not self._plain or is_unstable(match):
            return array("I", self._tokenizer.encode(match, add_special_tokens=False).ids).tobytes()
        shown = match.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        if self._plain and word.isascii():
            return array("I", [t.id for t in self._tokenize("Ġ" + word)]).tobytes()
        return self.encode(" " + word)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        back = {letter: byte for byte, letter in self._letters.items()}
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self._tokenizer.id_to_token(i) or "" for i in range(size)]
        return [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]
