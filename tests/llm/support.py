"""Small inputs with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import public_tokenizers

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCUMENT = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
# columns with names that the operators use inside
CLASHES = "key BIGINT, path STRING, size INT, _row STRING, c0 STRING, _hash INT, row_hash INT, lang_pred STRING, score STRING, stratum INT"


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    parts = ["the", "and", "of", "river", "house", "quickly", "nation", "table", "green", "was", "with", "stone", "letter", "cloud"]
    return " ".join(rnd.choice(parts) + rnd.choice(["", "", "s", "ing", ".", ","]) + str(rnd.randrange(40)) for _ in range(words))


LONG = prose(5, 60_000)
COPY = prose(6, 200)
NEAR = COPY.replace(COPY.split()[100], "changed", 1)
EDGE = [
    (None, "a row without an id " * 5, "en", "a", 1),
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \n\t \x0b ", "de", "b", 5),
    (4, "word", "en", "b", 4),
    (5, LONG, "en", "c", len(LONG)),
    (6, COPY, "en", "a", 1),
    (6, COPY, "en", "a", 1),
    (7, COPY, "fr", None, 1),
    (8, NEAR, "en", "b", 1),
    (9, "é漢字🙂 \x00 <|endoftext|> don't  stop!\n\n12345 ‍", "xx", "d", 9),
    (10, prose(7, 80), "en", "d", 1),
    (11, "two words", "en", "d", 1),
    (12, "two words", "en", "d", 1),
    (13, "12 34 --- 56", "en", "e", 1),
]


def documents(spark, rows=EDGE, clashes: bool = True):
    """`rows` as documents, with columns of clashing names."""
    df = spark.createDataFrame(rows, DOCUMENT)
    if clashes:
        for column in CLASHES.split(", "):
            name, kind = column.split()
            df = df.selectExpr("*", f"CAST(7 AS {kind}) AS `{name}`")
    return df


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall(text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard_links(rows: list[tuple[int, str | None]]) -> tuple[list[int], list[int]]:
    """Links and class of every row, by all pairs that share a word 5-gram."""
    sets = [shingle_set(text) for _, text in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for shingle in s for j in holders[shingle])
        for j, n in common.items():
            if i != j and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    lowest: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        lowest[top(i)] = min(doc_id, lowest.get(top(i), doc_id))
    return links, [lowest[top(i)] for i in range(len(rows))]
