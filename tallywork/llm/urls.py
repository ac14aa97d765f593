"""Allow and block lists of hosts and paths.

Rules are the entries of a trie over the labels of the host from the last to the first, and below a host over the segments of the path. A
url follows its host down the trie; each host it passes that has rules, its own or a parent's, follows the path. The deepest host wins,
below it the longest path. The trie is sent to the tasks, where every url takes one walk; lists beyond `TRIE_BYTES` are dealt into several
tries, which the urls pass one after the other with the best rule so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import release, settings, staged

# Bytes of hosts and paths in one trie; its nodes take some ten times as much in a worker.
TRIE_BYTES = 4 << 20
ALLOW, BLOCK = "allow", "block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = ""

    def __str__(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null and without `://`."""
    scheme = F.instr(url, "://")
    rest = F.when(scheme > 0, F.substring(url, scheme + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.split(rest, "[?#]", 2)[0]
    host = F.split(rest, "/", 2)[0]
    return F.translate(host, _UPPER, _UPPER.lower()), F.substring(rest, F.length(host) + 1, F.length(rest))


class _Node:
    """`below`: labels or whole segments. `paths`: the root of a host's paths. `ends`: rules by the start of a segment they end in."""

    __slots__ = ("below", "paths", "ends")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.ends: dict[str, Rule] | None = None

    def child(self, name: str) -> _Node:
        return self.below.setdefault(name, _Node())


class Trie:
    def __init__(self, rules: Sequence[Rule]):
        self._root = _Node()
        # of two verdicts for one host and path the block stays
        for rule in sorted(rules, key=lambda r: r.verdict != BLOCK):
            node = self._root
            for label in reversed(_labels(rule.host)):
                node = node.child(label)
            node.paths = node.paths or _Node()
            *whole, last = rule.path.split("/")
            node = node.paths
            for segment in whole:
                node = node.child(segment)
            node.ends = node.ends or {}
            node.ends.setdefault(last, rule)

    def find(self, host: str, path: str) -> Rule | None:
        """The rule of the deepest host on the way, below it the one of the longest path."""
        found, node = self._path(self._root, path), self._root
        for label in reversed(_labels(host)):
            node = node.below.get(label)
            if node is None:
                break
            found = self._path(node, path) or found
        return found

    @staticmethod
    def _path(host: _Node, path: str) -> Rule | None:
        found, node = None, host.paths
        start = 0
        while node is not None:
            end = path.find("/", start)
            segment = path[start:] if end < 0 else path[start:end]
            if node.ends:
                if len(node.ends) <= len(segment):
                    fits = [rest for rest in node.ends if segment.startswith(rest)]
                else:
                    fits = [segment[:n] for n in range(len(segment) + 1) if segment[:n] in node.ends]
                if fits:
                    found = node.ends[max(fits, key=len)]
            if end < 0:
                break
            node, start = node.below.get(segment), end + 1
        return found


def _labels(host: str) -> list[str]:
    return host.split(".") if host else []


def _rank(rule: Rule) -> tuple:
    return len(_labels(rule.host)), len(rule.path), rule.verdict == BLOCK


def _dealt(rules: Sequence[Rule], most: int) -> list[list[Rule]]:
    blocks, size = [[]], 0
    for rule in rules:
        length = len(rule.host.encode()) + len(rule.path.encode()) + 16
        if blocks[-1] and size + length > most:
            blocks.append([])
            size = 0
        blocks[-1].append(rule)
        size += length
    return blocks


def judge(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = ALLOW, trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """`key`, `host`, `path`, `rule` and `verdict` of every row of `pages`.

    The host stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lowered, ports and user names included; the
    path reaches from there to `?`, `#` or the end. Both are empty for a null url and one without `://`. A rule fits its host and
    all hosts below it (an empty host: every host) if the path starts with the rule's, letter by letter, so `com/` does not fit an
    empty path. Of the rules that fit, the one with most labels wins, then the one with the longest path, then a block. `rule` is
    host and path of it, null if none fits; `default` is the verdict then. Null keys and repeated rows stay; an empty table gives no
    rows, an empty list the default for all. Columns other than key and url play no part.
    """
    rules = [Rule(rule.verdict, rule.host.translate(_LOWER), rule.path) for rule in rules]
    if any(rule.verdict not in (ALLOW, BLOCK) for rule in rules):
        raise ValueError(f"a rule's verdict is {ALLOW} or {BLOCK}")
    settings(pages.sparkSession)
    host, path = parts(pages[url])
    none = [F.lit(None).cast("string").alias(name) for name in ("verdict", "rule_host", "rule_path")]
    rows = pages.select(pages[key].alias("key"), host.alias("host"), path.alias("path"), *none)
    blocks = _dealt(rules, trie_bytes)
    for number, block in enumerate(blocks):
        # one trie in a worker at a time
        rows = _walked(staged(rows, "judged-urls") if number else rows, block)
    rule, verdict = F.concat("rule_host", "rule_path"), F.coalesce("verdict", F.lit(default))
    return rows.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _walked(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The better of each row's rule and the one that the trie of `rules` finds."""
    shared = rows.sparkSession.sparkContext.broadcast([tuple(rule) for rule in rules])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        trie = Trie([Rule(*rule) for rule in shared.value])
        for batch in batches:
            found = []
            for host, path, *best in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                rule = trie.find(host, path)
                if rule and (best[0] is None or _rank(rule) > _rank(Rule(*best))):
                    best = rule
                found.append(best)
            columns = [pa.array([row[i] for row in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
