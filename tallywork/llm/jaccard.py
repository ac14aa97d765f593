"""Similarity join on word n-grams by chosen paths.

A text is the set of its word 5-grams as 48-bit hashes; texts of equal content are one set with a weight. A run gives every set
a few paths: a set extends a path by the n-grams whose hash with the path is small against the size of the set, so that two
similar sets choose some n-gram in common. Sets on one path are a bucket. A bucket of at most `SMALL` sets is compared by brute
force, all pairs exactly; a larger one is split by extending its path, as long as that lowers the number of comparisons. What
does not get smaller holds sets that are alike, and is compared in blocks. Runs are repeated until a pair at the threshold is
met with the target probability.

Links are never written out: a bucket's task counts, for each of its sets, the partners it meets there first, and names for
each set the lowest set it hangs together with. A group of n near copies so gives n rows per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import BATCH_BYTES, forget, release, settings, staged

WORDS = 5
THRESHOLD = Fraction(4, 5)
TARGET = 0.9999
# N-grams a set chooses per run and step, on average.
BRANCHING = 3.0
# Largest bucket compared as a whole, and the blocks that larger ones are cut into.
SMALL = 4096
BLOCK = 2048
MAX_DEPTH = 24
# Bytes of an n-gram's hash; two n-grams of a pair of texts with a thousand each fall together once in 10^8 pairs.
TOKEN_BYTES = 6
# Bytes of a text hashed at a time.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def runs_for(target: float, threshold: Fraction, branching: float) -> int:
    """Runs after which a pair at the threshold has met with the target probability, at whatever depth.

    Of the n-grams chosen by the larger set at least `threshold` are shared in the worst case; a pair survives a step if it
    shares a choice that survives the steps below, hence the fixed point.
    """
    meets = 1.0
    for _ in range(200):
        meets = 1 - math.exp(-branching * float(threshold) * meets)
    return math.ceil(math.log(1 - target) / math.log(1 - meets))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word between ASCII white space: a polynomial in its bytes."""
    data, found, at = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _WHITE[data[end]]:
            # a word is never cut, however long
            rest = np.flatnonzero(_WHITE[data[end : end + CHUNK]])
            end = end + int(rest[0]) if len(rest) else min(len(data), end + CHUNK)
        part = data[at:end]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[part], [True]])))
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[part] * up[: len(part)], dtype=np.uint64)])
        found.append(_mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of the text's word n-grams; a shorter text with words is one n-gram."""
    hashes = word_hashes(text)
    if len(hashes) == 0:
        return hashes
    count = max(1, len(hashes) - words + 1)
    rolled = np.full(count, np.uint64(len(hashes) if len(hashes) < words else words), np.uint64)
    for k in range(min(words, len(hashes))):
        rolled = _mixed(rolled + hashes[k : k + count])
    return np.unique(rolled >> np.uint64(64 - 8 * TOKEN_BYTES))


def pack(tokens: np.ndarray) -> bytes:
    """A set in as few bytes as its hashes need."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.view("<u8").ravel()


def chosen(tokens: np.ndarray, path: int, branching: float = BRANCHING) -> np.ndarray:
    """The paths by which a set extends `path`, as signed 64-bit numbers."""
    salt = _mixed(np.array([path & (1 << 64) - 1], np.uint64))
    hashes = _mixed(tokens ^ salt)
    share = branching / max(1, len(tokens))
    picked = hashes if share >= 1 else hashes[hashes < np.uint64(int(share * 2.0**64))]
    return _mixed(picked + salt + np.uint64(1)).view(np.int64)


def content_key(text: Column) -> Column:
    """What tells texts of different content apart; null for texts without a word."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


def content_id(doc_id: Column, key: Column) -> Column:
    """Bytes in order of (doc_id, key), as two contents may have the same doc_id; without a doc_id behind all others."""
    number = F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.unhex(F.concat(F.coalesce(F.concat(F.lit("00"), number), F.lit("01" + 16 * "0")), F.hex(key)))


def lowest_doc_id(content: Column) -> Column:
    """The doc_id in a content's id, null if it has none."""
    number = F.conv(F.hex(F.substring(content, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.substring(content, 1, 1) == F.unhex(F.lit("00")), number)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Tuples of equally long arrays, put together to batches."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(getattr(x, "nbytes", 8 * len(x)) for x in row)
        if size >= most:
            yield _joined(held, schema)
            held, size = [], 0
    if held:
        yield _joined(held, schema)


def _joined(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for parts, field in zip(zip(*rows, strict=True), schema, strict=True):
        flat = np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [x for part in parts for x in part]
        columns.append(pa.array(flat, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _first_paths(docs: DataFrame, runs: int) -> DataFrame:
    """`path` and `key` of the first step of every run. Copies inside one task are looked at once."""
    out = pa.schema([("path", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def each() -> Iterator[tuple]:
            seen: set[bytes] = set()
            for batch in batches:
                if len(seen) > 1_000_000:
                    seen.clear()
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    tokens = shingles(text)
                    paths = np.concatenate([chosen(tokens, r) for r in range(runs)])
                    yield paths, [key] * len(paths)

        return _batches(each(), out)

    return docs.mapInArrow(run, "path BIGINT, key BINARY")


def _sets(docs: DataFrame) -> DataFrame:
    """`key` and `tokens`, the packed set."""
    out = pa.schema([("key", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            tokens = [pack(shingles(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.binary()), pa.array(tokens, pa.binary())], schema=out)

    return docs.mapInArrow(run, "key BINARY, tokens BINARY")


def _extended(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """`parent`, `path`, `key`: the children of the given (path, key) rows."""
    held = rows.groupBy("key").agg(F.collect_list("path").alias("paths")).join(sets, "key")
    out = pa.schema([("parent", pa.int64()), ("path", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def each() -> Iterator[tuple]:
            for batch in batches:
                for key, paths, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "paths", "tokens")), strict=True):
                    tokens = unpack(packed)
                    for parent in paths:
                        children = chosen(tokens, parent)
                        yield np.full(len(children), parent, np.int64), children, [key] * len(children)

        return _batches(each(), out)

    return held.mapInArrow(run, "parent BIGINT, path BIGINT, key BINARY")


def _buckets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """`path`, `key`, `size`: buckets to compare, after large ones have been split as long as it pays."""

    def sized(table: DataFrame, by: list[str]) -> DataFrame:
        counts = table.groupBy(*by).agg(F.count("*").alias("size"))
        return table.join(counts, by)

    level = staged(sized(rows, ["path"]), "paths-sized")
    done = [level.filter(F.col("size") <= SMALL)]
    large = level.filter(F.col("size") > SMALL)
    for _ in range(MAX_DEPTH):
        if not large.limit(1).count():
            return _union(done)
        children = staged(_extended(large.select("path", "key"), sets), "paths")
        counts = children.groupBy("parent", "path").agg(F.count("*").alias("size")).filter("size > 1")
        # comparisons below each parent against its own
        below = counts.groupBy("parent").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("below"))
        parents = large.select(F.col("path").alias("parent"), "size").distinct().join(below, "parent", "left")
        pays = F.coalesce(F.col("below"), F.lit(0.0)) < F.col("size").cast("double") * F.col("size")
        parents = staged(parents.select("parent", pays.alias("pays")), "parents")
        alike = parents.filter(~F.col("pays")).select(F.col("parent").alias("path"))
        done.append(large.join(alike, "path", "left_semi"))
        split = children.join(parents.filter("pays"), "parent", "left_semi").join(counts, ["parent", "path"])
        level = staged(split.select("path", "key", "size"), "paths-sized")
        done.append(level.filter(F.col("size") <= SMALL))
        large = level.filter(F.col("size") > SMALL)
    return _union([*done, large])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*whole.columns))
    return whole


def _compared(rows: DataFrame) -> DataFrame:
    """`id`, `links`, `root` of the sets of each bucket that have a partner in it, from (path, i, j, block, id, weight, earlier,
    tokens) in which a bucket's rows follow each other."""
    out = pa.schema([("id", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def buckets() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and held[0][:3] != row[:3]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        def each() -> Iterator[tuple]:
            for bucket in buckets():
                if len(bucket) > 1:
                    yield compare_bucket(bucket)

        return _batches(each(), out)

    return rows.mapInArrow(run, "id BINARY, links BIGINT, root BINARY")


def compare_bucket(rows: list[tuple]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """Brute force over one bucket or one pair of its blocks: ids with a partner, the weight of the partners met here first, and
    the lowest id of what hangs together."""
    path, i, j = rows[0][:3]
    blocks, weights = (np.array([row[at] for row in rows], np.int64) for at in (3, 5))
    names = sorted(row[4] for row in rows)
    places = {name: at for at, name in enumerate(names)}
    ids = np.array([places[row[4]] for row in rows], np.int64)
    sets = [unpack(row[7]) for row in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(rows)
    common = _intersections(sets)
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    linked = q * common >= p * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= blocks[:, None] != blocks[None, :]
    # a pair that shares a bucket of lower number was counted there
    met: dict[int, int] = {}
    spots = [(at, met.setdefault(other, len(met))) for at, row in enumerate(rows) for other in row[6] if other < path]
    first = linked
    if spots:
        shared = np.zeros((n, len(met)), np.float32)
        at, other = np.array(spots).T
        shared[at, other] = 1
        first = linked & (shared @ shared.T == 0)
    links = first @ weights
    roots = _roots(linked, ids)
    has = linked.any(axis=1)
    return [names[at] for at in ids[has]], links[has], [names[at] for at in roots[has]]


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    if n == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]], np.int64)
    owners = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    owners, starts = owners[order], np.concatenate([[0], np.cumsum(counts)])
    common = np.zeros((n, n), np.float32)
    # n-grams of many sets as a product of matrices, those of few sets pair by pair
    many = counts > max(8, n // 16)
    held = np.flatnonzero(many)
    for at in range(0, len(held), 1024):
        part = held[at : at + 1024]
        matrix = np.zeros((n, len(part)), np.float32)
        for column, t in enumerate(part):
            matrix[owners[starts[t] : starts[t + 1]], column] = 1
        common += matrix @ matrix.T
    for size in np.unique(counts[(counts > 1) & ~many]):
        tokens = np.flatnonzero((counts == size) & ~many)
        for at in range(0, len(tokens), max(1, 1_000_000 // int(size) ** 2)):
            part = tokens[at : at + max(1, 1_000_000 // int(size) ** 2)]
            sharing = owners[starts[part][:, None] + np.arange(size)]
            pairs = (sharing[:, :, None] * n + sharing[:, None, :]).ravel()
            spots, times = np.unique(pairs, return_counts=True)
            common.ravel()[spots] += times
    common = common.astype(np.int64)
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the lowest id it is connected with."""
    roots = ids.copy()
    high = np.iinfo(np.int64).max
    while True:
        lower = np.minimum(roots, np.where(linked, roots[None, :], high).min(axis=1))
        if (lower == roots).all():
            return roots
        roots = lower


def components(edges: DataFrame) -> DataFrame:
    """`id` and `root`, the lowest id of its component, for every id in edges (`id`, `root`).

    Each round hands the lowest root to all neighbours and then follows it one step, so that chains shorten by half; the rounds
    end when nothing changes. Labels and edges stay tables throughout.
    """
    edges = edges.filter("id <> root").distinct()
    both = staged(edges.select("id", F.col("root").alias("other")).unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("other"))), "edges")
    labels = staged(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("root")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("other"), F.col("root").alias("heard")), "other").groupBy("id").agg(F.min("heard").alias("heard"))
        lower = labels.join(heard, "id").select("id", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("jump"))
        lower = lower.join(jump, "root", "left").select("id", "before", F.least(F.col("root"), F.coalesce("jump", "root")).alias("root"))
        lower = staged(lower, "labels")
        changed = lower.filter("root <> before").limit(1).count()
        labels = lower.select("id", "root")
        if not changed:
            return labels


def join(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """`doc_id`, `class_id` and `n_links` of every row of `docs` (doc_id, text).

    `n_links` counts the other rows whose text has a Jaccard similarity of at least 0.8 by sets of word 5-grams; rows of equal
    text are linked. `class_id` is the lowest doc_id among all that hang together by links, the own doc_id if there is no link. A
    text without a word (null, empty, white space) has no n-gram and is linked with nothing; a text of fewer than five words is
    one n-gram. Rows without a doc_id are partners like all others; their class is null if none of it has a doc_id. Other columns
    are not read. Rows of one doc_id and different texts are different contents.
    """
    return _classes(docs, target).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, target: float) -> DataFrame:
    """The rows of `join` with `row_key`, which tells texts apart, and `first`: whether the text is the first of its class and the
    row has its lowest doc_id (none, if nothing in the class has one), or the text has no word."""
    settings(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", content_key(F.col("text")).alias("key"), "text").filter("key IS NOT NULL")
    texts = keyed.select("key", "text")
    runs = runs_for(target, THRESHOLD, BRANCHING)

    first = staged(_first_paths(texts, runs), "first-paths")
    # paths of more than one content; lowest and highest key tell without a list
    met = first.groupBy("path").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("path")
    # joins of what grows with the corpus are never broadcasts, however few the rows: the plan is the same at every size
    paths = staged(first.join(met.hint("merge"), "path", "left_semi").distinct(), "met-paths")
    forget(first)
    wanted = staged(paths.select("key").distinct(), "met-keys")
    # one text of each content that meets another
    kept = texts.join(wanted.hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = staged(_sets(kept), "sets")

    buckets = staged(_buckets(paths, sets), "buckets")
    # buckets of the same sets are compared once
    same = buckets.groupBy("path").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b")
    )
    once = same.groupBy("n", "a", "b").agg(F.min("path").alias("path")).select("path")
    contents = staged(keyed.groupBy("key").agg(content_id(F.min("doc_id"), F.col("key")).alias("id"), F.count("*").alias("weight")), "contents")
    buckets = staged(buckets.join(once.hint("merge"), "path", "left_semi").join(contents.hint("merge"), "key").select("path", "key", "size", "id", "weight"), "buckets-once")

    earlier = buckets.groupBy("key").agg(F.collect_list("path").alias("earlier")).join(sets.hint("merge"), "key")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = buckets.join(earlier.hint("merge"), "key").withColumn("_parts", F.when(F.col("size") > SMALL, parts).otherwise(F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.select(
        "path", F.least("block", "_with").alias("i"), F.greatest("block", "_with").alias("j"), "block", "id", "weight", "earlier", "tokens"
    )
    rows = rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "id")
    found = staged(_compared(rows), "links")
    forget(paths, wanted, sets, buckets)

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select("id", "root"))
    classes = contents.join(links, "id", "left").join(roots, "id", "left")
    root = F.coalesce("root", "id")
    n_links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    classes = classes.select("key", lowest_doc_id(root).alias("class_id"), (root == F.col("id")).alias("_first"), n_links.alias("n_links"))
    rows = docs.select("doc_id", content_key(F.col("text")).alias("key"), row_key(F.col("text")).alias("row_key"))
    first = F.coalesce(F.col("_first") & F.col("class_id").eqNullSafe(F.col("doc_id")), F.lit(False))
    return rows.join(classes, "key", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "row_key",
        (F.col("key").isNull() | first).alias("first"),
    )


def row_key(text: Column) -> Column:
    """What tells all texts apart, those without a word too."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def deduplicated(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """The rows of `docs` of the lowest (doc_id, text by its hash) of their class, one of each; their columns are unchanged.

    A class without any doc_id keeps one row too. Rows with neither doc_id nor word are in no class and stay.
    """
    firsts = _classes(docs, target).filter("first").select(F.col("doc_id").alias("_id"), "row_key").distinct()
    whole = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
    rows = docs.select("doc_id", row_key(docs["text"]).alias("row_key"), content_key(docs["text"]).isNull().alias("wordless"), whole)
    loose = F.col("wordless") & F.col("doc_id").isNull()
    kept = rows.filter(~loose).join(firsts, (rows["row_key"] == firsts["row_key"]) & rows["doc_id"].eqNullSafe(firsts["_id"]), "left_semi")
    kept = kept.dropDuplicates(["doc_id", "row_key"]).select("_row").unionByName(rows.filter(loose).select("_row"))
    return kept.select(*[F.col(f"_row.c{i}").alias(name) for i, name in enumerate(docs.columns)])
