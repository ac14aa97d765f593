"""Importance resampling, collocations and url filters against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import pyarrow.parquet as pq
from support import DOCUMENT, EDGE, SF, documents, prose
from tallywork.llm import collocations, importance, queries, urls
from tallywork.llm.common import ranked

# ---- importance resampling -------------------------------------------------------------------------

IMPORTANT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text):
    words = IMPORTANT.findall(ascii_lower(text))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent=5, min_words=20, seed=42, buckets=10_000):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    rows = [(doc_id, *plain_features(text)) for doc_id, text in docs]
    s = Counter(bucket(f) for _, _, found in rows for f in found)
    t = Counter(bucket(f) for text in target for f in plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, n_words, found in rows:
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found)
        )
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    taking = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0], r[3], r[2]))
    drawn = Counter()
    for place, row in enumerate(taking[: len(taking) * percent // 100], 1):
        drawn[row, place] += 1
    ranks = {}
    for (row, place), _ in drawn.items():
        ranks.setdefault(row, []).append(place)
    found = []
    for row in out:
        found.append((*row, ranks[row].pop(0) if ranks.get(row) else None))
    return Counter(found)


def test_op11_query_like_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    target = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()
    wanted = plain_resample(docs, target)
    rows = queries.op11_importance_resampling(spark, SF).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows) == Counter(
        {(d, f, w, s, k): n for (d, _, f, w, s, k), n in wanted.items()}
    )
    assert sum(r["rank"] is not None for r in rows) == sum(IMPORTANT.findall(ascii_lower(t)).__len__() >= 20 for _, t in docs) * 5 // 100


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_op11_awkward_rows(spark, percent):
    """Nulls, empty and long texts, repeated rows, a null id, columns of clashing names."""
    target = spark.createDataFrame([(1, "River house and STONE"), (2, None), (3, "")], "item_id BIGINT, text STRING")
    sampling = importance.Sampling(percent=percent)
    rows = importance.resample(documents(spark), target, sampling).collect()
    wanted = plain_resample([(r[0], r[1]) for r in EDGE], ["River house and STONE", None, ""], percent)
    assert Counter(tuple(r) for r in rows) == wanted


def test_op11_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCUMENT), documents(spark)
    assert importance.resample(none, some).count() == 0
    weights = {r.doc_id: r.weight for r in importance.resample(some, none.select("text")).collect()}
    assert weights[1] == weights[2] == 0 and len(weights) == len({r[0] for r in EDGE})


def test_op11_pieces_do_not_change_features(monkeypatch):
    """Texts cut in pieces give the features of the whole, wherever the cuts fall."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aB9é🙂 .\n\x00~{") for _ in range(n)) for n in (0, 1, 5, 40, 300)] + ["x" * 100, "é" * 50 + " y"]
    split = importance._splitter()
    for piece in (1, 2, 7, 4096):
        monkeypatch.setattr(importance, "PIECE", piece)
        for text in texts:
            words, found = plain_features(text)
            parts = list(importance.features(split, text, 3))
            assert sum(n for n, _ in parts) == words
            assert Counter(c for _, crcs in parts for c in crcs) == Counter(zlib.crc32(f.encode()) for f in found)


def test_ranked_spreads_one_group(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 5000).alias("v")).unionByName(spark.createDataFrame([("b", 3), ("b", 1)], "g STRING, v BIGINT"))
    rows = ranked(df, ["g"], [F.desc("v")], "place").collect()
    assert sorted((r.v, r.place) for r in rows if r.g == "a") == [(4999 - i, i + 1) for i in range(4999, -1, -1)]
    assert sorted((r.v, r.place) for r in rows if r.g == "b") == [(1, 2), (3, 1)]


# ---- collocations ----------------------------------------------------------------------------------


def plain_phrases(rows, mining):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, mining.longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= mining.least}
    for (lang, words), a in candidates.items():
        explained = any(
            other == lang and len(longer) > len(words) and 100 * b >= mining.drop_percent * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), b in candidates.items()
        )
        if explained:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, phrases in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[: mining.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


TALK = [
    ("en", "New York is New York. New York City, new york city\tNEW YORK city!"),
    ("en", "a a a a a a a a; a a a"),
    (None, "É é É é\x0bnew york ; new  york"),
    ("und", "new york new york"),
    ("en", None),
    ("en", ""),
    ("de", " . ,,, \n"),
    ("de", "x"),
    ("en", "the cat sat on the mat, the cat sat on the mat, the cat sat on a mat"),
    ("en", "the cat sat on the mat, the cat sat on the mat, the cat sat on a mat"),
]


def talks(spark, rows):
    df = spark.createDataFrame([(i, t, lang, None, 1) for i, (lang, t) in enumerate(rows)], DOCUMENT)
    return df.withColumns({"w1": F.lit("x"), "n": F.lit(1), "phrase": F.lit("y"), "size": F.lit(2)})


@pytest.mark.parametrize("mining", [collocations.Mining(2), collocations.Mining(1, 4, 50), collocations.Mining(3, 3, 100, 4), collocations.Mining(2, 2)])
def test_op12_like_brute_force(spark, mining):
    rows = collocations.mine(talks(spark, TALK), mining).collect()
    assert sorted(map(tuple, rows)) == plain_phrases(TALK, mining)


@pytest.mark.parametrize("chunk", [16, 100, 4 << 20])
def test_op12_chunks_and_forgotten_words(chunk):
    """Windows are those of whole texts wherever texts are cut and words forgotten; padding starts at pairs that are not frequent."""
    import pyarrow as pa

    rnd = random.Random(9)
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choice(["aa", "b", "c.", "dd,", "e\n", "ff"]) for _ in range(rnd.choice([0, 3, 400])))) for _ in range(30)]
    rows += [("en", "z" * 300 + " b aa " * 9)]
    wanted = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = piece.split()
            wanted.update((lang, *words[i : i + 3], *[None] * (3 - len(words[i : i + 3]))) for i in range(len(words)))
    batches = [pa.RecordBatch.from_pydict({"lang": [a for a, _ in rows], "text": [b for _, b in rows]})]
    found = Counter()
    collocations.CHUNK, collocations.VOCABULARY, before = chunk, 8, (collocations.CHUNK, collocations.VOCABULARY)
    try:
        for stretch in collocations._stretches(iter(batches), 3):
            for at in range(stretch.starts):
                if stretch.numbers[at] > collocations.END:
                    words = []
                    for n in stretch.numbers[at : at + 3]:
                        if n <= collocations.END:
                            break
                        words.append(stretch.words[n].decode())
                    found[(stretch.langs[stretch.lang[at]], *words, *[None] * (3 - len(words)))] += 1
    finally:
        collocations.CHUNK, collocations.VOCABULARY = before
    assert found == wanted


def test_op12_larger_corpus(spark):
    """Frequent words in random order: many pairs are below the least count, so windows are cut short."""
    rows = [(["en", "de", None][i % 3], prose(i, 400)) for i in range(30)]
    mining = collocations.Mining(12, 5, 100, 50)
    assert sorted(map(tuple, collocations.mine(talks(spark, rows), mining).collect())) == plain_phrases(rows, mining)


def test_op12_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_op12_products_beyond_64_bits(spark):
    known = spark.createDataFrame(
        [("en", 0, "", [], 9 * 10**14), ("en", 1, "a", ["a"], 3 * 10**13), ("en", 1, "b", ["b"], 2 * 10**13)],
        "lang STRING, size INT, phrase STRING, words ARRAY<STRING>, n BIGINT",
    )
    candidate = spark.createDataFrame([("en", 2, "a b", ["a", "b"], 10**13 + 7)], "lang STRING, size INT, phrase STRING, words ARRAY<STRING>, a BIGINT")
    (row,) = collocations._scored(candidate, known).collect()
    assert row.score == 1000 * (10**13 + 7) * 9 * 10**14 // (6 * 10**26)


# ---- url filters -----------------------------------------------------------------------------------


def plain_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host, path = ascii_lower(host), slash + tail
    fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r.host.split(".")) if r.host else 0, len(r.path), r.verdict == "block"))
    return host, path, best.host + best.path, best.verdict


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://Www.Example.COM/en/x?y#z", "http://example.com/en",
    "http://example.com/en/", "http://example.com/EN/", "http://notexample.com/en/", "http://a.b.example.com/en/a//b", "ftp://x.net/es/1",
    "http://net/fr/", "http://x.net/de/", "a://b://c.com/d", "http://x.com?q=/en/", "http://x.com#/en/", "http://x.com:80/", "http://u@x.com/",
    "http://x.com./", "http://.com/", "http://..com/", "http://é.com/é/", "http://x.net/fr", "x" * 50_000 + "://y.net/es/" + "z" * 50_000,
    "http://" + "a." * 3000 + "example.com/en/" + "s/" * 3000, "http://x.com/a\nb", "http://İ.com/",
]


def pages(spark, found):
    df = spark.createDataFrame(list(enumerate(found)), "page_id BIGINT, url STRING")
    return df.withColumns({"key": F.lit(1), "host": F.lit("h"), "path": F.lit("p"), "rule": F.lit("r"), "verdict": F.lit("v")})


RULE_SETS = {
    "of the query": queries.URL_RULES,
    "parts of segments": [urls.Rule("block", "com", "/e"), urls.Rule("allow", "com", "/en/"), urls.Rule("block", "COM", "/en/x"), urls.Rule("allow", "example.com")],
    "every host": [urls.Rule("block", "", "/"), urls.Rule("allow", "net", "/"), urls.Rule("block", "x.net", "/fr")],
    "two verdicts": [urls.Rule("allow", "net", "/es/"), urls.Rule("block", "net", "/es/"), urls.Rule("allow", "net", "/es/")],
    "none": [],
}


@pytest.mark.parametrize("name", RULE_SETS)
@pytest.mark.parametrize("trie_bytes", [1, 1 << 20])
def test_op13_like_all_rules(spark, name, trie_bytes):
    """One trie or many, awkward urls, repeated and null keys."""
    rules = RULE_SETS[name]
    df = pages(spark, URLS + URLS[:8]).withColumn("page_id", F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 31))
    rows = urls.judge(df, rules, default="block", trie_bytes=trie_bytes).collect()
    plain = [urls.Rule(r.verdict, r.host.lower(), r.path) for r in rules]
    wanted = [(None if i % 5 == 0 else i % 31, *plain_judge(url, plain, "block")) for i, url in enumerate(URLS + URLS[:8])]
    assert Counter(map(tuple, rows)) == Counter(wanted)


def test_op13_random_rules():
    rnd = random.Random(1)
    for _ in range(300):
        def host():
            return ".".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 4)))

        def path():
            return "".join(rnd.choice(["/", "a", "ab", "/b"]) for _ in range(rnd.randrange(0, 4)))

        rules = [urls.Rule(rnd.choice(["allow", "block"]), host(), path()) for _ in range(rnd.randrange(1, 12))]
        trie = urls.Trie(rules)
        for _ in range(20):
            at, below = host(), "/" + path()
            _, _, rule, verdict = plain_judge(f"x://{at}{below}", rules)
            found = trie.find(at, below)
            assert (found and (str(found), found.verdict)) == (rule if rule is None else (rule, verdict)), (rules, at, below)


def test_op13_empty_table_and_wrong_verdict(spark):
    assert urls.judge(spark.createDataFrame([], "page_id BIGINT, url STRING"), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages(spark, URLS), [urls.Rule("maybe", "com")])
