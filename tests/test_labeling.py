"""Phrase matching on tokens against the pattern of each keyword, and label runs of any number of questions."""

import random
import re

from pyspark.sql import functions as F

from tallywork.functions.text import keyword_regex
from tallywork.plans import labeling as L

KEYWORDS = [
    "c#", "c++", "++", ".net", "asp.net", "node.js", "spring boot", "back-end", "a", "a_b", "_", "é", "café", "naïve b", "c#/.net", "#", "a  b", "x.", "-a-", "...", "1.5",
    "a\nb", "c", "net", "ab c", "a.b.c", "🙂", "a🙂", "(a)", "a)", "$", "[a]", "\\a",
]
PARTS = ["a", "b", "c", "ab", "net", "asp", "node", "js", "spring", "boot", "_", "a_b", "é", "café", "naïve", " ", "  ", ".", "#", "++", "-", "/", "\n", "1", "5", "🙂", "(", ")", "x", "...", "$", "[", "]", "\\", "K"]


def test_hits_equal_patterns(spark):
    rnd = random.Random(11)
    texts = ["", " ", "c#", "use C# now".lower(), "asp.net", ".net", "c++", "++", "a c++_x", "c#9", "c#_"] + ["".join(rnd.choices(PARTS, k=rnd.randint(1, 12))).lower() for _ in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id INT, text STRING").withColumn("note", F.lit("kept"))
    found = {(r.id, r.keyword) for r in L.keyword_hits(df, spark.createDataFrame([(k,) for k in KEYWORDS * 2], "keyword STRING")).collect()}
    patterns = {k: re.compile(keyword_regex(k)) for k in KEYWORDS}
    assert found == {(i, k) for i, t in enumerate(texts) for k, p in patterns.items() if p.search(t)}


def test_few_and_many_questions_by_one_plan(spark):
    """The same plan and the same answers for one question among two or among five thousand; no text is shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "lang AS title", "text AS description")
    words = [r.w for r in docs.selectExpr("explode(split(lower(description), '[^a-z]+')) AS w").filter("length(w) > 3").groupBy("w").count().orderBy(F.desc("count"), "w").limit(300).collect()]
    schema = "id STRING, expected_keywords ARRAY<STRING>, keyword_groups ARRAY<ARRAY<STRING>>, min_relevant INT, max_relevant INT"
    rows = [(f"q{i}", [words[i % 300], words[(7 * i + 1) % 300]], [[words[i % 300]], [words[(i * 3 + i // 300) % 300], "no such"]] if i % 2 else None, 1, 5 + i % 9) for i in range(5000)]
    many = L.label_candidates(docs, spark.createDataFrame(rows, schema))
    few = L.label_candidates(docs, spark.createDataFrame(rows[:2], schema))
    shape = lambda df: re.sub(r"[#\d]+", "", df._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0])
    assert len(shape(few).splitlines()) == len(shape(many).splitlines())
    assert sorted(map(tuple, many.filter("query_id IN ('q0', 'q1')").collect())) == sorted(map(tuple, few.collect()))
    assert many.select("query_id").distinct().count() > 2000
    exchanges = [line for line in many._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not any("description" in line or "text" in line for line in exchanges)


def test_only_places_of_wanted_keys_become_rows(spark, monkeypatch):
    """Long texts give rows for keywords' first tokens alone, and the hits are those of the way for many keywords."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join([*words, "c++ for node.js", *words])), (2, "c++x (c++) .net node.js"), (3, "nothing"), (4, None), (5, ".net, big data; big  data")]
    texts = spark.createDataFrame(rows, "id INT, text STRING")
    keywords = spark.createDataFrame([(k,) for k in ("c++", "node.js", "big data", "++", ".net", "absent")], "keyword STRING")
    places, seen = L._places, []
    monkeypatch.setattr(L, "_places", lambda *given: seen.append(places(*given)) or seen[-1])

    def hits():
        return sorted(tuple(r) for r in L.keyword_hits(texts, keywords).distinct().collect())

    few = hits()
    assert seen[0].count() < 40
    monkeypatch.setattr(L, "MOST_KEYS", 0)
    assert hits() == few and {(1, "c++"), (1, "node.js"), (5, "big data")} <= set(few)
    assert seen[1].count() > 800
