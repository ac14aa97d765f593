"""Skewed joins, vector search and tables against brute force; shapes of plans."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import views
from tallywork.operators import joins, ranking
from tallywork.operators import vector as V
from tallywork.plans import retrieval as R
from tallywork.plans.analytics import run_template
from tallywork.session import shared_folder
from tallywork.sinks.versioned import VersionedTable

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def rows(df):
    return sorted(map(str, df.collect()))


# ---- skewed joins --------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_join_is_a_plain_join(spark, how):
    """A third of the rows has one key, some have none; the lookup repeats keys."""
    many = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 200 END AS k", "CAST(id % 4 AS STRING) AS k2"
    )
    lookup = spark.range(150).selectExpr("id AS k", "id * 2 AS v").unionByName(
        spark.createDataFrame([(7, -1), (7, -2), (None, -3)], "k BIGINT, v BIGINT")
    )
    expected = many.join(lookup, "k", how)
    found = joins.hot_key_join(many, lookup, "k", how, ["id"], hot_rows=100, salts=8)
    assert found.columns == expected.columns
    assert rows(found) == rows(expected)


def test_hot_key_join_on_two_keys(spark):
    many = spark.range(500).selectExpr("id", "IF(id % 2 = 0, 1, id % 20) AS a", "id % 2 AS b")
    lookup = many.select("a", "b").distinct().withColumn("v", F.col("a") * 10 + F.col("b"))
    found = joins.hot_key_join(many, lookup, ["a", "b"], "inner", ["id"], hot_rows=50, salts=4)
    assert rows(found) == rows(many.join(lookup, ["a", "b"]))


def test_hot_rows_are_spread(spark):
    many = spark.range(8000).selectExpr("id", "IF(id % 3 = 0, 1, id) AS k")
    lookup = spark.range(8000).selectExpr("id AS k")
    salted = joins.hot_key_join(many, lookup, "k", "inner", ["id"], hot_rows=1000, salts=16)
    assert salted.count() == many.join(lookup, "k").count()
    assert "pmod(xxhash64" in plan(salted)


def test_full_join_is_refused(spark):
    with pytest.raises(ValueError):
        joins.hot_key_join(spark.range(1), spark.range(1), "id", "full", ["id"])


# ---- vector search -------------------------------------------------------------------------------


def vectors(spark, n, dim, seed, name, vector, prefix=""):
    matrix = np.random.default_rng(seed).normal(size=(n, dim)).round(1).astype(np.float32).astype(np.float64)
    data = [(f"{prefix}{i:04d}", [float(x) for x in row]) for i, row in enumerate(matrix)]
    return matrix, spark.createDataFrame(data, f"{name} STRING, {vector} ARRAY<FLOAT>")


def brute_force(chunks, queries, k, threshold):
    scores = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (chunks / np.linalg.norm(chunks, axis=1, keepdims=True)).T
    found = {}
    for q, row in enumerate(np.round(scores, V.SIMILARITY_DIGITS)):
        order = sorted((i for i in range(len(row)) if row[i] >= threshold), key=lambda i: (-row[i], i))[:k]
        found[f"q{q:04d}"] = [(f"c{i:04d}", row[i]) for i in order]
    return found


@pytest.mark.parametrize("block", [1024, 5], ids=["sent to tasks", "in cells"])
def test_top_k_like_brute_force(spark, block):
    """Coarse vectors of two dimensions give many ties, which go to the lower id."""
    chunk_matrix, chunks = vectors(spark, 700, 2, 1, "chunk_id", "embedding", "c")
    query_matrix, queries = vectors(spark, 23, 2, 2, "query_id", "vector", "q")
    chunks = chunks.unionByName(spark.createDataFrame([("none", None)], chunks.schema)).repartition(6)
    found = V.vector_top_k(chunks, queries, 7, 0.5, max_block_queries=block, cell_rows=100)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.similarity))
    expected = {q: hits for q, hits in brute_force(chunk_matrix, query_matrix, 7, 0.5).items() if hits}
    assert {q: [c for c, _ in h] for q, h in got.items()} == {q: [c for c, _ in h] for q, h in expected.items()}
    assert all(abs(a - b) < 1e-8 for q in got for (_, a), (_, b) in zip(got[q], expected[q]))


def test_no_questions_and_zero_vectors(spark):
    _, chunks = vectors(spark, 5, 3, 1, "chunk_id", "embedding", "c")
    none = spark.createDataFrame([], "query_id STRING, vector ARRAY<FLOAT>")
    assert V.vector_top_k(chunks, none, 3, 0.0).count() == 0
    zero = spark.createDataFrame([("q", [0.0, 0.0, 0.0])], "query_id STRING, vector ARRAY<FLOAT>")
    assert V.vector_top_k(chunks, zero, 3, 0.1).count() == 0
    mixed = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [1.0])], "chunk_id STRING, embedding ARRAY<FLOAT>").coalesce(1)
    with pytest.raises(Exception, match="different width"):
        V.vector_top_k(mixed, zero, 3, 0.1).count()


def test_rank_within_without_bounds(spark, monkeypatch):
    """The shuffled way of the restricted search gives what the broadcast way gives."""
    chunks, asked = views.chunks(spark, SF), views.questions(spark, SF)
    pairs = chunks.selectExpr("concat('q', CAST(job_id % 10 + 1 AS STRING)) AS query_id", "job_id").distinct()
    few = rows(V.vector_rank_within(chunks, asked, pairs, 10))
    monkeypatch.setattr(V, "row_bound", lambda df: None)
    assert rows(V.vector_rank_within(chunks, asked, pairs)) == few


# ---- plans ---------------------------------------------------------------------------------------


def test_top_lists_do_not_sort_everything(spark):
    jobs = views.jobs(spark, SF)
    for name, params in [("skills_demand", ()), ("recent_jobs", ()), ("list_jobs_by_title", ("%a%",)), ("count_by_location", ())]:
        assert "TakeOrderedAndProject" in plan(run_template(jobs, name, params)), name
    assert "TakeOrderedAndProject" in plan(ranking.page(jobs, 3, 10))


def test_per_key_picks_are_limited_before_the_shuffle(spark):
    events = views.table(spark, SF, "events")
    for df in (ranking.latest_wins(events, ["user_id"], ["ts"]), ranking.first_seen(events, ["user_id"], ["ts"])):
        text = plan(df)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_counts_are_combined_before_the_shuffle(spark):
    assert "partial_count" in plan(run_template(views.jobs(spark, SF), "count_by_company"))


def test_scans_read_only_what_is_needed(spark):
    orders = spark.read.schema(views.SCHEMAS["orders"]).parquet(f"{SF}/orders.parquet")
    text = plan(joins.point_lookup(orders, 77, "o_orderkey").select("o_orderstatus"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text and "EqualTo(o_orderkey,77)" in text
    above = orders.withColumnRenamed("o_totalprice", "min_salary").filter("min_salary >= 100000").select("min_salary")
    assert "GreaterThanOrEqual(o_totalprice" in plan(above)


def test_search_reads_no_text(spark):
    chunks = views.chunks(spark, SF)
    scan = [line for line in plan(V.vector_top_k(chunks, views.questions(spark, SF), 5, 0.2)).splitlines() if "ReadSchema" in line]
    assert scan and all("label" not in line for line in scan)


def test_few_hits_are_broadcast_to_the_postings(spark):
    blocks = R.retrieval_blocks(views.chunks(spark, SF), _details(spark), views.questions(spark, SF), threshold=0.2)
    assert "BroadcastHashJoin" in plan(blocks) and "CartesianProduct" not in plan(blocks)


def _details(spark):
    from checks.search import job_details

    return job_details(spark, SF)


def test_no_cross_joins_and_no_python_in_field_functions(spark):
    for name, query in entry.queries().items():
        if name[0] in "FTAPW":
            text = plan(query(spark, SF))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
            if name[0] in "FT":
                assert "PythonUDF" not in text and "MapInPandas" not in text and "MapInArrow" not in text, name


# ---- pages -----------------------------------------------------------------------------------------


def test_pages_however_deep(spark):
    """All pages of rows with equal times, crowded days and rows without a time, against one sorted list."""
    df = spark.range(900).selectExpr(
        "id", "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 3 = 0 THEN TIMESTAMP_NTZ'2024-05-01 10:00:00' + make_dt_interval(0, 0, 0, id % 4) "
        "ELSE TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 40 AS INT), 0, 0, (id % 7) / 2) END AS created_at",
    )
    listed = [r.id for r in df.orderBy(F.desc_nulls_last("created_at"), "id").collect()]
    for number, limit in [(1, 20), (2, 20), (4, 100), (9, 100), (10, 100), (45, 20), (46, 20), (13, 7), (100_000, 50)]:
        assert [r.id for r in ranking.page(df, number, limit).collect()] == listed[(number - 1) * limit : number * limit], (number, limit)


def test_deep_page_sorts_few_rows(spark):
    df = spark.range(50_000).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS created_at")
    found, skipped = ranking._touched(df, F.date_trunc("second", "created_at"), "created_at", "second", 40_000, 20)
    assert found.count() == 20 and skipped == 0


# ---- versioned tables ----------------------------------------------------------------------------


def table(spark):
    return VersionedTable(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", "k INT, v STRING", ("k",))


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k INT, v STRING")


def test_versions(spark):
    t = table(spark)
    assert t.read().count() == 0 and t.last_version() == -1
    assert t.commit(kv(spark, (1, "a"), (2, "b")), "w#0") == 0
    assert t.commit(kv(spark, (2, "B"), (3, "c")), "w#1", spark.createDataFrame([(1,)], "k INT")) == 1
    assert rows(t.read()) == rows(kv(spark, (2, "B"), (3, "c")))
    assert rows(t.read(before=1)) == rows(kv(spark, (1, "a"), (2, "b")))
    before = rows(t.read())
    assert t.fold() and not t.fold()
    assert t.commits()[-1].kind == "whole" and rows(t.read()) == before and t.read().columns == ["k", "v"]
    assert t.commit(kv(spark, (1, "again"))) == 2
    assert {r.k for r in t.read().collect()} == {1, 2, 3}
    assert t.replace_all(t.read().limit(0)) == 3
    assert t.read().count() == 0
    assert t.commit(kv(spark, (9, "after a reset")), "w#2") == 4 and t.read().count() == 1


def test_no_writer_overwrites_another(spark):
    t = table(spark)
    t.commit(kv(spark, (1, "stream")), "s#0")
    t.commit(kv(spark, (2, "edit")), "edit")
    t.commit(kv(spark, (3, "stream")), "s#1")
    assert t.commit(kv(spark, (1, "stream again")), "s#0") == 0
    assert rows(t.read()) == rows(kv(spark, (1, "stream again"), (2, "edit"), (3, "stream")))
    assert t.version_of("s#1") == 2 and t.version_of("new") == 3


def test_repeated_and_unfinished_commits(spark):
    t = table(spark)
    for _ in range(2):
        t.commit(kv(spark, (1, "a")), "w#0")
    assert t.read().count() == 1
    # what a writer that was lost leaves behind
    unfinished = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.root}/changes/.spark-staging-1/_version=1/_kind=change/_mark=00ff/part-0.parquet")
    unfinished.getFileSystem(spark._jsc.hadoopConfiguration()).create(unfinished).close()
    assert t.last_version() == 0 and t.read().count() == 1
    assert t.version_of("other") == 1 and not t.fold()


def test_empty_commits_count(spark):
    t = table(spark)
    assert t.commit(kv(spark), "w#0") == 0 and t.commit(kv(spark, (1, "a")), "w#1") == 1
    assert t.commit(kv(spark), "w#0") == 0 and t.read_commit("w#0").count() == 0 and t.read_commit("w#1").count() == 1
    assert rows(t.read()) == rows(kv(spark, (1, "a"))) and t.read_commit("never").count() == 0


def test_column_order_stays(spark):
    """Two text columns, the key not first: nothing is swapped once changes stand behind a whole state."""
    t = VersionedTable(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", "v STRING, k STRING, x INT", ("k",))
    make = lambda *r: spark.createDataFrame(list(r), "v STRING, k STRING, x INT")
    t.replace_all(make(("a", "1", 1), ("b", "2", 2)))
    t.commit(make(("c", "2", 3)))
    t.commit(make(("d", "3", 4)), deleted=spark.createDataFrame([("1",)], "k STRING"))
    assert t.read().columns == ["v", "k", "x"] and sorted(map(tuple, t.read().collect())) == [("c", "2", 3), ("d", "3", 4)]


def test_small_commits_are_folded_by_their_share(spark):
    t = table(spark)
    t.replace_all(spark.range(20_000).selectExpr("CAST(id AS INT) AS k", "uuid() AS v"))
    t.commit(kv(spark, (1, "x")))
    assert not t.fold() and t.fold(share=0.0) and t.read().count() == 20_000


def test_embedder_is_asked_call_by_call():
    """Texts of a large batch become Python objects for one call at a time, and its vectors leave before the next call."""
    import pyarrow as pa

    from tallywork.operators.embedding import _embed_batches

    calls = []
    rows = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(200)]), pa.array([f"t{i}" for i in range(200)])], names=["text_hash", "text"])
    out = _embed_batches(lambda texts: calls.append(len(texts)) or [[float(t[1:])] for t in texts], 1, 64)(iter([rows]))
    first = next(out)
    assert calls == [64] and first.num_rows == 64
    rest = pa.Table.from_batches([first, *out])
    assert calls == [64, 64, 64, 8]
    assert rest.to_pylist() == [{"text_hash": f"k{i}", "embedding": [float(i)]} for i in range(200)]
