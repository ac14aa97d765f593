"""Sources from files, repeated runs and retried batches."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from checks.search import DIM, hex_embedder
from tallywork import schemas
from tallywork.operators import ranking as R
from tallywork.operators.embedding import embed_column
from tallywork.plans import evaluation as E
from tallywork.plans import ingest as I
from tallywork.sinks import tables as S
from tallywork.sources import landing as L
from tallywork.sources import tables as T
from tallywork.streaming.ingest import distinct_contents, distinct_within, start_ingestion

EMBEDDING = I.Embedding(hex_embedder, "hex", DIM, tasks=3)
NOW = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"


def land(folder, name, answer):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(answer if isinstance(answer, str) else json.dumps(answer, indent=1))


def remotive_job(n, **more):
    return {"id": n, "url": "u", "title": f"Job {n}", "company_name": "Co", "job_type": "remote", "salary": "$60k",
            "candidate_required_location": "USA", "description": f"<p>text {n}</p>", **more}


def jobicy_job(n, kind):
    return {"id": n, "url": "u", "jobTitle": "T", "companyName": "C", "jobType": kind, "jobGeo": "Remote EU",
            "jobDescription": "<b>d</b>", "salaryMin": 30, "salaryPeriod": "hourly"}


def findwork_job(n, **more):
    return {"id": f"f{n}", "role": f"Role {n}", "company_name": "C", "employment_type": "full time", "location": None,
            "remote": True, "logo": "", "url": "u", "text": "x &amp; y", "keywords": ["Go", "AI"], **more}


def sources(root):
    return {name: f"{root}/{name}" for name in L.SOURCES}


def test_page_files(spark):
    root = tempfile.mkdtemp()
    land(f"{root}/remotive", "page_2", {"jobs": [remotive_job(1, title="second sight"), remotive_job(2, salary="n/a")]})
    land(f"{root}/remotive", "page_1", {"jobs": [remotive_job(1)]})
    land(f"{root}/remotive", "page_3", "{ this is no JSON")
    land(f"{root}/jobicy", "page-1", {"jobs": [jobicy_job(1, "part-time"), jobicy_job(2, ["contract", "x"]), jobicy_job(3, [])]})
    land(f"{root}/findwork", "1", {"count": 3, "next": None, "results": [findwork_job(i) for i in range(3)] + [findwork_job(9, role="")]})
    raw, failed = L.read_landing(spark, sources(root), findwork_cap=2)
    found = {(r.source, r.source_id): r for r in raw.collect()}
    assert failed == []
    assert set(found) == {("remotive", "1"), ("jobicy", "1"), ("jobicy", "2"), ("jobicy", "3"), ("findwork", "f0"), ("findwork", "f1")}
    first = found["remotive", "1"]
    assert (first.title, first.description, first.is_remote, first.job_type, first.min_salary) == ("Job 1", "text 1", True, None, 60000)
    assert [found["jobicy", str(i)].job_type for i in (1, 2, 3)] == ["part_time", "contract", None]
    assert found["jobicy", "1"].max_salary == 62400
    work = found["findwork", "f0"]
    assert (work.description, work.logo, work.keywords, work.location) == ("x & y", None, ["Go", "AI"], None)


def test_streamed_runs_equal_one_batch(spark):
    root = tempfile.mkdtemp()
    folders = sources(f"{root}/landing")
    for i in range(4):
        land(folders["remotive"], f"page_{i}", {"jobs": [remotive_job(10 * i + j) for j in range(5)]})
        land(folders["findwork"], f"page_{i}", {"results": [findwork_job(10 * i + j) for j in range(5)]})
    land(folders["jobicy"], "page_1", {"jobs": [jobicy_job(1, "intern")]})
    streamed, batch = S.Store(spark, f"{root}/streamed"), S.Store(spark, f"{root}/batch")

    def run():
        query = start_ingestion(spark, folders, streamed, f"{root}/checkpoint", EMBEDDING, max_files=1, now=F.expr(NOW))
        query.awaitTermination()

    run()
    versions = streamed.jobs.last_version()
    assert versions >= 3  # one file per source and batch
    run()
    assert streamed.jobs.last_version() == versions  # a restart finds nothing new
    raw, _ = L.read_landing(spark, folders)
    counts = I.ingest_batch(batch, raw, 0, EMBEDDING, now=F.expr(NOW)).first()
    for table in ("jobs", "chunks"):
        one, other = (sorted(map(str, getattr(s, table).read().collect())) for s in (streamed, batch))
        assert one == other, table
    assert batch.jobs.read().count() == counts.stored == 41
    total = streamed.runs.read().agg(F.sum("fetched"), F.sum("stored")).first()
    assert tuple(total) == (counts.fetched, counts.stored)


def test_second_run_skips_and_retry_changes_nothing(spark):
    root = tempfile.mkdtemp()
    folders = sources(f"{root}/landing")
    land(folders["remotive"], "page_1", {"jobs": [remotive_job(i) for i in range(6)]})
    raw, failed = L.read_landing(spark, folders)
    assert failed == ["jobicy", "findwork"]
    store = S.Store(spark, f"{root}/store")
    state = lambda: (sorted(map(str, store.jobs.read().collect())), sorted(map(str, store.chunks.read().collect())))
    assert tuple(I.ingest_batch(store, raw, 0, EMBEDDING, now=F.expr(NOW)).first())[1:] == (6, 6, 0)
    once = state()
    I.ingest_batch(store, raw, 0, EMBEDDING, now=F.expr(NOW))  # delivered again
    assert state() == once
    assert tuple(I.ingest_batch(store, raw, 1, EMBEDDING, now=F.expr(NOW)).first())[1:] == (6, 0, 6)
    assert state() == once
    changed = raw.withColumn("description", F.concat("description", F.lit(" more")))
    later = F.expr("TIMESTAMP_NTZ'2024-03-01 00:00:00'")
    I.ingest_batch(store, changed, 2, EMBEDDING, now=later)
    jobs = store.jobs.read()
    assert jobs.count() == 6 and jobs.filter("fetched_at > created_at").count() == 6


def test_failing_or_wrong_embedder_stops_the_run(spark):
    docs = spark.createDataFrame([(1, "a")], "i INT, t STRING")
    embedded, _ = embed_column(docs, "t", lambda texts: [[1.0]] * len(texts), "m", ["i"], dim=2)
    try:
        embedded.count()
    except Exception as error:  # noqa: BLE001
        assert "widths" in str(error)
    else:
        raise AssertionError("a vector of the wrong width was accepted")


def test_each_text_is_embedded_once(spark):
    docs = spark.range(40).selectExpr("id", "IF(id % 3 = 0, 'same', concat('t', CAST(id % 7 AS STRING))) AS t")
    seen = tempfile.mkdtemp()

    def recording(texts):
        import uuid

        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return hex_embedder(texts)

    embedded, _ = embed_column(
        docs, "t", recording, "m", ["id"], dim=DIM,
        store=lambda rows: (rows.write.parquet(f"{seen}-vectors"), spark.read.parquet(f"{seen}-vectors"))[1],
    )
    assert embedded.filter("embedding IS NOT NULL").count() == 40
    texts = [t for name in os.listdir(seen) for t in open(f"{seen}/{name}").read().split("\n")]
    assert sorted(texts) == sorted({r.t for r in docs.collect()})


def test_texts_that_occur_once_are_embedded_in_place(spark):
    rows = spark.range(60).selectExpr(
        "id", "CASE WHEN id % 4 = 0 THEN 'same' WHEN id % 4 = 1 THEN concat('t', id) WHEN id % 8 = 2 THEN concat('c', id) END AS t"
    )
    root, seen = tempfile.mkdtemp(), spark.sparkContext.accumulator(0)

    def counting(texts):
        seen.add(len(texts))
        return hex_embedder(texts)

    def keep(df, name):
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    now = F.expr(NOW)
    cached = rows.filter("t LIKE 'c%'").select(
        F.sha2("t", 256).alias("text_hash"), F.lit("m").alias("model"),
        F.array_repeat(F.lit(7.0).cast("float"), DIM).alias("embedding"), now.alias("cached_at"),
    )
    embedded, fresh = embed_column(
        rows, "t", counting, "m", ["id"], dim=DIM, cache=cached, now=now, store=lambda vectors: keep(vectors, "vectors"), keep=keep
    )
    found = {r.id: (r.t, r.embedding) for r in embedded.collect()}
    texts = {r.id: r.t for r in rows.collect()}
    assert len(found) == embedded.count() == 60 and {i: t for i, (t, _) in found.items()} == texts
    new = {t for t in texts.values() if t and t[0] != "c"}
    plain = dict(zip(sorted(new), map(list, hex_embedder(sorted(new))), strict=True))
    for t, vector in found.values():
        assert vector is None if t is None else vector == ([7.0] * DIM if t[0] == "c" else plain[t])
    assert fresh.count() == len(new) == seen.value
    # only the repeated text and the cached ones are left to travel
    assert spark.read.parquet(f"{root}/single_texts").count() == len(new) - 1


def test_keys_that_occur_once_are_told_apart(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5), ("c", None)], "k STRING, n INT")
    marks = R.with_single(rows, ["k"], R.crowded_buckets(rows.select("k")))
    assert {(r.k, r.n): r._single for r in marks.collect()} == {
        ("a", 1): False, ("b", 2): True, ("a", 3): False, (None, 4): False, (None, 5): False, ("c", None): True,
    }
    many = spark.range(3000).selectExpr("id", "id % 2000 AS k")
    marks = R.with_single(many, ["k"], R.crowded_buckets(many.select("k"))).filter("_single")
    assert marks.filter("k < 1000").isEmpty() and marks.count() > 990


def test_reload_moves_no_posting_whose_key_occurs_once(spark):
    root = tempfile.mkdtemp()
    store = S.Store(spark, f"{root}/store")
    rows = [(f"s{n % 25}", "x", f"title {n}", "c", None, "d " * n, "u", None, None, n, None, None, None) for n in range(30)]
    raw = spark.createDataFrame(rows, schemas.RAW_JOB)
    moved = []
    latest = I.latest_wins
    I.latest_wins = lambda df, *more: (moved.append(df.count()), latest(df, *more))[1]
    try:
        I.reset_from_csv(store, raw, EMBEDDING, F.expr(NOW))
    finally:
        I.latest_wins = latest
    jobs = store.jobs.read()
    assert moved == [10] and jobs.count() == 25
    hashes = {r.source_id: r.content_hash for r in jobs.collect()}
    every = I.with_content_hash(raw).groupBy("source_id").agg(F.max("content_hash").alias("h")).collect()
    assert hashes == {r.source_id: r.h for r in every}


def test_csv(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/a.csv", "w", newline="") as f:
        f.write(
            "id,sourceId,source,title,company,location,description,url,jobType,minSalary,maxSalary\r\n"
            '1,s1,x,"Dev, ""senior""",Co,,"line one\nline two",u,,60000.9,abc\r\n'
            "2,s2,x,too,few\r\n"
            "3,s3,x,t,c,l,d,u,contract,,70000,extra\r\n"
            "4,s4,x,t,c,l,d,u,contract,,70000\r\n"
        )
    rows = {r.source_id: r for r in T.csv_to_raw(T.read_csv_rows(spark, folder)).collect()}
    assert set(rows) == {"s1", "s4"}
    assert (rows["s1"].title, rows["s1"].description, rows["s1"].location) == ('Dev, "senior"', "line one\nline two", None)
    assert (rows["s1"].job_type, rows["s1"].min_salary, rows["s1"].max_salary) == (None, 60000, None)
    assert (rows["s4"].job_type, rows["s4"].min_salary, rows["s4"].max_salary) == ("contract", None, 70000)


def test_judgment_log(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/log.json", "w") as f:
        json.dump([["local:q1:a", "relevant"], ["gemini:q1:a", "marginal"], ["local:q1:a", "not_relevant"]], f)
    log = T.read_judgment_log(spark, f"{folder}/log.json")
    assert {(r.judge, r.query_id, r.job_id, r.verdict) for r in log.collect()} == {
        ("local", "q1", "a", "not_relevant"), ("gemini", "q1", "a", "marginal"),
    }
    assert {r.judge: r.judgments for r in S.judgment_counts(log).collect()} == {"local": 1, "gemini": 1}
    with open(f"{folder}/large.json", "w") as f:
        json.dump([[f"local:q{i % 5}:job {i % 700}", ["relevant", "marginal", "not_relevant"][i // 700 % 3]] for i in range(30_000)], f, indent=1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        large = T.read_judgment_log(spark, f"{folder}/large.json")
        assert spark.read.option("lineSep", "]").text(f"{folder}/large.json").rdd.getNumPartitions() > 4  # one file, many tasks
        last = {f"{i % 5}/{i % 700}": ["relevant", "marginal", "not_relevant"][i // 700 % 3] for i in range(30_000)}
        assert {f"{r.query_id[1:]}/{r.job_id[4:]}": r.verdict for r in large.collect()} == last
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    with open(f"{folder}/cut off.json", "w") as f:
        f.write('[["local:q1:a","relevant"],["local:q1:b","marg')
    assert [r.job_id for r in T.read_judgment_log(spark, f"{folder}/cut off.json").collect()] == ["a"]
    with open(f"{folder}/broken.json", "w") as f:
        f.write("no json")
    assert T.read_judgment_log(spark, f"{folder}/broken.json").count() == 0


def test_catalogue(spark):
    questions = T.catalogue(spark)
    assert questions.count() == 15 and questions.select("category").distinct().count() == 5
    folder = tempfile.mkdtemp() + "/catalogue"
    questions.write.json(folder)
    assert T.read_catalogue(spark, folder).count() == 15


def test_metrics(spark):
    judged = spark.createDataFrame(
        [("q1", "a", 1, "marginal"), ("q1", "b", 2, "relevant"), ("q1", "c", 3, "relevant"), ("q2", "a", 1, "not_relevant")],
        "query_id STRING, job_id STRING, rank INT, verdict STRING",
    )
    queries = spark.createDataFrame([("q1", "exact"), ("q2", "exact"), ("q3", "noisy")], "query_id STRING, category STRING")
    found = {(r.query_id, r.k): (r.precision, r.mrr, r.ndcg) for r in E.per_query_metrics(judged, queries).collect()}
    assert found["q1", 3] == found["q1", 10] == (0.667, 0.5, 0.693)
    assert found["q1", 1] == found["q2", 5] == found["q3", 5] == (0.0, 0.0, 0.0)
    assert len(found) == 12


def test_evaluation_judges_each_pair_once(spark):
    from checks import views

    sf, root = "/root/testdata/sf0.001", tempfile.mkdtemp()
    store, queries = S.Store(spark, f"{root}/store"), views.questions(spark, sf)
    chunks = views.chunks(spark, sf).withColumn("job_id", F.col("job_id").cast("string"))
    jobs = views.jobs(spark, sf).withColumns({"id": F.col("id").cast("string"), "description": F.col("title")})

    def run(fn):
        return E.run_evaluation(store, chunks, jobs, queries, "local", fn, threshold=views.THRESHOLD)

    def first(question, title, start):
        return title.map(lambda t: "Relevant" if "BUILDING" in t else "no")

    def second(question, title, start):
        raise AssertionError("the judge was asked again")

    report = run(first)
    pairs = E.retrieve_for_eval(chunks, queries, threshold=views.THRESHOLD).count()
    assert store.judgments.read().count() == pairs > 0
    once = {name: sorted(map(str, table.collect())) for name, table in report.items()}
    again = {name: sorted(map(str, table.collect())) for name, table in run(second).items()}
    assert once == again
    (overall,) = report["overall"].collect()
    assert overall.query_count == 10 and 0 < overall.precision < 1
    assert all(0 <= r.precision <= 1 and 0 <= r.ndcg <= 1 and r.mrr <= 1 for r in report["per_query"].collect())


def test_stream_of_distinct_contents(spark):
    folder, name = tempfile.mkdtemp(), "distinct_contents_test"
    with open(f"{folder}/a.json", "w") as f:
        f.write("\n".join(json.dumps({"content_hash": h}) for h in "aabca"))
    stream = distinct_contents(spark.readStream.schema("content_hash STRING").json(folder))
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.content_hash for r in spark.table(name).collect()) == ["a", "b", "c"]


def test_stream_state_is_bounded(spark):
    """Repeats inside the delay are dropped, inside and across triggers; keys leave the state once the watermark has passed."""
    folder, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    days = [["2024-01-01"] * 2, ["2024-01-02"], ["2024-03-01"], ["2024-03-02"], ["2024-03-02"]]
    for i, day in enumerate(days):
        with open(f"{folder}/{i}.json", "w") as f:
            f.write("\n".join(json.dumps({"content_hash": h, "at": d}) for d in day for h in ("a", f"only {i}")))
        os.utime(f"{folder}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("content_hash STRING, at TIMESTAMP").option("maxFilesPerTrigger", 1).json(folder)
    once = distinct_within(stream, ["content_hash"], "at", "5 days")
    query = once.writeStream.format("parquet").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    found = sorted(r.content_hash for r in spark.read.parquet(f"{out}/rows").collect())
    assert found == sorted(["a", "a", *[f"only {i}" for i in range(5)]])  # `a` comes again after the delay
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(state) <= 4 and state[-1] < 7


def test_cache_expires(spark):
    store = S.Store(spark, f"{tempfile.mkdtemp()}/store")
    ddl = "text_hash STRING, model STRING, embedding ARRAY<FLOAT>, cached_at TIMESTAMP_NTZ"
    rows = [("a", "m", [1.0], "2024-01-01"), ("a", "m", [2.0], "2024-01-30"), ("b", "m", [3.0], "2024-01-20"), ("c", "m", [4.0], "2024-01-28")]
    for row in rows:
        store.embedding_cache.commit(spark.sql(f"SELECT '{row[0]}' AS text_hash, 'm' AS model, array(CAST({row[2][0]} AS FLOAT)) AS embedding, TIMESTAMP_NTZ'{row[3]}' AS cached_at").to(spark.createDataFrame([], ddl).schema))
    assert S.expire_cache(store, F.expr(NOW), "run") and not S.expire_cache(store, F.expr(NOW))
    assert {(r.text_hash, r.embedding[0]) for r in store.embedding_cache.read().collect()} == {("a", 2.0), ("c", 4.0)}
    assert store.embedding_cache.vacuum() == 4 and store.embedding_cache.vacuum() == 0
    assert {r.text_hash for r in store.embedding_cache.read().collect()} == {"a", "c"}


def test_bookmarks(spark):
    ddl = "user_id STRING, job_id STRING, action STRING, ts INT, seq INT"
    events = spark.createDataFrame(
        [("u", "a", "save", 5, 1), ("u", "a", "save", 9, 2), ("u", "b", "save", 1, 3), ("u", "b", "unsave", 2, 4),
         ("u", "c", "unsave", 1, 5), ("u", "c", "save", 7, 6), ("u", "d", "save", 8, 7)], ddl,
    )
    saved = spark.createDataFrame([("u", "c", 0), ("u", "d", 3)], "user_id STRING, job_id STRING, saved_at INT")
    written, gone = S.bookmark_state(saved, events)
    assert {(r.job_id, r.saved_at) for r in written.collect()} == {("a", 5), ("c", 7), ("d", 3)}
    assert [r.job_id for r in gone.collect()] == ["b"]


def test_raw_contract(spark):
    assert spark.createDataFrame([], schemas.RAW_JOB).columns == schemas.RAW_JOB_COLUMNS
    assert spark.createDataFrame([], schemas.JOB).columns == schemas.JOB_COLUMNS
