from datetime import timedelta

from pyspark.sql import functions as F
from rollcheck.sources.bindings import frames
from rollcheck.streaming import ingest


def test_ingest_twice_inserts_once(spark, tmp_path):
    rows = frames(spark, "/root/testdata/sf0.001")["records"].select("record_id", *ingest.EVIDENCE)
    src, target, audit = (str(tmp_path / n) for n in ("src", "target", "audit"))
    rows.write.parquet(src)
    n = rows.count()
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(src)
        ingest.ingest_stream(stream, target, audit, str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(target).count() == n
    for name in ("0", ".0.crc"):  # as if the job had ended before the batch was committed
        (tmp_path / "cp0" / "commits" / name).unlink(missing_ok=True)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    ingest.ingest_stream(stream, target, audit, str(tmp_path / "cp0")).awaitTermination()
    assert spark.read.parquet(target).count() == n
    changed = rows.limit(5).withColumn("age", F.col("age") + 1)
    changed.write.parquet(str(tmp_path / "src2"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src2"))
    ingest.ingest_stream(stream, target, audit, str(tmp_path / "cp9")).awaitTermination()
    got = {r.outcome: r.n for r in spark.read.parquet(audit).groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert got == {"inserted": n, "idempotent": n, "rejected": 5}


def feed(spark, rows, schema, src, run):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run(spark.readStream.schema(schema).parquet(src)).awaitTermination()


def test_checkpoints_keep_latest_attempt(spark, tmp_path):
    src, target, audit = (str(tmp_path / n) for n in ("src", "t", "audit"))
    schema = "doc_id int, page int, attempt int, status string, note string"
    run = lambda stream: ingest.checkpoint_stream(stream, target, str(tmp_path / "cp"), audit)
    batches = [
        [(1, 1, 1, "failed", None), (1, 2, 1, "processed", None)],
        [(1, 1, 2, "processed", None), (1, 2, 4, "failed", None), (1, 0, 1, "failed", None), (1, 3, 1, "odd", None), (None, 3, 1, "failed", None)],
        [(1, 1, 1, "failed", None), (1, 1, 2, "processed", None), (1, 2, 1, "processed", "again"), (2, 1, 1, "failed", None), (2, 1, 3, "failed", None), (2, 1, 2, "processed", None)],
    ]
    for rows in batches:
        feed(spark, rows, schema, src, run)
    got = {(r.doc_id, r.page, r.attempt, r.status, r.note) for r in ingest.latest_pages(spark, target).collect()}
    assert got == {(1, 1, 2, "processed", None), (1, 2, 1, "processed", "again"), (2, 1, 3, "failed", None)}
    # a batch writes its changed pages only
    written = {r.batch: r.n for r in spark.read.parquet(target).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert written == {0: 2, 1: 1, 2: 2}
    counts = {(r.batch, r.outcome, r.refusal): r.n for r in spark.read.parquet(audit).collect()}
    assert counts == {
        (0, "stored", None): 2,
        (1, "stored", None): 1,
        (1, "refused", "invalid_attempt"): 1,
        (1, "refused", "invalid_page"): 2,
        (1, "refused", "invalid_status"): 1,
        (2, "stale", None): 1,
        (2, "repeated", None): 1,
        (2, "superseded", None): 2,
        (2, "stored", None): 2,
    }
    # as if the job had ended before the last batch was committed: it runs again from the state before it
    for name in ("2", ".2.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run(spark.readStream.schema(schema).parquet(src)).awaitTermination()
    assert {(r.batch, r.outcome, r.refusal): r.n for r in spark.read.parquet(audit).collect()} == counts
    assert {(r.doc_id, r.page, r.attempt, r.status, r.note) for r in ingest.latest_pages(spark, target).collect()} == got


def test_checkpoint_state_expires(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "t")
    schema = "doc_id int, page int, attempt int, status string"
    run = lambda stream: ingest.checkpoint_stream(stream, target, str(tmp_path / "cp"), ttl=timedelta(milliseconds=1))
    for attempt in (2, 1):
        feed(spark, [(1, 1, attempt, "failed")], schema, src, run)
    assert sorted(r.attempt for r in spark.read.parquet(target).collect()) == [1, 2]
    assert ingest.latest_pages(spark, target).first().attempt == 2


RECORD = "record_id string, doc_id long, page int, part_number int, serial_number string, lang string, ident string, house string, age int, gender string, verification_status string, slot_serial int, card_index int, run_id string"


def record(record_id, at, /, **changed):
    row = dict(record_id=record_id, doc_id=1, page=at, part_number=7, serial_number="5", lang="en", ident="ABC", house="1", age=30, gender="M", verification_status="unverified", slot_serial=None, card_index=1, run_id="r")
    return tuple((row | changed).values())


def test_guarded_ingestion(spark, tmp_path):
    documents = spark.createDataFrame([(1, 7, "en"), (2, 8, "te"), (3, 7, "ur")], "doc_id long, part_number int, lang string")
    expectations = spark.createDataFrame([(7, 1, 50), (8, 51, 90)], "part_number int, serial_start int, serial_end int")
    issues = spark.createDataFrame([(1, 30)] * 301, "doc_id long, page int")
    runs = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "run_id string, doc_id long")
    src, target, audit = (str(tmp_path / n) for n in ("src", "t", "audit"))
    run = lambda stream: ingest.ingest_stream(stream, target, audit, str(tmp_path / "cp"), documents, expectations, issues, runs, ("en", "te"), buckets=8)
    bad = {
        "unknown_document": dict(doc_id=9),
        "unsupported_document": dict(doc_id=3, lang="ur"),
        "foreign_run": dict(run_id="other"),
        "invalid_page": dict(page=0),
        "part_mismatch": dict(part_number=8),
        "edition_mismatch": dict(lang="te"),
        "not_unverified": dict(verification_status="verified"),
        "linked_or_verified": dict(slot_serial=5),
        "invalid_card": dict(card_index=31),
        "invalid_serial": dict(serial_number="51"),
    }
    rows = [record(f"bad-{why}", 10 + k, **changed) for k, (why, changed) in enumerate(bad.items())]
    rows += [record(f"same-{why}", 10 + k, card_index=2) for k, why in enumerate(bad)]  # the same pages' other records
    rows += [record(f"good-{k}", 1, card_index=k, serial_number=s) for k, s in ((1, "1"), (2, None), (3, "50"))]
    rows += [record(f"many-{k}", 40, card_index=1 + k % 30) for k in range(31)] + [record("issues", 30)]
    rows += [record("card-a", 41), record("card-b", 41)]
    feed(spark, rows, RECORD, src, run)
    counts = {(r.page, r.outcome, r.refusal): r.n for r in spark.read.parquet(audit).collect()}
    want = {(0 if why == "invalid_page" else 10 + k, "refused", why): 1 for k, why in enumerate(bad)}
    want |= {(10 + k, "page_refused", None): 1 for k, why in enumerate(bad) if why not in ("unknown_document", "unsupported_document", "invalid_page")}
    lone = {(10 + k, "inserted", None): 1 for k, why in enumerate(bad) if why in ("unknown_document", "unsupported_document", "invalid_page")}
    want |= lone | {(1, "inserted", None): 3, (40, "refused", "batch_too_large"): 31, (30, "refused", "batch_too_large"): 1, (41, "refused", "card_conflict"): 2}
    assert counts == want
    assert spark.read.parquet(target).count() == 3 + len(lone)

    # repeats, an overwrite with a new record beside it, and a new page
    again = [record("good-1", 1, card_index=1, serial_number="1"), record("good-2", 1, card_index=2, age=31, serial_number=None), record("late", 1, card_index=9), record("new", 2)]
    feed(spark, again, RECORD, src, run)
    second = {(r.outcome, r.refusal): r.n for r in spark.read.parquet(audit).filter("batch = 1").collect()}
    assert second == {("idempotent", None): 1, ("rejected", None): 1, ("page_refused", None): 1, ("inserted", None): 1}
    assert spark.read.parquet(target).count() == 4 + len(lone)

    # a batch reads the folders of its own ids only
    folders = {r.record_id: r.bucket for r in spark.read.parquet(target).select("record_id", "bucket").collect()}
    part = ingest.stored_rows(spark, target, [folders["new"]])
    assert {f.split("bucket=")[1].split("/")[0] for f in part.inputFiles()} == {str(folders["new"])} and len(set(folders.values())) > 1
    assert ingest.stored_rows(spark, target, []) is None


def test_repeats_dropped_in_stream(spark, tmp_path):
    schema = "record_id string, at timestamp_ntz"
    rows = spark.sql("select 'a' record_id, timestamp_ntz '2024-01-01 00:00:00' at union all select 'a', timestamp_ntz '2024-01-01 00:00:05' union all select 'b', timestamp_ntz '2024-01-01 00:00:05'")
    rows.write.parquet(str(tmp_path / "src"))
    stream = ingest.drop_retried(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), "at")
    q = stream.writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.sql("select count(*) n from kept").first().n == 2
