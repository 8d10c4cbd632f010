"""Retry-safe ingestion of extracted records as Structured Streaming jobs."""

from __future__ import annotations

import hashlib
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rollcheck.sources.io import RETRYABLE

EVIDENCE = ("doc_id", "part_number", "serial_number", "lang", "ident", "house", "age", "gender")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not s.getPath().getName().startswith("_") for s in fs.listStatus(p))


def judge(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Adds outcome: inserted, idempotent (same id, same evidence) or rejected (same id, other evidence).

    Within a batch the smallest evidence of an id stands for it; equal repeats are idempotent.
    """
    e = F.struct(*EVIDENCE)
    first = batch.groupBy("record_id").agg(F.min(e).alias("_first"))
    rows = batch.withColumn("_e", e).join(first, "record_id")
    if stored is not None:
        rows = rows.join(stored.select("record_id", F.struct(*EVIDENCE).alias("_old")), "record_id", "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast(rows.schema["_e"].dataType))
    known = F.coalesce("_old", "_first")
    same = F.col("_e").eqNullSafe(known)
    return rows.withColumn("outcome", F.when(~same, "rejected").when(F.col("_old").isNotNull(), "idempotent").otherwise("inserted")).drop("_e", "_first", "_old")


#: Most records of a page in one batch, most issues, and most cards on a page.
PAGE_RECORDS, PAGE_ISSUES, PAGE_CARDS = 30, 300, 30


def bind_rules(records: DataFrame, documents: DataFrame, expectations: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Adds what the rules look up, by joins that a stream may make with tables: _doc, _part, _edition, _low, _high and _run."""
    docs = documents.select(F.col("doc_id").alias("_doc"), F.col("part_number").alias("_part"), F.col("lang").alias("_edition"))
    docs = docs.join(expectations.select(F.col("part_number").alias("_part"), F.col("serial_start").alias("_low"), F.col("serial_end").alias("_high")), "_part", "left")
    out = records.join(docs, F.col("doc_id") == F.col("_doc"), "left")
    if runs is None or "run_id" not in records.columns:
        return out.withColumn("_run", F.lit(True))
    known = runs.select(F.col("run_id").alias("_id"), F.col("doc_id").alias("_of"), F.lit(True).alias("_run")).distinct()
    return out.join(known, (F.col("run_id") == F.col("_id")) & (F.col("doc_id") == F.col("_of")), "left").drop("_id", "_of")


BOUND = ("_doc", "_part", "_edition", "_low", "_high", "_run")


def apply_rules(bound: DataFrame, issues: DataFrame | None = None, editions: tuple[str, ...] | None = None) -> DataFrame:
    """Adds refusal to rows of bind_rules, null where a record may be stored: the first rule that it breaks.

    A page brings at most 30 records and 300 issues; the document is known, of a supported edition if those are
    given, and the run is the document's; pages count from 1, cards from 1 to 30 and each once on its page; part
    and edition are the document's; the record is unverified or for review and carries no link or verifier; a
    serial number lies in the range of its part. Columns that a batch lacks are not looked at.
    """
    columns = [x for x in bound.columns if x not in BOUND]
    has = set(columns)
    page = ["doc_id", "page"]
    # windows, so that records joined to their documents are not shuffled again by page
    rows = bound.withColumn("_n", F.count("*").over(Window.partitionBy(*page)))
    if issues is not None:
        many = issues.groupBy(*page).agg(F.count("*").alias("_issues")).filter(F.col("_issues") > PAGE_ISSUES)
        rows = rows.join(many.groupBy("doc_id").agg(F.collect_set(F.col("page").cast("long")).alias("_many")), "doc_id", "left")
    else:
        rows = rows.withColumn("_many", F.lit(None).cast("array<long>"))
    if "card_index" in has:
        card = Window.partitionBy(*page, "card_index")
        rows = rows.withColumn("_clash", F.min("record_id").over(card) != F.max("record_id").over(card))
    serial = F.when(F.col("serial_number").rlike("^[0-9]+$"), F.col("serial_number").try_cast("int"))
    linked = [F.col(x).isNotNull() for x in ("slot_serial", "verified_by", "verified_at") if x in has]
    no = F.lit(False)
    why = (
        F.when((F.col("_n") > PAGE_RECORDS) | F.coalesce(F.array_contains("_many", F.col("page").cast("long")), no), "batch_too_large")
        .when(F.col("_doc").isNull(), "unknown_document")
        .when(F.col("_edition").isNull() | ~F.col("_edition").isin(*editions) if editions else no, "unsupported_document")
        .when(F.col("_run").isNull(), "foreign_run")
        .when(F.coalesce(F.col("page") < 1, no), "invalid_page")
        .when(~F.col("_part").eqNullSafe(F.col("part_number")), "part_mismatch")
        .when(~F.col("_edition").eqNullSafe(F.col("lang")) if "lang" in has else no, "edition_mismatch")
        .when(~F.coalesce(F.col("verification_status").isin("unverified", "requires_review"), no), "not_unverified")
        .when(F.array_contains(F.array(no, *linked), True), "linked_or_verified")
        .when(~F.coalesce(F.col("card_index").between(1, PAGE_CARDS), no) if "card_index" in has else no, "invalid_card")
        .when(F.col("_clash") if "card_index" in has else no, "card_conflict")
        .when(F.col("serial_number").isNotNull() & ~F.coalesce(serial.between(F.col("_low"), F.col("_high")), no), "invalid_serial")
    )
    return rows.withColumn("refusal", why).select(*columns, "refusal")


def check_batch(batch: DataFrame, documents: DataFrame, expectations: DataFrame, issues: DataFrame | None = None, runs: DataFrame | None = None, editions: tuple[str, ...] | None = None) -> DataFrame:
    """Adds refusal, null where a record may be stored; see apply_rules."""
    return apply_rules(bind_rules(batch, documents, expectations, runs), issues, editions)


#: Folders that the target's records are dealt to by their id.
BUCKETS = 256


def stored_rows(spark: SparkSession, target: str, buckets: list[int]) -> DataFrame | None:
    """Stored records of some buckets; the folders of other buckets are not even listed. None where there are none."""
    paths = [p for p in (f"{target}/bucket={b}" for b in buckets) if _exists(spark, p)]
    return spark.read.option("basePath", target).parquet(*paths) if paths else None


def whole_pages(judged: DataFrame) -> DataFrame:
    """A page is stored as a whole: where one of its records is refused or rejected, the others are not inserted (page_refused)."""
    bad = judged.filter(F.col("outcome").isin("refused", "rejected")).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p")).distinct()
    rows = judged.join(bad.withColumn("_bad", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")), "left")
    outcome = F.when(F.col("_bad") & (F.col("outcome") == "inserted"), "page_refused").otherwise(F.col("outcome"))
    return rows.withColumn("outcome", outcome).drop("_d", "_p", "_bad")


def ingest_stream(
    records: DataFrame,
    target: str,
    audit: str,
    checkpoint: str,
    documents: DataFrame | None = None,
    expectations: DataFrame | None = None,
    issues: DataFrame | None = None,
    runs: DataFrame | None = None,
    editions: tuple[str, ...] | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Adds new records to target and counts of outcomes to audit, all available input at once.

    With documents and expectations the rules hold: records that break one are refused, and a page with such a
    record, or with one that would overwrite another, is refused whole. The rules' tables are joined to the stream.
    The target is dealt to folders by record id; a batch reads the folders of its own ids and adds one to each. A batch
    that runs again is judged without its own rows and writes them anew, so neither table changes. The number of
    buckets of a target must stay the same. audit has doc_id and page if the records have them, outcome, refusal and n.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    guarded = documents is not None and expectations is not None
    paged = [x for x in ("doc_id", "page") if x in records.columns]
    source = bind_rules(records, documents, expectations, runs) if guarded else records

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        checked = apply_rules(batch, issues, editions) if guarded else batch.withColumn("refusal", F.lit(None).cast("string"))
        checked = checked.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int")).persist()
        judged = checked
        try:
            fine = checked.filter("refusal is null")
            touched = [r.bucket for r in fine.select("bucket").distinct().collect()]  # `buckets` numbers at most
            stored = stored_rows(spark, target, touched)
            if stored is not None:
                stored = stored.filter(~((F.col("run") == run) & (F.col("batch") == number)))
            judged = judge(fine, stored).unionByName(checked.filter("refusal is not null").withColumn("outcome", F.lit("refused")))
            judged = (whole_pages(judged) if guarded else judged).persist()
            judged.groupBy(*paged, "outcome", "refusal").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{audit}/run={run}/batch={number}")
            new = judged.filter("outcome = 'inserted'").drop("outcome", "refusal").dropDuplicates(["record_id"])
            new = new.withColumns({"run": F.lit(run), "batch": F.lit(number)}).repartition("bucket")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run", "batch").parquet(target)
        finally:
            judged.unpersist()
            checked.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_retried(records: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """Repeats of a record id within the watermark are dropped in the stream."""
    return records.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["record_id"])


PAGE_STATES = ("processing", "completed", "completed_with_warnings", "processed", "requires_review", "failed")


class PageCheckpoints(StatefulProcessor):
    """Keeps each page's last attempt as keyed state; says of every row what became of it."""

    def __init__(self, names: list[str], ttl_ms: int | None) -> None:
        self.names, self.ttl_ms = names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "attempt int, digest string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        known = tuple(self.last.get()) if self.last.exists() else None
        first, held, given = known, None, []
        for row in sorted(rows, key=lambda r: (r["refusal"] is not None, r["attempt"] or 0, r["digest"])):
            if row["refusal"] is not None:
                given.append((row, "refused"))
            elif known is not None and (row["attempt"], row["digest"]) == known:
                given.append((row, "repeated"))
            elif known is not None and row["attempt"] < known[0]:
                given.append((row, "stale"))
            else:
                if held is not None:
                    given.append((held, "superseded"))
                held, known = row, (row["attempt"], row["digest"])
        if held is not None:
            given.append((held, "stored"))
        if known != first:
            self.last.update(known)
        for row, outcome in given:
            yield Row(**{n: row[n] for n in self.names}, refusal=row["refusal"], outcome=outcome)

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def check_pages(pages: DataFrame) -> DataFrame:
    """Adds refusal: pages count from 1, attempts from 1 to 3, retries from 0 to 2, and the state is a known one."""
    has = set(pages.columns)
    no = F.lit(False)
    within = lambda x, low, high: ~F.coalesce(F.col(x).between(low, high), no)
    why = (
        F.when(F.col("doc_id").isNull() | ~F.coalesce(F.col("page") >= 1, no), "invalid_page")
        .when(within("attempt", 1, 3), "invalid_attempt")
        .when(within("retry_count", 0, 2) if "retry_count" in has else no, "invalid_retry")
        .when(~F.coalesce(F.col("status").isin(*PAGE_STATES), no), "invalid_status")
    )
    return pages.withColumn("refusal", why)


def checkpoint_stream(pages: DataFrame, target: str, checkpoint: str, audit: str | None = None, ttl: timedelta | None = None) -> StreamingQuery:
    """Upserts the checkpoint of each page (doc_id, page): the latest attempt, 1 to 3, wins; of one attempt the row met last.

    The last attempt of a page is keyed state in a state store (dropped `ttl` after its last change, if given), so a
    batch costs what its own rows cost. target gets a folder of changed pages for each batch, written anew when a
    batch runs again; latest_pages reads it. Repeats, older attempts and refused rows change nothing and are counted in audit.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    names, types = pages.columns, ", ".join(f"`{n}` {t}" for n, t in pages.dtypes)
    rows = check_pages(pages).withColumn("digest", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))
    ttl_ms = None if ttl is None else int(ttl.total_seconds() * 1000)
    kept = rows.groupBy("doc_id", "page").transformWithState(PageCheckpoints(names, ttl_ms), f"{types}, refusal string, outcome string", "Update", "None" if ttl_ms is None else "ProcessingTime")

    def write(batch: DataFrame, number: int) -> None:
        own = f"run={run}/batch={number}"
        batch.persist()
        try:
            batch.filter("outcome = 'stored'").select(*names).write.mode("overwrite").parquet(f"{target}/{own}")
            if audit:
                batch.groupBy("outcome", "refusal").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{audit}/{own}")
        finally:
            batch.unpersist()

    spark = pages.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)  # the query takes its settings at its start
    try:
        out = kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        # with a clock for expiry there is always another batch to run, so such a query takes all input in one
        return (out.trigger(availableNow=True) if ttl_ms is None else out.trigger(once=True)).start()
    finally:
        spark.conf.set(key, before)


def latest_pages(spark: SparkSession, target: str) -> DataFrame:
    """The state of every page in a target of checkpoint_stream: its highest attempt, of those the latest batch's."""
    rows = spark.read.parquet(target)
    names = [x for x in rows.columns if x not in ("run", "batch", "doc_id", "page")]
    return rows.groupBy("doc_id", "page").agg(F.max_by(F.struct(*names), F.struct("attempt", "batch", "run")).alias("s")).select("doc_id", "page", "s.*")


def resume_set(pages: DataFrame) -> DataFrame:
    """(doc_id, page, action) of saved pages: skip the processed and those whose review has another cause than a lost run; retry the latter; process the rest."""
    again = F.coalesce(F.col("error_type").isin(*RETRYABLE), F.lit(False))
    review = F.col("status") == "requires_review"
    return pages.select("doc_id", "page", F.when((F.col("status") == "processed") | (review & ~again), "skip").when(review, "retry").otherwise("process").alias("action"))
