"""Typed reads, exports and their ledger."""

from __future__ import annotations

import csv
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcheck.functions import text as X
from rollcheck.operators.registry import upsert

def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; a folder of our own where that is unset, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Types of the registry's base tables.
REGISTRY = {
    "documents": "doc_id long, part_number int, lang string, active_version boolean, revision_id string, filename string, pages int, expected_total int, processing_status string",
    "records": "record_id string, doc_id long, part_number int, serial_number string, lang string, ident string, house string, age int, gender string, name string, relation_type string, relation_name string, verification_status string, created_at timestamp, conf double, page int",
    "pages": "doc_id long, part_number int, page int, printed_page int, status string, error_type string, detected_language string, records_detected int, records_extracted int, records_review int",
    "issues": "issue_id long, doc_id long, page int, record_id string, issue_type string, severity string, status string, issue_detail string, created_at timestamp",
    "expectations": "part_number int, serial_start int, serial_end int, expected_total int",
}


def load_registry(spark: SparkSession, directory: str, tables: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The base tables of a folder, one Parquet file or folder each, under declared types; a column that a file lacks is null."""
    return {name: spark.read.schema(ddl).parquet(f"{directory.rstrip('/')}/{name}.parquet") for name, ddl in (tables or REGISTRY).items()}


#: Most bytes of a table of verified cases.
MOST_BYTES = 5 << 20
GROUND_TRUTH = ["case_id", "part_number", "lang", "serial_number", "ident", "name", "age"]


def read_ground_truth(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV of verified cases, 5 MiB at most, whose header must be exactly the given columns; blank rows are refused when read."""
    columns = columns or GROUND_TRUTH
    if (spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0) > MOST_BYTES:
        raise ValueError("more than 5 MiB")
    first = spark.read.text(path).limit(1).collect()
    header = next(csv.reader([first[0].value.lstrip("﻿")])) if first else []
    if len(header) != len(set(header)) or set(header) != set(columns):
        raise ValueError(f"header must have {sorted(set(columns) - set(header))} and not {sorted(set(header) - set(columns))}, each once")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    blank = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns]).isNull()
    return df.withColumn(columns[0], F.when(blank, F.raise_error(F.lit("blank row"))).otherwise(F.col(columns[0])))


def export_csv(df: DataFrame, path: str, nested: str | None = None, editions: tuple[str, ...] = ()) -> None:
    """Quoted CSV; a nested column goes out as JSON text, parted into one column for each edition (its lang) if some are given."""
    out = df.withColumn(nested, F.to_json(nested)) if nested else df
    if nested and editions:
        of = lambda edition: F.filter(nested, lambda r: r["lang"] == edition)
        out = df.select(*[c for c in df.columns if c != nested], *[F.to_json(of(e)).alias(f"{e}_{nested}") for e in editions])
    out.write.option("header", True).option("quoteAll", True).csv(path)


def export_json(df: DataFrame, path: str) -> DataFrame:
    """Rows as JSON lines, with a one-row manifest of their count beside them; the count comes from the write itself."""
    from pyspark.sql import Observation

    seen = Observation("export")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(f"{path}/rows")
    manifest = df.sparkSession.createDataFrame([(int(seen.get["n"]), "json")], "rows long, format string")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


FORMATS = ("csv", "json", "parquet")


def log_export(spark: SparkSession, ledger: str, fmt: str, rows: int | None, status: str, error: str | None = None, audit: str | None = None) -> None:
    """Appends a validated row to the ledger and, where audit names one, to the audit log; a missing or negative count is 0."""
    if fmt not in FORMATS or status not in ("completed", "failed"):
        raise ValueError("unknown format or status")
    row = spark.createDataFrame([(fmt, max(rows or 0, 0), status, error)], "format string, rows long, status string, error string").withColumn("at", F.current_timestamp())
    row.withColumn("completed_at", F.when(F.col("status") == "completed", F.col("at"))).write.mode("append").parquet(ledger)
    if audit:
        row.select(F.concat(F.lit("dataset.export."), "status").alias("action"), F.lit("dataset_export").alias("entity"), F.struct("format", "rows").alias("detail"), "at").write.mode("append").parquet(audit)


def master_dataset(slots: DataFrame, records: DataFrame) -> DataFrame:
    """One row per slot with its editions' records as an ordered array; slots without records have an empty one."""
    row = F.struct(F.when(F.col("lang") == "en", 1).otherwise(2).alias("place"), "record_id", "lang", "ident", "house", "age")
    per = records.filter("slot_serial is not null").groupBy("part_number", F.col("slot_serial").alias("serial_no")).agg(F.array_sort(F.collect_list(row)).alias("records"))
    joined = slots.join(per, ["part_number", "serial_no"], "left")
    return joined.withColumn("records", F.coalesce("records", F.array().cast(joined.schema["records"].dataType)))


def normalize_geography(ref: DataFrame, parent: str, child: str, value: str) -> DataFrame:
    """Parent and child dimension of a flat reference, the smallest value of each pair."""
    return ref.groupBy(parent, child).agg(F.min(value).alias(value))


#: States of a document whose run may go on, and errors of a page that may be tried again.
RESUMABLE = ("failed", "interrupted", "processing")
RETRYABLE = ("page_processing_failed", "page_persistence_failed")


def split_known_files(files: DataFrame, known: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """files and known (checksum, status, and doc_id where pages are given): new ones, ones to resume, and repeated ones to refuse.

    A known file resumes if its run failed, was interrupted or has not ended, or if one of its pages waits for
    review because it was lost.
    """
    can = F.col("status").isin(*RESUMABLE)
    if pages is not None:
        lost = pages.filter((F.col("status") == "requires_review") & F.col("error_type").isin(*RETRYABLE)).select("doc_id").distinct()
        known = known.join(lost.withColumn("_lost", F.lit(True)), "doc_id", "left")
        can = F.coalesce(can, F.lit(False)) | F.coalesce("_lost", F.lit(False))
    j = files.join(known.groupBy("checksum").agg(F.coalesce(F.max(can), F.lit(False)).alias("resumable")), "checksum", "left")
    return {"new": j.filter("resumable is null"), "resume": j.filter("resumable"), "refuse": j.filter("not resumable")}


def inspect_filenames(files: DataFrame) -> DataFrame:
    """files (name, declared_part, detected_part and, if known, declared_lang) with detected_lang, revision_year and refusal, null if the file is fine.

    A declared part or edition stands in for one that the name does not tell; both must agree where both are known.
    """
    declared = F.col("declared_lang") if "declared_lang" in files.columns else F.lit(None).cast("string")
    part = F.coalesce("declared_part", "detected_part")
    named = files.withColumn("detected_lang", F.when(F.col("name").rlike(X.EDITION_CODE), X.edition_from_filename(F.col("name"))))
    named = named.withColumn("revision_year", F.regexp_extract("name", r"(?:^|\D)(20\d{2})(?:\D|$)", 1).try_cast("int"))
    why = (
        F.when(~F.coalesce(F.lower("name").endswith(".pdf"), F.lit(False)), "not_a_pdf")
        .when(part.isNull(), "part_unknown")
        .when(F.col("declared_part") != F.col("detected_part"), "part_conflict")
        .when(F.coalesce(declared, "detected_lang").isNull(), "edition_unknown")
        .when(declared != F.col("detected_lang"), "edition_conflict")
    )
    return named.withColumn("refusal", why)


def directory_filter(users: DataFrame, text: str | None = None, role: str | None = None) -> DataFrame:
    if text:
        users = users.filter(F.lower("email").contains(text.lower()))
    return users.filter(F.col("role") == role) if role else users


def compat_views(spark: SparkSession, frames: dict[str, DataFrame], prefix: str = "compat_") -> None:
    """Older names of documents, pages, records and issues as temporary views."""
    names = {"documents": ("uploaded_documents", {"lang": "source_language"}), "pages": ("document_pages", {"page": "page_number"}), "records": ("source_records", {"lang": "source_language", "house": "house_number"}), "issues": ("record_issues", {"issue_detail": "detail"})}
    for k, (view, renamed) in names.items():
        frames[k].withColumnsRenamed(renamed).createOrReplaceTempView(prefix + view)


def upsert_into(new: DataFrame, path: str, keys: list[str], buckets: int = 64, keep_old: bool = False) -> None:
    """Inserts or updates rows by key in a Parquet table dealt to `buckets` folders by a hash of the key.

    Only the folders that new rows fall in are read and written; a re-run leaves the table as it is. Of several new rows
    with one key one is taken, the greatest. keep_old leaves known keys as they are. One writer at a time.
    """
    spark = new.sparkSession
    rest = [x for x in new.columns if x not in keys]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{x}").alias(x) for x in rest], bucket)
    scratch_dir(spark, "unused")
    one = one.checkpoint()
    touched = [r.bucket for r in one.select("bucket").distinct().collect()]  # `buckets` numbers at most
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [p for p in (f"{path}/bucket={b}" for b in touched) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    if there:
        old = spark.read.option("basePath", path).parquet(*there).select(*one.columns)
        one = upsert(old, one, keys, keep_old).checkpoint()  # stored before the folders that it is read from are replaced
    one.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_geography(ref: DataFrame, path: str, parent: str, child: str, value: str, buckets: int = 8) -> None:
    """Writes a flat reference's pairs of parent and child, each with its smallest value, by their natural key; known pairs take the new value."""
    upsert_into(normalize_geography(ref, parent, child, value), path, [parent, child], buckets)
