"""Expected slots, linking of records to slots, canonical election and the registry's checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcheck.functions import text as X


def small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint where the optimizer's size estimate is under the limit; Spark chooses the join otherwise."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns set whose expressions run once a row, however often later columns and filters refer to them.

    They come out of a generator, which the optimizer neither merges with what refers to them nor moves filters through.
    """
    kept = [x for x in df.columns if x not in made]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def spread(expectations: DataFrame) -> DataFrame:
    """Expectations dealt to the session's number of shuffle partitions, which the optimizer does not merge again."""
    return expectations.repartition(int(expectations.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part_number")


def active_records(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Records of active document versions."""
    return records.join(small(documents.filter("active_version").select("doc_id")), "doc_id")


def expected_slots(expectations: DataFrame) -> DataFrame:
    """(part_number, serial_no) of every expected slot, without attributes.

    Expectations are few and short, so that they may lie in one partition; they are dealt to all before they become slots.
    """
    return spread(expectations.select("part_number", "serial_start", "serial_end")).select("part_number", F.explode(F.sequence("serial_start", "serial_end")).alias("serial_no"))


def link_records(records: DataFrame, expectations: DataFrame) -> DataFrame:
    """Adds slot_serial: the expected serial of its part that a record's serial names, else null."""
    e = small(expectations.select(F.col("part_number").alias("_part"), "serial_start", "serial_end"))
    n = X.parse_serial(F.col("serial_number"))
    joined = records.join(e, (F.col("part_number") == F.col("_part")) & n.between(F.col("serial_start"), F.col("serial_end")), "left")
    return joined.withColumn("slot_serial", F.when(F.col("_part").isNotNull(), n)).drop("_part", "serial_start", "serial_end")


def quarantine(records: DataFrame, expectations: DataFrame, legacy: Column | None = None) -> DataFrame:
    """Adds quarantine_reason: why a record's serial is not an expected slot's; null if it is.

    Looked at in this order: no serial, one that is not digits, one that no expectation of its part
    holds in canonical form (an unknown part has none), and rows that the caller marks as legacy.
    """
    e = small(expectations.select(F.col("part_number").alias("_part"), "serial_start", "serial_end"))
    joined = records.join(e, F.col("part_number") == F.col("_part"), "left")
    s = F.trim("serial_number")
    reason = (
        F.when(s.isNull(), "missing_serial")
        .when(~s.rlike("^[0-9]+$"), "non_numeric_serial")
        .when(~X.is_canonical_serial(F.col("serial_number"), F.col("serial_start"), F.col("serial_end")), "unexpected_or_noncanonical_serial")
    )
    if legacy is not None:
        reason = reason.when(legacy, "legacy_orphan")
    return joined.withColumn("quarantine_reason", reason).drop("_part", "serial_start", "serial_end")


def elect_canonical(linked: DataFrame, edition: str = "en") -> DataFrame:
    """(part_number, slot_serial, candidates, canonical_id): the only candidate of the edition; null where several leave it open."""
    own = linked.filter((F.col("lang") == edition) & F.col("slot_serial").isNotNull())
    found = own.groupBy("part_number", "slot_serial").agg(F.count("*").alias("candidates"), F.min("record_id").alias("only_id"))
    return found.select("part_number", "slot_serial", "candidates", F.when(F.col("candidates") == 1, F.col("only_id")).alias("canonical_id"))


def elect_canonical_v0(records: DataFrame, edition: str = "en") -> DataFrame:
    """Earlier rule: serials unique in the edition own a slot; other editions link by serial, else by an unambiguous ident.

    Returns record_id, part_number, slot_serial (null: ambiguous or unlinked).
    """
    own = records.filter(F.col("lang") == edition)
    n = F.count("*").over(Window.partitionBy("part_number", "serial_number"))
    first = own.withColumn("n", n).select("record_id", "part_number", F.when((F.col("n") == 1) & F.col("serial_number").isNotNull(), F.col("serial_number")).alias("slot_serial"))
    slots = first.filter("slot_serial is not null").select("part_number", "slot_serial")
    others = records.filter(F.col("lang") != edition)
    by_serial = others.join(slots.withColumn("serial_number", F.col("slot_serial")), ["part_number", "serial_number"], "left")
    idents = unambiguous_idents(own.join(slots.withColumn("serial_number", F.col("slot_serial")), ["part_number", "serial_number"]))
    linked = by_serial.join(idents, ["part_number", "ident"], "left").select("record_id", "part_number", F.coalesce("slot_serial", "ident_serial").alias("slot_serial"))
    return first.unionByName(linked)


def unambiguous_idents(records: DataFrame) -> DataFrame:
    """(part_number, ident, ident_serial) of idents that one serial alone carries."""
    known = records.filter("ident is not null and serial_number is not null")
    return known.groupBy("part_number", "ident").agg(F.countDistinct("serial_number").alias("n"), F.min("serial_number").alias("ident_serial")).filter("n = 1").drop("n")


def distinct_slots_v0(records: DataFrame, edition: str = "en") -> DataFrame:
    """Slots as the distinct serials of one edition's active records."""
    return records.filter((F.col("lang") == edition) & F.col("serial_number").isNotNull()).select("part_number", "serial_number").distinct()


def slot_activity_v0(slots: DataFrame, records: DataFrame, edition: str = "en") -> DataFrame:
    """slots (part_number, serial_number) as known, and those met now: active where the edition's active records have them, else inactive."""
    met = distinct_slots_v0(records, edition).withColumn("_met", F.lit(True))
    known = slots.select("part_number", "serial_number").distinct()
    return known.join(met, ["part_number", "serial_number"], "full").select("part_number", "serial_number", F.coalesce("_met", F.lit(False)).alias("active"))


def registry_invariant(slots: DataFrame, expectations: DataFrame) -> DataFrame:
    """part_number, expected_total, slots, holds: whether each part has the slots that its configuration says."""
    n = slots.groupBy("part_number").agg(F.count("*").alias("slots"))
    joined = expectations.select("part_number", "expected_total").join(n, "part_number", "left")
    return joined.select("part_number", "expected_total", F.coalesce("slots", F.lit(0)).alias("slots"), (F.coalesce("slots", F.lit(0)) == F.col("expected_total")).alias("holds"))


def quarantine_house(records: DataFrame) -> DataFrame:
    """Records with suspicious house numbers nulled, their confidence 0 and their status set for review."""
    bad = X.suspicious_house(F.col("house"))
    return records.select("record_id", F.when(~bad, F.col("house")).alias("house"), F.when(bad, F.lit(0.0)).otherwise(F.col("conf")).alias("conf"), F.when(bad, "requires_review").otherwise("unverified").alias("verification_status"))


def house_issues(records: DataFrame, issues: DataFrame) -> DataFrame:
    """One house_number issue for each suspicious record without an open one."""
    bad = records.filter(X.suspicious_house(F.col("house"))).select("record_id", "doc_id", F.lit("house_number").alias("issue_type"))
    return bad.join(issues.filter("issue_type = 'house_number' and status = 'open'").select("record_id"), "record_id", "left_anti")


def activate_version(documents: DataFrame, order: list[Column], finished: tuple[str, ...] = ("completed", "completed_with_warnings")) -> DataFrame:
    """Adds becomes_active: the first finished document of each part and edition, by the given order.

    Where none is finished the active one stays, so an interrupted run never leaves an edition empty.
    """
    ready = F.col("processing_status").isin(*finished)
    here = Window.partitionBy("part_number", "lang")
    rank = F.row_number().over(here.orderBy(ready.desc(), *order))
    return documents.withColumn("becomes_active", F.when(F.max(ready).over(here), rank == 1).otherwise(F.col("active_version")))


def lookup_documents(documents: DataFrame, ids: DataFrame | None = None, active_only: bool = False) -> DataFrame:
    """Documents, those of an id frame (doc_id), or the active ones; an empty id frame gives none."""
    out = documents.filter("active_version") if active_only else documents
    return out if ids is None else out.join(ids.select("doc_id"), "doc_id", "left_semi")


def slot_records(linked: DataFrame, documents: DataFrame, slots: DataFrame) -> DataFrame:
    """Linked records of some slots (part_number, slot_serial) in active documents."""
    return active_records(linked, documents).join(slots.select("part_number", "slot_serial"), ["part_number", "slot_serial"], "left_semi")


def source_locator(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_id, filename, part_number, revision_id, page, box): where a record stands; the page is kept within 1 .. pages, null is the first.

    box is the place on the page, read from bounding_box where the records have it and it is well formed; null otherwise.
    """
    d = small(documents.select("doc_id", "filename", "revision_id", "pages"))
    page = F.least(F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)), F.greatest("pages", F.lit(1)))
    given = F.col("bounding_box") if "bounding_box" in records.columns else F.lit(None).cast("string")
    return records.select("record_id", "doc_id", "part_number", "page", X.parse_box(given).alias("box")).join(d, "doc_id").select("record_id", "filename", "part_number", "revision_id", page.alias("page"), "box")


def missing_primary(linked: DataFrame, slots: DataFrame, edition: str = "en") -> DataFrame:
    """Slots without any record of the edition."""
    have = linked.filter(F.col("lang") == edition).select("part_number", F.col("slot_serial").alias("serial_no"))
    return slots.join(have, ["part_number", "serial_no"], "left_anti")


def house_peers(records: DataFrame) -> DataFrame:
    """(record_id, peers): how many other records share document, part and house number.

    Counted, not paired: a house with n records gives n rows.
    """
    keyed = records.withColumn("k", X.house_key(F.col("house"))).filter("k is not null")
    sizes = keyed.groupBy("doc_id", "part_number", "k").agg((F.count("*") - 1).alias("peers"))
    return keyed.select("record_id", "doc_id", "part_number", "k").join(sizes, ["doc_id", "part_number", "k"]).select("record_id", "peers")


def compare_sets(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, in_expected, in_observed of a full comparison, as one aggregation; keys with a null equal none of the other side."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    side = lambda df, mine: df.select(*keys, F.lit(mine).alias("in_expected"), F.lit(not mine).alias("in_observed"), F.when(~known, mine).alias("_side"))
    both = side(expected, True).unionByName(side(observed, False))
    return both.groupBy(*keys, "_side").agg(F.max("in_expected").alias("in_expected"), F.max("in_observed").alias("in_observed")).drop("_side")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """Rows of old and new by key; new ones win, or old ones with keep_old."""
    first, second = (old, new) if keep_old else (new, old)
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))
