"""Completeness of parts and reconciliation of editions, by three rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcheck.functions import text as X
from rollcheck.operators.completeness import member_lists
from rollcheck.operators.paging import read_page
from rollcheck.operators.registry import expected_slots, link_records, small

FIELDS = ("ident", "house", "age", "gender")


def _scope(records: DataFrame, documents: DataFrame, expectations: DataFrame, editions: tuple[str, ...] = ("en", "te")) -> DataFrame:
    """Active records of some editions with comparable fields and their slot."""
    active = records.join(small(documents.filter("active_version").select("doc_id")), "doc_id").filter(F.col("lang").isin(*editions))
    return link_records(active, expectations).select(
        "record_id",
        "part_number",
        "lang",
        "slot_serial",
        "created_at",
        F.nullif(F.upper(F.trim("ident")), F.lit("")).alias("ident"),
        X.house_key(F.col("house")).alias("house"),
        "age",
        F.nullif(F.lower(F.trim("gender")), F.lit("")).alias("gender"),
    )


def claimed_slots(records: DataFrame, documents: DataFrame, expectations: DataFrame, newest_first: bool = False) -> DataFrame:
    """The rows of pair_editions of slots that a record claims. A linked record's slot is an expected one, so the slots are not listed for it."""
    scope = _scope(records, documents, expectations).filter("slot_serial is not null")
    order = [F.col("created_at").desc(), F.col("record_id")] if newest_first else [F.col("record_id")]
    key = F.struct(*order) if not newest_first else None
    if key is not None:  # the first by id: one aggregation, no sort
        first = lambda lang: F.min_by(F.struct("record_id", *FIELDS), F.when(F.col("lang") == lang, F.col("record_id")))
        both = scope.groupBy("part_number", "slot_serial").agg(*[a for lang in ("en", "te") for a in (F.count_if(F.col("lang") == lang).alias(f"{lang}_count"), F.when(F.count_if(F.col("lang") == lang) > 0, first(lang)).alias(lang))])
    else:
        rank = F.row_number().over(Window.partitionBy("part_number", "slot_serial", "lang").orderBy(*order))
        ranked = scope.repartition("part_number", "slot_serial").withColumn("_rank", rank)  # one shuffle serves the rank and the group
        pick = lambda lang: F.first(F.when((F.col("lang") == lang) & (F.col("_rank") == 1), F.struct("record_id", *FIELDS)), ignorenulls=True)
        both = ranked.groupBy("part_number", "slot_serial").agg(*[a for lang in ("en", "te") for a in (F.count_if(F.col("lang") == lang).alias(f"{lang}_count"), pick(lang).alias(lang))])
    return _with_evidence(both)


def _with_evidence(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({f"{f}_evidence": X.evidence(F.col(f"en.{f}"), F.col(f"te.{f}")) for f in FIELDS})


def pair_editions(records: DataFrame, documents: DataFrame, expectations: DataFrame, newest_first: bool = False) -> DataFrame:
    """One row per expected slot: counts of both editions, the first record of each and the evidence of each field."""
    both = claimed_slots(records, documents, expectations, newest_first).select("part_number", "slot_serial", "en_count", "te_count", "en", "te")
    slots = expected_slots(expectations).withColumnRenamed("serial_no", "slot_serial")
    joined = slots.join(both, ["part_number", "slot_serial"], "left")
    return _with_evidence(joined.select("part_number", "slot_serial", *[F.coalesce(f"{x}_count", F.lit(0)).alias(f"{x}_count") for x in ("en", "te")], "en", "te"))


def _count(value: str, fields: tuple[str, ...]) -> Column:
    return sum((F.when(F.col(f"{f}_evidence") == value, 1).otherwise(0) for f in fields), F.lit(0))


def status_sql() -> Column:
    """Reconciled needs no conflict and an equal ident or two other equal fields."""
    agreed = (_count("mismatch", FIELDS) == 0) & ((F.col("ident_evidence") == "match") | (_count("match", FIELDS[1:]) >= 2))
    return (
        F.when(F.col("en_count") == 0, "missing_en")
        .when(F.col("te_count") == 0, "missing_te")
        .when((F.col("en_count") > 1) | (F.col("te_count") > 1), "duplicate_source")
        .when(F.col("ident_evidence") == "mismatch", "ident_conflict")
        .when(agreed, "reconciled")
        .otherwise("needs_review")
    )


def status_service() -> Column:
    """Reconciled needs only that nothing conflicts."""
    return (
        F.when((F.col("en_count") > 1) | (F.col("te_count") > 1), "duplicate_source")
        .when((F.col("en_count") == 0) | (F.col("te_count") == 0), "source_missing")
        .when(_count("mismatch", FIELDS) > 0, "needs_review")
        .otherwise("reconciled")
    )


def status_client() -> Column:
    """Unmatched, conflict or verified; only pairs of unique records are linked."""
    agreed = (F.col("ident_evidence") == "match") | (_count("match", FIELDS[1:]) >= 2)
    return (
        F.when((F.col("en_count") != 1) | (F.col("te_count") != 1), "unmatched")
        .when(F.col("ident_evidence") == "mismatch", "conflict")
        .when((_count("mismatch", FIELDS) == 0) & agreed, "verified")
        .otherwise("needs_review")
    )


#: Reasons of the service's results.
SERVICE_REASONS = {
    "duplicate_source": "duplicate language source for the same part and serial",
    "source_missing": "English or Telugu source representation is missing",
    "needs_review": "structured fields of both editions require review",
    "reconciled": "part and serial agree; available structured fields do not conflict",
}


def service_results(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """A row for each slot that some record claims: counts, the ids of unique records, status, field evidence, conflict_fields, safe_to_link and reason.

    Evidence is of slots with one record of each edition, unavailable elsewhere.
    """
    c = F.col
    pairs = claimed_slots(records, documents, expectations).withColumn("status", status_service())
    one = (c("en_count") == 1) & (c("te_count") == 1)
    reason = F.lit(None).cast("string")
    for k, text in SERVICE_REASONS.items():
        reason = F.when(c("status") == k, text).otherwise(reason)
    clash = F.array_compact(F.array(*[F.when(one & (c(f"{f}_evidence") == "mismatch"), f) for f in FIELDS]))
    return pairs.select(
        "part_number",
        "slot_serial",
        "en_count",
        "te_count",
        *[F.when(c(f"{x}_count") == 1, c(f"{x}.record_id")).alias(f"{x}_id") for x in ("en", "te")],
        "status",
        (c("status") == "reconciled").alias("safe_to_link"),
        *[F.when(one, c(f"{f}_evidence")).otherwise("unavailable").alias(f"{f}_evidence") for f in FIELDS],
        clash.alias("conflict_fields"),
        reason.alias("reason"),
    )


def service_batches(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per part: slots evaluated, those in each status, and records that no slot has."""
    c = F.col
    per = service_results(records, documents, expectations).groupBy("part_number").agg(F.count("*").alias("evaluated"), *[F.count_if(c("status") == k).alias(k) for k in SERVICE_REASONS])
    loose = _scope(records, documents, expectations).groupBy("part_number").agg(F.count_if(c("slot_serial").isNull()).alias("unlinked"))
    zero = F.lit(0).cast("long")
    out = expectations.select("part_number").join(per, "part_number", "left").join(loose, "part_number", "left")
    return out.select("part_number", *[F.coalesce(k, zero).alias(k) for k in ("evaluated", *SERVICE_REASONS, "unlinked")])


def edition_links(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """Links of unique English and Telugu records of a slot whose idents don't conflict: ids, evidence, decision (verified, needs_review) and reason."""
    c = F.col
    pairs = claimed_slots(records, documents, expectations).withColumn("decision", status_client()).filter(c("decision").isin("verified", "needs_review"))
    reason = F.when(c("decision") == "verified", "unique identity is corroborated by strong structured fields").otherwise("unique identity matched, but structured corroboration is incomplete or inconsistent")
    return pairs.select("part_number", "slot_serial", c("en.record_id").alias("en_id"), c("te.record_id").alias("te_id"), *[f"{f}_evidence" for f in FIELDS], "decision", reason.alias("reason"))


def edition_conflicts(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """(kind, lang, part_number, slot_serial, n, chunk, record_ids) of what forbids a link.

    duplicate_identity: several records of an edition on one slot, in rows of bounded size; structural_conflict: a record
    without a slot; ident_conflict: unique records whose idents differ (lang is null, both ids).
    """
    c = F.col
    scope = _scope(records, documents, expectations).select("part_number", "lang", "slot_serial", "record_id")
    groups = member_lists(scope.filter("slot_serial is not null"), ["part_number", "lang", "slot_serial"], "record_id").filter("n > 1")
    columns = ["lang", "part_number", "slot_serial", "n", "chunk", "record_ids"]
    double = groups.withColumnRenamed("members", "record_ids").select(F.lit("duplicate_identity").alias("kind"), *columns)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    loose = scope.filter("slot_serial is null").select(F.lit("structural_conflict").alias("kind"), "lang", "part_number", "slot_serial", one.alias("n"), zero.alias("chunk"), F.array("record_id").alias("record_ids"))
    clash = claimed_slots(records, documents, expectations).filter(status_client() == "conflict")
    idents = clash.select(F.lit("ident_conflict").alias("kind"), F.lit(None).cast("string").alias("lang"), "part_number", "slot_serial", (one + 1).alias("n"), zero.alias("chunk"), F.array_sort(F.array("en.record_id", "te.record_id")).alias("record_ids"))
    return double.unionByName(loose).unionByName(idents)


def unmatched_records(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """(lang, record_id) of the editions' records that no link holds."""
    linked = edition_links(records, documents, expectations).select(F.explode(F.array("en_id", "te_id")).alias("record_id"))
    return _scope(records, documents, expectations).select("lang", "record_id").join(linked, "record_id", "left_anti").select("lang", "record_id")


def reconciliation_summary(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """One row per part: documents, records, linked slots and the slots in each status."""
    status = pair_editions(records, documents, expectations).withColumn("status", status_sql())
    counted = status.groupBy("part_number").agg(
        F.count_if((F.col("en_count") > 0) & (F.col("te_count") > 0)).alias("both_present"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("reconciled", "needs_review", "missing_en", "duplicate_source", "ident_conflict")],
        F.count_if(F.col("te_count") == 0).alias("missing_te"),
    )
    docs = documents.filter("active_version and lang in ('en', 'te')").groupBy("part_number").agg(F.count("*").alias("active_documents"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("revision_id"), F.lit("")))), ",").alias("revisions"))
    scope = _scope(records, documents, expectations)
    stats = scope.groupBy("part_number").agg(
        F.count("*").alias("source_records"),
        F.count_if(F.col("slot_serial").isNull()).alias("unlinked_records"),
        *[F.countDistinct(F.when(F.col("lang") == x, F.col("slot_serial"))).alias(f"{x}_linked_slots") for x in ("en", "te")],
    )
    out = expectations.select("part_number", "expected_total").join(counted, "part_number", "left").join(docs, "part_number", "left").join(stats, "part_number", "left")
    numbers = [c for c in out.columns if c not in ("part_number", "expected_total", "revisions")]
    return out.select("part_number", "expected_total", F.coalesce("revisions", F.lit("")).alias("revisions"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def totals(summary: DataFrame) -> DataFrame:
    """Sums of the summary's counts over all parts."""
    return summary.agg(*[F.sum(c).alias(c) for c, t in summary.dtypes if t in ("bigint", "int") and c != "part_number"])


def edition_coverage(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per edition: expected slots, source records, linked slots, unlinked records, slots without one."""
    scope = _scope(records, documents, expectations, ("en", "te", "ur"))
    per = scope.groupBy("lang").agg(F.count("*").alias("source_records"), F.countDistinct(F.when(F.col("slot_serial").isNotNull(), F.struct("part_number", "slot_serial"))).alias("linked_slots"), F.count_if(F.col("slot_serial").isNull()).alias("unlinked_records"))
    total = expectations.agg(F.sum("expected_total").alias("expected_slots"))
    editions = total.withColumn("lang", F.explode(F.array(*map(F.lit, ("en", "te", "ur")))))  # one row a literal edition
    out = editions.join(per, "lang", "left")
    linked = F.coalesce("linked_slots", F.lit(0))
    return out.select("lang", "expected_slots", F.coalesce("source_records", F.lit(0)).alias("source_records"), linked.alias("linked_slots"), F.coalesce("unlinked_records", F.lit(0)).alias("unlinked_records"), F.greatest(F.col("expected_slots") - linked, F.lit(0)).alias("unavailable_slots"))


def part_edition_quality(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """The grid of parts and editions with expected, source, linked, missing and unlinked counts."""
    scope = _scope(records, documents, expectations)
    per = scope.groupBy("part_number", "lang").agg(F.count("*").alias("source_records"), F.countDistinct("slot_serial").alias("linked_slots"), F.count_if(F.col("slot_serial").isNull()).alias("unlinked_records"))
    grid = expectations.select("part_number", "expected_total", F.explode(F.array(F.lit("en"), F.lit("te"))).alias("lang"))
    out = grid.join(per, ["part_number", "lang"], "left")
    linked = F.coalesce("linked_slots", F.lit(0))
    return out.select("part_number", "lang", "expected_total", F.coalesce("source_records", F.lit(0)).alias("source_records"), linked.alias("linked_slots"), F.greatest(F.col("expected_total") - linked, F.lit(0)).alias("missing_slots"), F.coalesce("unlinked_records", F.lit(0)).alias("unlinked_records"))


def serial_completeness(records: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per expected or met serial of a part: occurrences and ok, missing, duplicate or unexpected; cursor is the sort text."""
    n = X.parse_serial(F.col("serial_number"))
    met = records.groupBy("part_number", n.alias("serial_no")).agg(F.count("*").alias("occurrences"), F.min("record_id").alias("first_id"))
    slots = expected_slots(expectations)
    joined = slots.withColumn("_slot", F.lit(True)).join(met.filter("serial_no is not null"), ["part_number", "serial_no"], "full")
    state = F.when(F.col("_slot").isNull(), "unexpected").when(F.col("occurrences").isNull(), "missing").when(F.col("occurrences") > 1, "duplicate").otherwise("ok")
    found = joined.select("part_number", "serial_no", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "first_id", state.alias("state"))
    unread = met.filter("serial_no is null").select("part_number", "serial_no", "occurrences", "first_id", F.lit("unexpected").alias("state"))
    cursor = F.concat_ws(":", F.lpad(F.col("part_number").cast("string"), 8, "0"), F.lpad(F.coalesce(F.col("serial_no").cast("string"), F.lit("~")), 8, "0"))
    return found.unionByName(unread).withColumn("cursor", cursor)


def edition_completeness(records: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per part: counts of missing, duplicate, unexpected and invalid serials and of duplicate idents; complete or not."""
    states = serial_completeness(records, expectations).groupBy("part_number").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("missing", "duplicate")],
        F.count_if((F.col("state") == "unexpected") & F.col("serial_no").isNotNull()).alias("unexpected"),
        F.coalesce(F.sum(F.when(F.col("serial_no").isNull(), F.col("occurrences"))), F.lit(0)).alias("invalid"),
    )
    idents = records.select("part_number", X.ident_key(F.col("ident")).alias("k")).filter("k is not null").groupBy("part_number", "k").agg(F.count("*").alias("n")).filter("n > 1").groupBy("part_number").agg(F.count("*").alias("duplicate_idents"))
    out = states.join(idents, "part_number", "left").withColumn("duplicate_idents", F.coalesce("duplicate_idents", F.lit(0)))
    return out.withColumn("complete", sum((F.col(c) for c in ("missing", "duplicate", "unexpected", "invalid")), F.lit(0)) == 0)


def suspicious_idents(records: DataFrame) -> DataFrame:
    """Idents that one edition carries on several serials of a part."""
    keyed = records.select("part_number", "lang", X.ident_key(F.col("ident")).alias("k"), X.parse_serial(F.col("serial_number")).alias("n")).filter("k is not null and n is not null")
    return keyed.groupBy("part_number", "lang", "k").agg(F.countDistinct("n").alias("serials")).filter("serials > 1").withColumnRenamed("k", "ident")


def evidence_rows(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """Drill-down: a row per slot, newest records first, and a row per record without a slot."""
    slots = pair_editions(records, documents, expectations, newest_first=True).withColumn("status", status_sql())
    linked = slots.select("part_number", F.col("slot_serial").alias("serial_no"), "status", F.col("en.record_id").alias("en_id"), F.col("te.record_id").alias("te_id"), F.lpad(F.col("slot_serial").cast("string"), 8, "0").alias("sort_key"))
    loose = _scope(records, documents, expectations).filter("slot_serial is null")
    pick = lambda lang: F.when(F.col("lang") == lang, F.col("record_id"))
    unlinked = loose.select("part_number", F.lit(None).cast("int").alias("serial_no"), F.lit("unlinked").alias("status"), pick("en").alias("en_id"), pick("te").alias("te_id"), F.concat(F.lit("~"), F.col("record_id")).alias("sort_key"))
    return linked.unionByName(unlinked)


DETAILS = ("record_id", "doc_id", "revision_id", "name", "relation_name", "house", "age", "gender", "ident", "page", "verification_status")
STATUSES = ("reconciled", "needs_review", "missing_en", "missing_te", "duplicate_source", "ident_conflict", "unlinked_source")
LAST_SERIAL = (1 << 31) - 1


def evidence_detail(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """The drill-down with its evidence: a row per slot with the newest record of each edition, and a row per record without a slot.

    row_key, part_number, serial_number, serial_sort, status, verification_status, counts and field evidence, en and te as
    structs of DETAILS, and search_text, which a search looks in. Records are read once.
    """
    c = F.col
    text = F.lower(F.concat_ws(" ", c("part_number").cast("string"), "serial_number", *[c(f"{x}.{f}") for x in ("en", "te") for f in ("name", "relation_name", "house", "ident")]))
    return _detail(records, documents, expectations, DETAILS).withColumn("search_text", text)


def _detail(records: DataFrame, documents: DataFrame, expectations: DataFrame, details: tuple[str, ...]) -> DataFrame:
    """evidence_detail without search_text; en and te have only the given details, so that no others are shuffled. record_id must be one."""
    c = F.col
    docs = small(documents.filter("active_version").select("doc_id", "revision_id"))
    linked = link_records(records.filter(c("lang").isin("en", "te")).join(docs, "doc_id"), expectations)
    keyed = linked.select(
        "part_number",
        "lang",
        "slot_serial",
        "serial_number",
        "created_at",
        F.struct(*details).alias("d"),
        F.struct(F.nullif(F.upper(F.trim("ident")), F.lit("")).alias("ident"), X.house_key(c("house")).alias("house"), "age", F.nullif(F.lower(F.trim("gender")), F.lit("")).alias("gender")).alias("k"),
        F.when(c("slot_serial").isNull(), c("record_id")).alias("loose"),
    )
    # the newest record of each edition, the smallest id of equal ones
    newest = F.struct((-F.unix_micros(c("created_at").cast("timestamp"))).alias("age"), c("d.record_id").alias("id"))
    pick = lambda lang, what: F.when(F.count_if(c("lang") == lang) > 0, F.min_by(what, F.when(c("lang") == lang, newest)))
    grouped = keyed.groupBy("part_number", "slot_serial", "loose").agg(
        *[F.count_if(c("lang") == x).alias(f"{x}_count") for x in ("en", "te")],
        *[pick(x, c("d")).alias(x) for x in ("en", "te")],
        *[pick(x, c("k")).alias(f"_{x}") for x in ("en", "te")],
        F.max("serial_number").alias("_serial"),
    )
    slots = expected_slots(expectations).withColumnRenamed("serial_no", "slot_serial")
    out = slots.withColumn("loose", F.lit(None).cast("string")).withColumn("_slot", F.lit(True))
    same = [out[k].eqNullSafe(grouped[k]) for k in ("part_number", "slot_serial", "loose")]
    mine = [F.coalesce(out[k], grouped[k]).alias(k) for k in ("part_number", "slot_serial", "loose")]
    out = out.join(grouped, same, "full").select(*mine, "_slot", *[F.coalesce(f"{x}_count", F.lit(0)).alias(f"{x}_count") for x in ("en", "te")], "en", "te", "_en", "_te", "_serial")
    loose = c("loose").isNotNull()
    out = out.withColumns({f"{f}_evidence": F.when(loose, "unavailable").otherwise(X.evidence(c(f"_en.{f}"), c(f"_te.{f}"))) for f in FIELDS})
    serial = F.when(loose, c("_serial")).otherwise(c("slot_serial").cast("string"))
    digits = F.when(c("_serial").rlike("^[0-9]+$"), c("_serial").try_cast("int"))
    return out.select(
        F.when(loose, F.concat(F.lit("source:"), "loose")).otherwise(F.concat_ws(":", F.lit("slot"), "part_number", "slot_serial")).alias("row_key"),
        "part_number",
        serial.alias("serial_number"),
        F.when(loose, F.coalesce(digits, F.lit(LAST_SERIAL))).otherwise(c("slot_serial")).alias("serial_sort"),
        F.when(loose, "unlinked_source").otherwise(status_sql()).alias("status"),
        F.coalesce("en.verification_status", "te.verification_status").alias("verification_status"),
        "en_count",
        "te_count",
        *[f"{f}_evidence" for f in FIELDS],
        "en",
        "te",
    )


EVIDENCE_CURSOR = ["part_number", "serial_sort", "row_key"]


def evidence_page(spark: SparkSession, path: str, part: int | None = None, status: str = "all", search: str | None = None, limit: int = 25, after: tuple | None = None) -> DataFrame:
    """A page of evidence_detail as write_paged stored it with facets part_number and status; total_count is over the whole result."""
    if status != "all" and status not in STATUSES:
        raise ValueError(f"unsupported status: {status}")
    where = ({"part_number": part} if part is not None else {}) | ({"status": status} if status != "all" else {})
    text = (search or "").strip().lower()
    return read_page(spark, path, EVIDENCE_CURSOR, limit, after, where, F.contains("search_text", F.lit(text)) if text else None)


SERIAL_CURSOR = ["part_number", "edition", "page_cursor", "chunk"]


def serial_page(spark: SparkSession, path: str, part: int, edition: str | None = None, status: str = "all", limit: int = 50, after: tuple | None = None) -> DataFrame:
    """A page of completeness.serial_rows as write_paged stored it with facets part_number, edition and serial_status.

    No edition means the elected records. after is the last row's page_cursor and chunk; total_count is over the rows behind it.
    """
    if edition is not None and edition not in ("en", "te", "ur"):
        raise ValueError(f"unsupported edition: {edition}")
    if status != "all" and status not in ("ok", "missing", "duplicate", "unexpected"):
        raise ValueError(f"unsupported status: {status}")
    own = (part, edition or "canonical")
    where = dict(zip(SERIAL_CURSOR, own)) | ({"serial_status": status} if status != "all" else {})
    return read_page(spark, path, SERIAL_CURSOR, limit, None if after is None else (*own, *after), where, remaining=True)


def release_gate(records: DataFrame, documents: DataFrame, expectations: DataFrame, issues: DataFrame) -> DataFrame:
    """Per part: what stands against a release, and whether nothing does."""
    s = pair_editions(records, documents, expectations).withColumn("status", status_sql())
    per = s.groupBy("part_number").agg(
        F.count_if((F.col("en_count") == 0) & (F.col("te_count") == 0)).alias("missing_slots"),
        F.count_if(F.col("status") == "duplicate_source").alias("duplicate_slots"),
        F.count_if((F.col("en_count") == 0) != (F.col("te_count") == 0)).alias("incomplete_slots"),
        F.count_if(F.col("status") != "reconciled").alias("unreconciled_slots"),
    )
    open_issues = issues.filter("status = 'open' and severity = 'critical'").join(documents.filter("active_version").select("doc_id", "part_number"), "doc_id").groupBy("part_number").agg(F.count("*").alias("critical_issues"))
    out = per.join(open_issues, "part_number", "left").withColumn("critical_issues", F.coalesce("critical_issues", F.lit(0)))
    against = sum((F.col(c) for c in out.columns if c != "part_number"), F.lit(0))
    return out.withColumn("ready", against == 0)


BLOCKERS = ("missing_slots", "duplicate_slots", "incomplete_slots", "unverified_slots", "unreconciled_slots", "critical_issues")


def release_report(records: DataFrame, documents: DataFrame, expectations: DataFrame, issues: DataFrame) -> DataFrame:
    """Per part: slots that are unique, fully sourced, verified and reconciled, what stands against a release, its codes, and ready.

    A slot is missing without any record, duplicate if an edition has several; the others are unique, and incomplete
    without both editions, unverified unless both records are verified. Open critical issues count where a record of a
    unique slot has them.
    """
    c = F.col
    slots = _detail(records, documents, expectations, ("record_id", "verification_status")).filter(c("status") != "unlinked_source")
    linked = link_records(records.filter(c("lang").isin("en", "te")).join(small(documents.filter("active_version").select("doc_id")), "doc_id"), expectations)
    critical = issues.filter("status = 'open' and severity = 'critical'").join(linked.filter("slot_serial is not null").select("record_id", "part_number", "slot_serial"), "record_id")
    critical = critical.groupBy("part_number", c("slot_serial").alias("serial_sort")).agg(F.count("*").alias("_critical"))
    rows = slots.join(critical, ["part_number", "serial_sort"], "left")
    missing, duplicate = (c("en_count") == 0) & (c("te_count") == 0), (c("en_count") > 1) | (c("te_count") > 1)
    unique = ~missing & ~duplicate
    sourced = c("en").isNotNull() & c("te").isNotNull()
    verified = F.coalesce((c("en.verification_status") == "verified") & (c("te.verification_status") == "verified"), F.lit(False))
    reconciled = c("status") == "reconciled"
    out = rows.groupBy("part_number").agg(
        F.count_if(unique).alias("unique_slots"),
        F.count_if(unique & sourced).alias("sourced_slots"),
        F.count_if(unique & verified).alias("verified_slots"),
        F.count_if(unique & reconciled).alias("reconciled_slots"),
        F.count_if(missing).alias("missing_slots"),
        F.count_if(duplicate).alias("duplicate_slots"),
        F.count_if(unique & ~sourced).alias("incomplete_slots"),
        F.count_if(unique & ~verified).alias("unverified_slots"),
        F.count_if(unique & ~reconciled).alias("unreconciled_slots"),
        F.coalesce(F.sum(F.when(unique, c("_critical"))), F.lit(0)).alias("critical_issues"),
    )
    codes = F.array_compact(F.array(*[F.when(c(k) > 0, k) for k in BLOCKERS]))
    return out.withColumn("blockers", codes).withColumn("ready", F.size("blockers") == 0)
