"""Review queue, issue policy and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcheck.functions import text as X
from rollcheck.operators.registry import small

# fixed values: issue types and kinds, and what their rules are
CRITICAL = (
    "page_failure", "missing_page", "malformed_record", "possible_duplicate", "serial_gap", "page_sequence", "missing_serial", "duplicate_serial", "unexpected_serial", "duplicate_ident",
    "card_count_mismatch", "partial_page", "reconciliation_conflict", "verification_conflict",
)
PAGE_TYPES = ("page_failure", "missing_page", "malformed_record", "page_sequence", "card_count_mismatch", "partial_page")
KINDS_CRITICAL = ("missing_record", "missing_serial", "duplicate_serial", "unexpected_serial", "ident_conflict", "duplicate_identity", "structural_conflict", "failed_page")
KINDS_NEVER = (*KINDS_CRITICAL, "partial_page")
HOUSE_WORDS = "(?i)(photo|not available|elector|gender|age)"
STATUSES = ("all", "open", "resolved", "dismissed")
SEVERITIES = ("all", "critical", "needs_review", "informational")
EDITIONS = ("en", "te", "ur")


def issue_severity(kind: Column) -> Column:
    """Low confidence alone informs; structural and identity issues are critical; all others need review."""
    return F.when(kind == "low_confidence", "informational").when(kind.isin(*CRITICAL), "critical").otherwise("needs_review")


def _doubtful_house() -> Column:
    h = F.col("house")
    return F.col("record_id").isNotNull() & (h.isNull() | (F.trim(h) == "") | (F.length(h) > 40) | ~h.rlike("[0-9]") | h.rlike(HOUSE_WORDS) | F.coalesce(F.col("conf") < 95, F.lit(False)))


#: Predicates over issues with their record's house and conf beside them.
CATEGORIES = {
    "critical": lambda: F.col("severity") == "critical",
    "pages": lambda: F.col("record_id").isNull() | F.col("issue_type").isin(*PAGE_TYPES),
    "records": lambda: F.col("record_id").isNotNull(),
    "low_confidence": lambda: F.col("issue_type") == "low_confidence",
    "serial_gaps": lambda: F.col("issue_type").isin("serial_gap", "missing_serial"),
    "house_number": _doubtful_house,
    "possible_duplicate": lambda: F.col("issue_type").isin("possible_duplicate", "duplicate_serial", "duplicate_ident"),
    "language": lambda: F.col("issue_type").isin("language", "language_incomplete"),
}
#: The earlier queue's categories; severities did not exist then.
CATEGORIES_V1 = CATEGORIES | {
    "critical": lambda: F.col("issue_type").isin("page_failure", "missing_page", "malformed_record", "page_sequence", "possible_duplicate"),
    "pages": lambda: F.col("record_id").isNull() | F.col("issue_type").isin("page_failure", "missing_page", "malformed_record", "page_sequence"),
    "serial_gaps": lambda: F.col("issue_type") == "serial_gap",
    "possible_duplicate": lambda: F.col("issue_type") == "possible_duplicate",
    "language": lambda: F.col("issue_type") == "language",
}


def contains_any(q: str, *columns: str) -> Column:
    """Whether the columns, joined by spaces, hold the text, whatever the case."""
    return F.lower(F.concat_ws(" ", *columns)).contains(q.lower())


def _known(name: str, value: str | None, domain: tuple[str, ...] | dict) -> None:
    if value is not None and value not in domain:
        raise ValueError(f"unsupported {name}: {value}")


def _with_sources(issues: DataFrame, documents: DataFrame, records: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Issues with what their document, record and page say; part and edition are the record's where it has them."""
    d = small(documents.select("doc_id", F.col("part_number").alias("_part"), F.col("lang").alias("_lang"), "filename"))
    r = records.select("record_id", F.col("part_number").alias("_r_part"), F.col("lang").alias("_r_lang"), "serial_number", "name", "relation_type", "relation_name", "house", "age", "gender", "ident", "verification_status", "conf", F.col("page").alias("record_page"))
    out = issues.join(d, "doc_id").join(r, "record_id", "left")
    out = out.withColumns({"part_number": F.coalesce("_r_part", "_part"), "lang": F.coalesce("_r_lang", "_lang")}).drop("_part", "_lang", "_r_part", "_r_lang")
    if pages is not None:
        out = out.join(pages.select("doc_id", "page", F.col("status").alias("page_status"), "printed_page"), ["doc_id", "page"], "left")
    return out


SEARCHED = ("issue_type", "issue_detail", "part_number", "serial_number", "name", "relation_name", "house", "ident", "filename")


def review_queue(
    issues: DataFrame,
    documents: DataFrame,
    records: DataFrame,
    pages: DataFrame | None = None,
    status: str = "open",
    severity: str = "all",
    category: str = "all",
    edition: str | None = None,
    part: int | None = None,
    search: str | None = None,
) -> DataFrame:
    """Issues of active documents with their record's, document's and page's columns; see paging for pages and totals.

    Parameters outside their domains are refused before anything runs.
    """
    _known("status", status, STATUSES)
    _known("severity", severity, SEVERITIES)
    _known("category", category, ("all", *CATEGORIES))
    _known("edition", edition, EDITIONS)
    out = issues if status == "all" else issues.filter(F.col("status") == status)
    out = out if severity == "all" else out.filter(F.col("severity") == severity)
    return _narrowed(_with_sources(out, documents.filter("active_version"), records, pages), CATEGORIES, category, edition, part, search)


def review_queue_v1(issues: DataFrame, documents: DataFrame, records: DataFrame, pages: DataFrame | None = None, status: str = "open", category: str = "all", edition: str | None = None, part: int | None = None) -> DataFrame:
    """The earlier queue: documents of all versions, its own categories, no severity and no search; an unknown category means all."""
    out = issues if status == "all" else issues.filter(F.col("status") == status)
    return _narrowed(_with_sources(out, documents, records, pages), CATEGORIES_V1, category, None if edition == "all" else edition, part, None)


def _narrowed(out: DataFrame, categories: dict, category: str, edition: str | None, part: int | None, search: str | None) -> DataFrame:
    if category in categories:
        out = out.filter(categories[category]())
    if edition is not None:
        out = out.filter(F.col("lang") == edition)
    if part is not None:
        out = out.filter(F.col("part_number") == part)
    return out.filter(contains_any(search.strip(), *SEARCHED)) if search and search.strip() else out


def _agrees(name: str, value: str) -> Column:
    return F.coalesce(F.col(name) == value, F.lit(False))


def classify_issue(facts: DataFrame) -> DataFrame:
    """Severity, manual flag and reason of issue facts, by their kind.

    Facts are kind, identity_agreement (confirmed, unavailable, conflict) and structured_agreement
    (strong, weak, conflict). Low confidence informs only where both agree.
    """
    kind = F.col("kind")
    backed = (kind == "low_ocr_confidence") & _agrees("identity_agreement", "confirmed") & _agrees("structured_agreement", "strong")
    severity = F.when(kind.isin(*KINDS_CRITICAL), "critical").when(backed | (kind == "language_unavailable"), "informational").otherwise("needs_review")
    reason = F.when(kind.isin(*KINDS_CRITICAL), "identity_or_completeness").when(backed, "corroborated").when(kind == "low_ocr_confidence", "not_corroborated").when(kind == "language_unavailable", "availability_only").otherwise("needs_person")
    return facts.withColumn("severity_found", severity).withColumn("manual", severity != "informational").withColumn("reason", reason)


BLOCKERS = ("missing_record", "ident_conflict", "duplicate_identity", "structural_conflict")


def auto_resolution(facts: DataFrame) -> DataFrame:
    """Whether an issue may be resolved without a person, and by which of the two paths.

    Beside classify_issue's facts: has_<blocker> for each blocker, deterministic and values_kept.
    Some kinds and any blocker or conflict never resolve themselves. Low confidence does where identity
    and structure agree; a variance of normal form where the correction is deterministic and the
    identity confirmed. Either keeps the source values.
    """
    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    kept = no("values_kept")
    blocked = _agrees("identity_agreement", "conflict") | _agrees("structured_agreement", "conflict")
    for b in BLOCKERS:
        blocked = blocked | no(f"has_{b}")
    free = ~F.col("kind").isin(*KINDS_NEVER) & ~blocked & kept & _agrees("identity_agreement", "confirmed")
    path = F.when(free & (F.col("kind") == "low_ocr_confidence") & _agrees("structured_agreement", "strong"), "structured_auto_verification").when(free & (F.col("kind") == "normalization_variance") & no("deterministic"), "deterministic_normalization")
    return classify_issue(facts).withColumn("path", path).withColumn("auto", F.col("path").isNotNull())


def resolution_audit(decisions: DataFrame, at: str = "resolved_at") -> DataFrame:
    """An audit row for each issue that resolves itself, with the values before and after; blocked ones give none."""
    return decisions.filter("auto").select("issue_id", F.lit("auto_resolved").alias("action"), "path", "reason", F.col(at).alias("resolved_at"), "original_values", "resulting_values")


CORRECTABLE = ("name", "relation_name", "house", "age", "gender", "ident")
LONGEST_REASON = 500


def apply_corrections(records: DataFrame, issues: DataFrame, corrections: DataFrame) -> dict[str, DataFrame]:
    """Corrections of open record issues; originals stay beside the corrected values.

    corrections: correction_id, issue_id, values (map of field to text; null text keeps the original),
    reason, verify, at. A correction is refused whole where its issue is unknown, closed or has no known record, where
    the reason is blank or over 500 characters, or where it names another field. The latest one of a record
    stands (by at, then correction_id). With verify, record and issue are verified and resolved.

    Returns records, issues, rejected (with why) and audit rows.
    """
    c = F.col
    known = records.select("record_id", F.lit(True).alias("_record"))
    open_ = issues.select("issue_id", "record_id", F.col("status").alias("_status")).join(known, "record_id", "left")
    reason = F.trim(F.coalesce("reason", F.lit("")))
    why = (
        F.when(c("values").isNull(), "values_missing")
        .when(reason == "", "reason_missing")
        .when(F.length("reason") > LONGEST_REASON, "reason_too_long")
        .when(F.exists(F.map_keys("values"), lambda k: ~k.isin(*CORRECTABLE)), "unknown_field")
        .when(c("_status").isNull(), "unknown_issue")
        .when(c("_status") != "open", "issue_not_open")
        .when(c("record_id").isNull(), "no_record")
        .when(c("_record").isNull(), "unknown_record")
    )
    judged = corrections.join(open_, "issue_id", "left").withColumn("rejected", why).drop("_record", "_status")
    good = judged.filter("rejected is null").withColumn("verify", F.coalesce("verify", F.lit(False)))
    order = F.struct("at", "correction_id")
    last = good.groupBy("record_id").agg(F.max_by("values", order).alias("_values"), F.max("verify").alias("_verify"))
    joined = records.join(last, "record_id", "left")
    done = joined.withColumns({f"original_{f}": c(f) for f in CORRECTABLE} | {f: X.effective(c(f), c("_values")[f], f == "age") for f in CORRECTABLE} | {"verification_status": F.when(c("_verify"), "verified").otherwise(c("verification_status"))}).drop("_values", "_verify")
    by_issue = good.groupBy("issue_id").agg(F.max("verify").alias("_verify"), F.max_by(reason, order).alias("_reason"))
    kind = F.when(c("_verify"), "human_verified").when(c("_verify").isNotNull(), "human_correction")
    closed = issues.join(by_issue, "issue_id", "left").withColumns({"status": F.when(c("_verify"), "resolved").otherwise(c("status")), "resolution_type": kind, "resolution_reason": c("_reason")}).drop("_verify", "_reason")
    audit = good.select("correction_id", "issue_id", "record_id", F.when(c("verify"), "review_corrected_and_verified").otherwise("review_correction_saved").alias("action"), reason.alias("reason"), "values", "at")
    return {"records": done, "issues": closed, "rejected": judged.filter("rejected is not null"), "audit": audit}


def apply_verifications(records: DataFrame, issues: DataFrame, verified: DataFrame) -> dict[str, DataFrame]:
    """verified (issue_id): open issues of known records; the unchanged record is verified and that issue resolved."""
    hit = issues.filter("status = 'open'").join(verified.select("issue_id").distinct(), "issue_id", "left_semi").join(records.select("record_id"), "record_id", "left_semi").select("issue_id", "record_id")
    people, closed = hit.select("record_id", F.lit(True).alias("_v")).distinct(), hit.select("issue_id", F.lit(True).alias("_v"))
    return {
        "records": records.join(people, "record_id", "left").withColumn("verification_status", F.when(F.col("_v"), "verified").otherwise(F.col("verification_status"))).drop("_v"),
        "issues": issues.join(closed, "issue_id", "left").withColumn("status", F.when(F.col("_v"), "resolved").otherwise(F.col("status"))).drop("_v"),
    }


def auto_resolve_reprocessed(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds new_status: open page failures and malformed records of pages that are processed now become resolved."""
    clean = pages.filter("status = 'processed'").select("doc_id", "page", F.lit(True).alias("_clean"))
    joined = issues.join(clean, ["doc_id", "page"], "left")
    hit = (F.col("status") == "open") & F.col("issue_type").isin("page_failure", "malformed_record") & F.col("_clean").isNotNull()
    return joined.withColumn("new_status", F.when(hit, "resolved").otherwise(F.col("status"))).drop("_clean")


def new_issues(found: DataFrame, issues: DataFrame) -> DataFrame:
    """Found issues without an identical open one."""
    keys = ["doc_id", "issue_type", "issue_detail"]
    return found.join(issues.filter("status = 'open'").select(*keys), keys, "left_anti")


def latest_per_document(issues: DataFrame) -> DataFrame:
    """The newest issue of each document; ties go to the larger id."""
    w = Window.partitionBy("doc_id").orderBy(F.col("created_at").desc(), F.col("issue_id").desc())
    return issues.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def needs_attention(records: DataFrame) -> DataFrame:
    """Records for review or under 95 percent confidence, by part and page."""
    return records.filter((F.col("verification_status") == "requires_review") | (F.col("conf") < 95)).orderBy("part_number", F.col("page").asc_nulls_last(), "record_id")
