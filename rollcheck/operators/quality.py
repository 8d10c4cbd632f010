"""Quality summaries, integrity checks and demographic aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcheck.functions import text as X
from rollcheck.operators.completeness import member_lists
from rollcheck.operators.registry import active_records, link_records, small


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


FIELDS = ("name", "relation", "house", "age", "ident")


def quality_summary(records: DataFrame, documents: DataFrame, expectations: DataFrame, pages: DataFrame, issues: DataFrame, part: int | None = None, edition: str | None = None) -> DataFrame:
    """One row of 23 counts for all parts or one, all editions or one.

    Serial figures are over the slots' canonical records where no edition is given, over the edition's
    source records where one is. Records are read and linked once, grouped by slot for both.
    """
    if edition is not None and edition not in ("en", "te", "ur"):
        raise ValueError(f"unsupported edition: {edition}")
    live = documents.filter("active_version").select("doc_id", "part_number", F.col("lang").alias("_edition"))
    if part is not None:
        live, expectations, records = live.filter(F.col("part_number") == part), expectations.filter(F.col("part_number") == part), records.filter(F.col("part_number") == part)
    linked = link_records(records.join(small(live.select("doc_id", "_edition")), "doc_id"), expectations)
    mine = F.lit(True) if edition is None else F.col("_edition") == edition
    source = linked.filter(mine)
    live = live if edition is None else live.filter(F.col("_edition") == edition)
    slots = expectations.agg(F.coalesce(F.sum("expected_total"), F.lit(0)).cast("long").alias("expected_slots"), F.coalesce(F.sum(F.col("serial_end") - F.col("serial_start") + 1), F.lit(0)).cast("long").alias("active_slots"))
    own = (F.col("lang") == "en") & F.col("slot_serial").isNotNull()
    # one group a serial: its records, those of the edition, and its only English record's state
    serials = linked.groupBy("part_number", X.parse_serial(F.col("serial_number")).alias("n")).agg(
        F.count_if(mine).alias("mine"),
        F.count_if(mine & F.col("slot_serial").isNotNull()).alias("met"),
        F.count_if(own).alias("own"),
        F.max(F.when(own, F.col("verification_status"))).alias("state"),
    )
    alone = F.col("own") == 1
    figures = serials.agg(
        F.count_if(alone).alias("canonical"),
        F.count_if(alone & (F.col("state") == "verified")).alias("verified_slots"),
        F.count_if(F.col("met") > 0).alias("met"),
        F.count_if((F.col("mine") > 1) & F.col("n").isNotNull()).alias("twice"),
        F.coalesce(F.sum(F.col("mine") - F.col("met")), F.lit(0)).alias("outside"),
    )
    serial = slots.crossJoin(figures).select(
        "expected_slots",
        "active_slots",
        (F.col("active_slots") - (F.col("canonical") if edition is None else F.col("met"))).alias("missing_serials"),
        (F.lit(0).cast("long") if edition is None else F.col("twice")).alias("duplicate_serial_groups"),
        (F.lit(0).cast("long") if edition is None else F.col("outside")).alias("unexpected_serials"),
        "verified_slots",
        (F.col("active_slots") - F.col("verified_slots")).alias("unverified_slots"),
    )
    names = {"name": "name", "relation": "relation_name", "house": "house", "age": "age", "ident": "ident"}
    counted = source.agg(
        F.count("*").alias("source_records"),
        F.count_if(F.col("slot_serial").isNotNull()).alias("linked_records"),
        F.count_if(F.col("slot_serial").isNull()).alias("reconciliation_conflicts"),
        *[F.count_if(_blank(names[f])).alias(f"null_{f}") for f in FIELDS],
    )
    key = F.upper(F.trim("ident"))
    who = F.when(F.col("slot_serial").isNull(), F.concat(F.lit("source:"), F.col("record_id"))).otherwise(F.concat_ws(":", F.col("part_number"), F.col("slot_serial")))
    idents = source.filter(key != "").groupBy(key.alias("k")).agg(F.min(who).alias("x"), F.max(who).alias("y")).agg(F.count_if(F.col("x") < F.col("y")).alias("duplicate_ident_groups"))
    page = pages.join(small(live.select("doc_id")), "doc_id").agg(
        F.coalesce(F.sum("records_detected"), F.lit(0)).alias("expected_cards"),
        F.coalesce(F.sum("records_extracted"), F.lit(0)).alias("extracted_cards"),
        F.count_if(F.col("status").isin("failed", "requires_review") | F.col("error_type").isNotNull()).alias("failed_pages"),
        F.count_if(F.col("records_detected") > F.col("records_extracted")).alias("partial_pages"),
    )
    issue = issues.filter("status = 'open'").join(small(live.select("doc_id")), "doc_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in ("critical", "needs_review", "informational")])
    for one in (counted, idents, page, issue):  # each is one row
        serial = serial.crossJoin(one)
    return serial


def quality_analytics(summary: DataFrame) -> DataFrame:
    """Coverage, issue shares, rates of missing fields and the ordered blocker codes of a summary row."""
    c = F.col
    issues = c("critical_issues") + c("needs_review_issues") + c("informational_issues")
    blockers = F.array_compact(
        F.array(
            F.when(c("missing_serials") > 0, "missing_serials"),
            F.when(c("duplicate_serial_groups") > 0, "duplicate_serials"),
            F.when(c("unexpected_serials") > 0, "unexpected_serials"),
            F.when(c("duplicate_ident_groups") > 0, "duplicate_idents"),
            F.when(c("failed_pages") > 0, "failed_pages"),
            F.when(c("critical_issues") > 0, "critical_issues"),
        )
    )
    return summary.select(
        X.percent(c("linked_records"), c("source_records")).alias("linked_pct"),
        X.percent(c("extracted_cards"), c("expected_cards")).alias("extracted_pct"),
        *[X.percent(c(f"{s}_issues"), issues).alias(f"{s}_pct") for s in ("critical", "needs_review", "informational")],
        *[X.percent(c(f"null_{f}"), c("source_records")).alias(f"missing_{f}_pct") for f in FIELDS],
        F.array_join(blockers, ",").alias("blockers"),
    )


def document_integrity(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored against declared records of each document."""
    stored = records.groupBy("doc_id").agg(F.count("*").alias("stored"))
    declared = pages.groupBy("doc_id").agg(F.sum("records_extracted").alias("declared"))
    out = declared.join(stored, "doc_id", "full")
    return out.select("doc_id", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("declared", F.lit(0)).alias("declared")).withColumn("agrees", F.col("stored") == F.col("declared"))


def duplicate_marking(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(record_id, probable_duplicate): within a document an equal ident, or equal name, relation's name, house and age.

    The second needs a name and a house; all are compared in normal form.
    """
    name, house = X.norm_text(F.col("name"), ascii_only), X.norm_house(F.col("house"), ascii_only)
    person = F.when((name != "") & (house != ""), F.concat_ws("|", name, X.norm_text(F.col("relation_name"), ascii_only), house, F.coalesce(F.col("age").cast("string"), F.lit(""))))
    keyed = records.select("record_id", "doc_id", F.nullif("ident", F.lit("")).alias("i"), person.alias("p"))
    # only what occurs several times is joined back
    by_ident = keyed.filter("i is not null").groupBy("doc_id", "i").agg(F.count("*").alias("n_i")).filter("n_i > 1")
    by_person = keyed.filter("p is not null").groupBy("doc_id", "p").agg(F.count("*").alias("n_p")).filter("n_p > 1")
    joined = keyed.join(by_ident, ["doc_id", "i"], "left").join(by_person, ["doc_id", "p"], "left")
    return joined.select("record_id", (F.col("n_i").isNotNull() | F.col("n_p").isNotNull()).alias("probable_duplicate"))


def serial_gaps(records: DataFrame) -> DataFrame:
    """Gaps between the sorted serials of a document as (doc_id, gap_from, gap_to, gap)."""
    n = records.select("doc_id", X.parse_serial(F.col("serial_number")).alias("n")).filter("n is not null").distinct()
    before = F.lag("n").over(Window.partitionBy("doc_id").orderBy("n"))
    gaps = n.withColumn("before", before).filter("n - before > 1")
    low, high = F.col("before") + 1, F.col("n") - 1
    return gaps.select("doc_id", low.alias("gap_from"), high.alias("gap_to"), F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high)).alias("gap"))


def serial_gap_issues(records: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(doc_id, issue_type, issue_detail, status): an open serial_gap issue for each gap, those that are open already left out."""
    gaps = serial_gaps(records)
    text = F.concat(F.lit("Possible missing/unreadable serial "), F.col("gap_from"), F.when(F.col("gap_to") > F.col("gap_from"), F.concat(F.lit("–"), "gap_to")).otherwise(""))
    rows = gaps.select("doc_id", F.lit("serial_gap").alias("issue_type"), text.alias("issue_detail"), F.lit("open").alias("status"))
    if issues is None:
        return rows
    return rows.join(issues.filter("issue_type = 'serial_gap' and status = 'open'").select("doc_id", "issue_detail"), ["doc_id", "issue_detail"], "left_anti").select(*rows.columns)


def page_sequence(pages: DataFrame) -> DataFrame:
    """Pages whose printed number skips or falls behind the largest so far."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    seen = pages.withColumn("so_far", F.max("printed_page").over(w))
    kind = F.when(F.col("printed_page") > F.col("so_far") + 1, "missing_page").when(F.col("printed_page") <= F.col("so_far"), "out_of_order")
    return seen.withColumn("issue", kind).filter("issue is not null").select("doc_id", "page", "printed_page", "so_far", "issue")


def document_rollup(documents: DataFrame, pages: DataFrame, records: DataFrame, issues: DataFrame) -> DataFrame:
    """Per document: pages processed and for review, records, voted edition, and the document's state.

    Interrupted if a page's persistence failed; with warnings if a page or record needs review, a
    serial issue (issues: doc_id, one row each) stands, or the records differ from the expected total.
    """
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0).cast("long"))
    per = pages.groupBy("doc_id").agg(F.count_if(c("status").isin("processed", "requires_review")).alias("processed_pages"), F.count_if(c("status") == "requires_review").alias("review_pages"), F.count_if(c("error_type") == "page_persistence_failed").alias("lost_pages"))
    held = records.groupBy("doc_id").agg(F.count("*").alias("records"), F.count_if(c("verification_status") == "requires_review").alias("review_records"))
    open_ = issues.groupBy("doc_id").agg(F.count("*").alias("serial_issues"))
    out = documents.select("doc_id", "expected_total").join(per, "doc_id", "left").join(held, "doc_id", "left").join(open_, "doc_id", "left").join(edition_vote(pages, documents).select("doc_id", "lang"), "doc_id")
    out = out.select("doc_id", "lang", "expected_total", *[zero(n).alias(n) for n in ("processed_pages", "review_pages", "lost_pages", "records", "review_records", "serial_issues")])
    differs = F.coalesce(c("records") != c("expected_total"), F.lit(False))
    warned = (c("review_pages") > 0) | (c("review_records") > 0) | (c("serial_issues") > 0) | differs
    return out.withColumn("state", F.when(c("lost_pages") > 0, "interrupted").when(warned, "completed_with_warnings").otherwise("completed"))


def page_integrity(pages: DataFrame, documents: DataFrame, runs: DataFrame | None = None, most: int = 30) -> DataFrame:
    """Violations of page rules, the first that holds.

    Unknown document, page outside 1 .. pages, a run (run_id) of another document, more records detected
    than a page holds, more extracted than detected, more for review than extracted.
    """
    c = F.col
    known = pages.join(small(documents.select("doc_id", F.col("pages").alias("_pages"))), "doc_id", "left")
    reason = F.when(c("_pages").isNull(), "unknown_document").when(~c("page").between(1, c("_pages")), "page_outside_document")
    if runs is not None:
        known = known.join(runs.select("run_id", c("doc_id").alias("_run_doc")), "run_id", "left")
        reason = reason.when(c("run_id").isNotNull() & ~c("doc_id").eqNullSafe(c("_run_doc")), "run_of_other_document")
    reason = reason.when(~c("records_detected").between(0, most), "too_many_records").when(~c("records_extracted").between(0, c("records_detected")), "extracted_over_detected").when(~c("records_review").between(0, c("records_extracted")), "review_over_extracted")
    return known.withColumn("violation", reason).filter("violation is not null").select("doc_id", "page", "violation")


def edition_vote(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, lang, votes): the language most pages were found in, on ties the one met first; else the declared edition."""
    n = pages.filter("detected_language is not null").groupBy("doc_id", "detected_language").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    best = n.groupBy("doc_id").agg(F.max_by("detected_language", F.struct("n", -F.col("first"))).alias("_voted"), F.max("n").alias("_votes"))
    return documents.select("doc_id", F.col("lang").alias("_declared")).join(best, "doc_id", "left").select("doc_id", F.coalesce("_voted", "_declared").alias("lang"), F.coalesce("_votes", F.lit(0).cast("long")).alias("votes"))


AGES = ("18_25", "26_35", "36_45", "46_60", "61_75", "76_plus", "unknown_invalid")
HOUSES = ("1", "2", "3_4", "5_6", "7_plus")


def canonical_rows(records: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """First English record of each slot with its normalised attributes."""
    linked = link_records(active_records(records, documents), expectations).filter("slot_serial is not null and lang = 'en'")
    first = linked.groupBy("part_number", "slot_serial").agg(F.min_by(F.struct("record_id", "age", "gender", "house", "ident"), "record_id").alias("r"))
    valid = F.when(F.col("r.age").between(18, 125), F.col("r.age"))
    return first.select("part_number", "slot_serial", "r.record_id", "r.age", valid.alias("valid_age"), X.age_group(F.col("r.age")).alias("age_group"), X.gender_group(F.col("r.gender")).alias("gender_group"), X.house_key(F.col("r.house")).alias("house_key"), X.ident_key(F.col("r.ident")).alias("ident_key"))


GENDERS = ("male", "female", "other_unknown")


def check_demographics(part: int | None, gender: str | None, age: str | None, expectations: DataFrame | None = None) -> None:
    """ValueError for a gender filter or age group that is none, and for a part without an expectation where those are given."""
    if gender is not None and gender not in GENDERS:
        raise ValueError(f"unsupported gender filter: {gender}")
    if age is not None and age not in AGES:
        raise ValueError(f"unsupported age group: {age}")
    if part is not None and expectations is not None and expectations.filter(F.col("part_number") == part).isEmpty():
        raise ValueError(f"unsupported part: {part}")


def demographic_filter(rows: DataFrame, part: int | None = None, gender: str | None = None, age: str | None = None) -> DataFrame:
    """Only the given filters; other_unknown takes both groups. Values that are no filter raise ValueError."""
    check_demographics(part, gender, age)
    if part is not None:
        rows = rows.filter(F.col("part_number") == part)
    if gender is not None:
        rows = rows.filter(F.col("gender_group").isin("other", "unknown") if gender == "other_unknown" else F.col("gender_group") == gender)
    return rows if age is None else rows.filter(F.col("age_group") == age)


def insights(rows: DataFrame) -> DataFrame:
    """Scalars over canonical rows in one aggregate, and house and ident figures from grouped counts."""
    people = rows.agg(
        F.count("*").alias("voters"),
        *[F.count_if(F.col("gender_group") == g).alias(g) for g in ("male", "female", "other", "unknown")],
        F.count("valid_age").alias("valid_ages"),
        F.round(F.avg(F.col("valid_age").cast("decimal(18,4)")), 1).cast("double").alias("mean_age"),
        F.median("valid_age").alias("median_age"),
        F.min("valid_age").alias("youngest"),
        F.max("valid_age").alias("oldest"),
    )
    houses = house_sizes(rows).agg(F.count("*").alias("houses"), F.max("members").alias("largest_house"), F.round(F.avg(F.col("members").cast("decimal(18,4)")), 1).cast("double").alias("mean_house"))
    idents = rows.filter("ident_key is not null").groupBy("ident_key").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicate_idents"))
    return people.crossJoin(houses).crossJoin(idents)  # one row each


#: Labels of the age groups and house sizes of a report.
AGE_LABELS = ("18–25", "26–35", "36–45", "46–60", "61–75", "76+", "Unknown / invalid")
HOUSE_KEYS = {"one": "1 voter", "two": "2 voters", "three_four": "3–4 voters", "five_six": "5–6 voters", "seven_plus": "7+ voters"}


def insights_report(records: DataFrame, documents: DataFrame, expectations: DataFrame, issues: DataFrame, part: int | None = None, gender: str | None = None, age: str | None = None) -> DataFrame:
    """One row: 33 figures and three arrays (parts, age_groups, house_groups) over the canonical records that pass the filters.

    Canonical is a slot's first English record, whose verification is the slot's. A slot needs review if it is not
    verified and its record is marked for it or some record of the slot has an open issue. Serial figures and missing
    slots look at all records of the part, whatever the other filters. Records are read once: they are grouped by slot,
    and the slots, with a row for each part's expectation, by part, house, ident and age in one grouping-sets
    aggregate, from whose rows every figure comes. Ages in years are few, so the median comes from their counts.
    """
    check_demographics(part, gender, age, expectations)
    c = F.col
    if part is not None:
        records, expectations = records.filter(c("part_number") == part), expectations.filter(c("part_number") == part)
    open_ = issues.filter("status = 'open'").groupBy("record_id").agg(F.count_if(c("severity") == "critical").alias("_critical"))
    known = active_records(records, documents).join(small(expectations.select("part_number")), "part_number")
    rows = link_records(known, expectations).join(open_, "record_id", "left")
    english = c("lang") == "en"
    first = F.min_by(F.struct("age", "gender", "house", "ident", c("verification_status").alias("status")), F.when(english, c("record_id")))
    slots = rows.groupBy("part_number", "slot_serial").agg(
        F.count_if(english).alias("en"),
        F.count_if(c("lang") == "te").alias("te"),
        (F.count("_critical") > 0).alias("open_issue"),
        F.coalesce(F.sum("_critical"), F.lit(0)).alias("critical"),
        F.when((F.count_if(english) > 0) & c("slot_serial").isNotNull(), first).alias("r"),
    )
    held = c("r").isNotNull()
    people = slots.select(
        "part_number",
        "slot_serial",
        "en",
        "te",
        "open_issue",
        "critical",
        held.alias("held"),
        c("r.age").alias("age"),
        c("r.status").alias("status"),
        X.age_group(c("r.age")).alias("age_group"),
        X.gender_group(c("r.gender")).alias("gender_group"),
        X.house_key(c("r.house")).alias("house_key"),
        X.ident_spaceless(c("r.ident")).alias("ident_key"),
    )
    keep = c("held")
    if gender is not None:
        keep = keep & (c("gender_group").isin("other", "unknown") if gender == "other_unknown" else c("gender_group") == gender)
    if age is not None:
        keep = keep & (c("age_group") == age)
    valid = F.when(c("age").between(18, 125), c("age"))
    review = (c("status") == "requires_review") | c("open_issue")
    verified = c("status") == "verified"
    linked = c("slot_serial").isNotNull()
    ones = {
        "n": keep,
        **{g: keep & (c("gender_group") == g) for g in ("male", "female", "other", "unknown")},
        "valid_n": keep & valid.isNotNull(),
        "no_age": keep & c("age").isNull(),
        "verified": keep & verified,
        "review": keep & ~verified & review,
        "no_house": keep & c("house_key").isNull(),
        "no_ident": keep & c("ident_key").isNull(),
    }
    n = lambda condition: F.when(condition, 1).otherwise(0).cast("long")
    people = people.select(
        "part_number",
        F.when(keep, c("house_key")).alias("house_key"),
        F.when(keep, c("ident_key")).alias("ident_key"),
        F.when(keep, valid).alias("valid_age"),
        F.when(keep, valid).alias("years"),
        *[n(F.coalesce(x, F.lit(False))).alias(k) for k, x in ones.items()],
        F.when(keep, c("critical")).otherwise(0).alias("critical"),
        n(c("held")).alias("held"),
        F.when(linked, 0).otherwise(c("en") + c("te")).alias("unexpected"),
        F.when(linked, n(c("en") > 1) + n(c("te") > 1)).otherwise(0).alias("repeated"),
    )
    sums = [*ones, "critical", "held", "unexpected", "repeated"]
    zero = F.lit(0).cast("long")
    nulls = {"house_key": "string", "ident_key": "string", "valid_age": "int", "years": "int"}
    wanted = expectations.select(
        "part_number",
        *[F.lit(None).cast(t).alias(k) for k, t in nulls.items()],
        *[zero.alias(k) for k in sums],
        c("expected_total").cast("long").alias("expected"),
        (c("serial_end") - c("serial_start") + 1).cast("long").alias("slots"),
    )
    both = people.withColumns({"expected": zero, "slots": zero}).unionByName(wanted)
    keys = ["part_number", "house_key", "ident_key", "valid_age"]
    sets = both.groupingSets([[c("part_number")], [c("part_number"), c("house_key")], [c("ident_key")], [c("valid_age")]], *keys)
    grains = sets.agg(F.grouping_id().alias("_set"), *[F.sum(k).alias(k) for k in [*sums, "expected", "slots"]], F.sum("years").alias("age_sum"), F.min("years").alias("youngest"), F.max("years").alias("oldest"))
    by_part, by_house, by_ident, by_age = (c("_set") == k for k in (0b0111, 0b0011, 0b1101, 0b1110))
    in_house, of_age = by_house & c("house_key").isNotNull(), by_age & c("valid_age").isNotNull()
    of = lambda k: F.sum(F.when(by_part, c(k)))
    sizes = {"house_groups": (1, 1 << 62), "single": (1, 1), "two": (2, 2), "three_four": (3, 4), "five_six": (5, 6), "seven_plus": (7, 1 << 62)}
    # one row a part, and one without a part that holds the figures by ident and age
    parts = grains.groupBy("part_number").agg(
        *[of(k).alias(k) for k in [*sums, "expected", "slots", "age_sum"]],
        *[f(F.when(by_part, c(k))).alias(k) for f, k in ((F.min, "youngest"), (F.max, "oldest"))],
        *[F.count_if(in_house & c("n").between(*size)).alias(k) for k, size in sizes.items()],
        F.max(F.when(in_house, c("n"))).alias("largest"),
        F.sum(F.when(in_house, c("n"))).alias("housed"),
        F.count_if(by_ident & c("ident_key").isNotNull() & (c("n") > 1)).alias("shared_idents"),
        F.percentile(F.when(of_age, c("valid_age")), 0.5, F.when(of_age, c("n")).otherwise(zero)).alias("median"),
        *[F.sum(F.when(of_age & (X.age_group(c("valid_age")) == a), c("n"))).alias(f"_{a}") for a in AGES[:-1]],
    )
    mean = lambda whole, count: F.round(whole.cast("decimal(28,6)") / F.nullif(count, zero), 1).cast("double")
    row = F.struct(
        c("part_number").alias("part"),
        "expected",
        c("n").alias("available"),
        "male",
        "female",
        (c("other") + c("unknown")).alias("other_unknown"),
        mean(c("age_sum"), c("valid_n")).alias("average_age"),
        c("youngest").alias("youngest_age"),
        c("oldest").alias("oldest_age"),
        "house_groups",
        "verified",
        c("review").alias("needs_review"),
    )
    total = lambda k: F.coalesce(F.sum(k), zero)
    out = parts.agg(
        total("expected").alias("expected_total"),
        total("n").alias("available_total"),
        *[total(g).alias(f"{g}_total") for g in ("male", "female", "other")],
        total("unknown").alias("unknown_gender_total"),
        total("valid_n").alias("valid_age_count"),
        total("no_age").alias("missing_age_count"),
        (total("n") - total("valid_n") - total("no_age")).alias("invalid_age_count"),
        mean(F.sum("age_sum"), total("valid_n")).alias("average_age"),
        F.round(F.max("median"), 1).alias("median_age"),
        F.min("youngest").alias("youngest_age"),
        F.max("oldest").alias("oldest_age"),
        total("house_groups").alias("house_group_count"),
        *[total(k).alias(f"{k}_house_groups") for k in list(sizes)[1:]],
        F.coalesce(F.max("largest"), zero).alias("largest_house_group"),
        mean(F.sum("housed"), total("house_groups")).alias("average_voters_per_house"),
        total("verified").alias("verified_total"),
        total("review").alias("needs_review_total"),
        (total("n") - total("verified") - total("review")).alias("unverified_total"),
        total("critical").alias("critical_issue_count"),
        total("shared_idents").alias("duplicate_ident_groups"),
        total("unknown").alias("missing_gender_count"),
        total("no_house").alias("missing_house_count"),
        total("no_ident").alias("missing_ident_count"),
        (total("slots") - total("held")).alias("missing_serial_count"),
        total("unexpected").alias("unexpected_serial_count"),
        total("repeated").alias("duplicate_part_serial_groups"),
        F.array_sort(F.collect_list(F.when(c("part_number").isNotNull(), row))).alias("parts"),
        *[total(f"_{a}").alias(f"_{a}") for a in AGES[:-1]],
    )
    ages = [c(f"_{a}") for a in AGES[:-1]] + [c("available_total") - c("valid_age_count")]
    counts = [c(f"{k}_house_groups") for k in list(sizes)[1:]]
    label = lambda key, name, count: F.struct(F.lit(key).alias("key"), F.lit(name).alias("label"), count.alias("count"))
    out = out.withColumn("age_groups", F.array(*[label(a, name, x) for a, name, x in zip(AGES, AGE_LABELS, ages)]))
    out = out.withColumn("house_groups", F.array(*[label(k, name, x) for (k, name), x in zip(HOUSE_KEYS.items(), counts)]))
    return out.withColumn("revision_count", F.lit(1).cast("long")).drop(*[f"_{a}" for a in AGES[:-1]])


def age_histogram(rows: DataFrame) -> DataFrame:
    """Every age group, empty ones too."""
    labels = rows.sparkSession.createDataFrame([(a,) for a in AGES], "age_group string")
    n = rows.groupBy("age_group").agg(F.count("*").alias("n"))
    return F.broadcast(labels).join(n, "age_group", "left").select("age_group", F.coalesce("n", F.lit(0)).alias("n"))


def house_sizes(rows: DataFrame) -> DataFrame:
    return rows.filter("house_key is not null").groupBy("part_number", "house_key").agg(F.count("*").alias("members"))


def house_histogram(rows: DataFrame) -> DataFrame:
    m = F.col("members")
    label = F.when(m == 1, "1").when(m == 2, "2").when(m <= 4, "3_4").when(m <= 6, "5_6").otherwise("7_plus")
    labels = rows.sparkSession.createDataFrame([(a,) for a in HOUSES], "house_size string")
    n = house_sizes(rows).groupBy(label.alias("house_size")).agg(F.count("*").alias("n"))
    return F.broadcast(labels).join(n, "house_size", "left").select("house_size", F.coalesce("n", F.lit(0)).alias("n"))


def part_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part_number").agg(F.count("*").alias("voters"), *[F.count_if(F.col("gender_group") == g).alias(g) for g in ("male", "female")], F.countDistinct("house_key").alias("houses"))


def house_groups(rows: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` houses in number-aware order with their members by gender; the limit is the report's."""
    g = rows.filter("house_key is not null").groupBy("house_key").agg(F.count("*").alias("members"), F.count_if(F.col("gender_group") == "male").alias("men"), F.count_if(F.col("gender_group") == "female").alias("women"))
    return g.orderBy(F.col("house_key").try_cast("int").asc_nulls_last(), "house_key").limit(most)


def house_group_lists(rows: DataFrame, most: int = 200) -> DataFrame:
    """The groups of house_groups with who is in them: house_key, men, women, representative (the smallest id), n, chunk, members.

    A huge house goes on in further rows, see completeness.member_lists.
    """
    groups = house_groups(rows, most).drop("members")
    mine = rows.join(F.broadcast(groups.select("house_key")), "house_key", "left_semi")  # `most` keys
    first = mine.groupBy("house_key").agg(F.min("record_id").alias("representative"))
    return member_lists(mine, ["house_key"], "record_id").join(first, "house_key").join(F.broadcast(groups), "house_key").select("house_key", "men", "women", "representative", "n", "chunk", "members")


def has_comparable_revision(documents: DataFrame) -> DataFrame:
    return documents.agg((F.countDistinct("revision_id") > 1).alias("comparable"), F.countDistinct("revision_id").alias("revisions"))


def dashboard_counts(records: DataFrame) -> DataFrame:
    """Older age bands with genders, over all records."""
    return records.groupBy(X.age_band(F.col("age")).alias("age_band")).agg(F.count("*").alias("records"), F.count_if(F.lower(F.trim("gender")).startswith("m")).alias("m"), F.count_if(F.lower(F.trim("gender")).startswith("f")).alias("f"))


BANDS = ("18-25", "26-35", "36-50", "51-65", "66+", "missing")


def dashboard_totals(records: DataFrame) -> DataFrame:
    """The older dashboard's figures in one pass: a row for all records (part_number null) and one for each part.

    records, men, women, others and missing by gender prefix, the six age bands, verified, for review, and houses,
    which are house numbers of a part.
    """
    c = F.col
    gender, band = X.norm_text(c("gender"), ascii_only=True), X.age_band(c("age"))
    rows = records.select("part_number", "verification_status", gender.alias("g"), band.alias("band"), F.nullif(X.norm_house(c("house"), ascii_only=True), F.lit("")).alias("h"))
    house = F.when(c("h").isNotNull(), F.struct(c("part_number").alias("of"), "h"))
    rows = rows.withColumn("house", house)
    known = [c("g").startswith(x) for x in ("m", "f")]
    out = rows.groupingSets([[], [c("part_number")]], "part_number").agg(
        F.count("*").alias("records"),
        F.count_if(known[0]).alias("men"),
        F.count_if(known[1]).alias("women"),
        F.count_if((c("g") != "") & ~known[0] & ~known[1]).alias("others"),
        F.count_if(c("g") == "").alias("no_gender"),
        *[F.count_if(c("band") == b).alias(f"age_{b}") for b in BANDS],
        F.count_if(c("verification_status") == "verified").alias("verified"),
        F.count_if(c("verification_status") == "requires_review").alias("review"),
        F.countDistinct("house").alias("houses"),
        F.grouping("part_number").alias("_all"),
    )
    return out.withColumn("scope", F.when(c("_all") == 1, "all").otherwise("part")).drop("_all")


def dashboard_filter(records: DataFrame, documents: DataFrame, part: int | None = None, edition: str | None = None, document: int | None = None, status: str | None = None, gender: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Records of known documents by the filters that are given; gender is a prefix, an age bound leaves out unknown ages."""
    c = F.col
    for value, keep in (
        (part, c("part_number") == part),
        (edition, c("lang") == edition),
        (document, c("doc_id") == document),
        (status, c("verification_status") == status),
        (low, c("age") >= low if low is not None else None),
        (high, c("age") <= high if high is not None else None),
    ):
        if value is not None:
            records = records.filter(keep)
    if gender:
        records = records.filter(F.lower(F.trim("gender")).startswith(gender.lower()))
    return records.join(documents.select("doc_id"), "doc_id", "left_semi")


def house_filter(groups: DataFrame, text: str) -> DataFrame:
    """House groups whose key holds the text in key form; a blank text keeps all."""
    key = "".join(text.split()).lower()
    return groups.filter(F.col("house_key").contains(key)) if key else groups


def report_scope(matrix: DataFrame, part: int | None = None, edition: str | None = None) -> DataFrame:
    """Rows of a part and edition matrix for a report."""
    matrix = matrix if part is None else matrix.filter(F.col("part_number") == part)
    return matrix if edition is None else matrix.filter(F.col("lang") == edition)


def coverage_floor(coverage: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: the least linked share of all editions, in percent, and the missing fields of all records."""
    share = coverage.agg(F.min(X.percent(F.col("linked_slots"), F.col("expected_slots"))).alias("least_pct"))
    missing = sum((F.col(f"null_{f}") for f in FIELDS), F.lit(0).cast("long"))
    return share.crossJoin(summary.select(missing.alias("missing_fields")))  # one row each


def open_issue_slots(issues: DataFrame, linked: DataFrame) -> DataFrame:
    """Slots, each once, of which some record has an open issue."""
    return linked.filter("slot_serial is not null").join(issues.filter("status = 'open'").select("record_id"), "record_id", "left_semi").select("part_number", "slot_serial").distinct()


def recent_rows(ledger: DataFrame, at: str, key: str, most: int = 10) -> DataFrame:
    """The latest rows of a ledger, which is what its page shows."""
    return ledger.orderBy(F.col(at).desc(), F.col(key).desc()).limit(most)
