"""What a part's serials lack or repeat, as lists; missing serials are ranges, so their cost follows the records, not the range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcheck.functions import text as X
from rollcheck.operators.registry import small

#: Serials of a part are sorted in spans of so many; only the spans' ends meet in one task.
SPAN = 1 << 16
#: Members of a list row; a group with more has several rows.
MEMBERS = 1000


def missing_ranges(records: DataFrame, expectations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(part_number, *by, low, high): the expected serials that no record has, as maximal ranges.

    records: part_number, serial (a number or null) and the columns of `by`; expectations may have those too and
    then says which combinations are looked at. Serials are sorted within spans, then the spans' first and last ones.
    """
    keys = ["part_number", *by]
    met = records.filter("serial is not null").select(*keys, F.col("serial").cast("long").alias("serial")).join(small(expectations.select(*keys, "serial_start", "serial_end")), keys)
    met = met.filter("serial between serial_start and serial_end").select(*keys, "serial").distinct().withColumn("span", F.floor(F.col("serial") / SPAN))
    inner = met.withColumn("before", F.lag("serial").over(Window.partitionBy(*keys, "span").orderBy("serial")))
    inside = inner.filter("serial - before > 1").select(*keys, (F.col("before") + 1).alias("low"), (F.col("serial") - 1).alias("high"))
    spans = met.groupBy(*keys, "span").agg(F.min("serial").alias("first"), F.max("serial").alias("last"))
    spans = spans.withColumn("before", F.lag("last").over(Window.partitionBy(*keys).orderBy("span")))
    between = spans.filter("first - before > 1").select(*keys, (F.col("before") + 1).alias("low"), (F.col("first") - 1).alias("high"))
    ends = expectations.select(*keys, F.col("serial_start").cast("long"), F.col("serial_end").cast("long")).join(spans.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last")), keys, "left")
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    start, end = F.col("serial_start"), F.col("serial_end")
    outer = F.when(F.col("first").isNull(), F.array(span(start, end))).otherwise(F.array(span(start, F.col("first") - 1), span(F.col("last") + 1, end)))
    edges = ends.select(*keys, F.explode(outer).alias("r")).select(*keys, "r.low", "r.high").filter("low <= high")
    return inside.unionByName(between).unionByName(edges)


def member_lists(rows: DataFrame, keys: list[str], member: str, size: int = MEMBERS) -> DataFrame:
    """(*keys, n, chunk, members): each group's members, sorted, in rows of about `size` at most; n is the group's whole number.

    Null keys are a group like others. A group of n members is dealt to ceil(n / size) rows by a hash of the member, so a huge group is many rows.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumnsRenamed({k: f"_{k}" for k in keys})
    chunks = F.greatest(F.ceil(F.col("n") / size), F.lit(1))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    dealt = rows.select(*keys, F.col(member).alias("_m")).join(sizes, same).withColumn("chunk", F.pmod(F.xxhash64("_m"), chunks))
    return dealt.groupBy(*keys, "n", "chunk").agg(F.array_sort(F.collect_list("_m")).alias("members"))


def completeness_lists(records: DataFrame, expectations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(part_number, *by, kind, low, high, key, n, ids) of all that stands against completeness.

    missing: a range low .. high of n serials; duplicate and unexpected: a serial (low = high), its n records and their
    ids; invalid: records whose serial is no number; unsupported: records of parts without expectation; duplicate_ident: an
    ident (key) of several records of the expected parts, whatever part those are of. Lists over MEMBERS ids go on in
    further rows. With by, editions say, each is assessed on its own, and expectations must have the column.
    """
    c = F.col
    keys = ["part_number", *by]
    own = records.select(*keys, "record_id", X.parse_serial(c("serial_number")).alias("serial"), X.ident_key(c("ident")).alias("key"))
    e = small(expectations.select(*keys, "serial_start", "serial_end"))
    known = own.join(e, keys)
    null = lambda t: F.lit(None).cast(t)
    order = [*keys, "kind", "low", "high", "key", "n", "ids"]
    gaps = missing_ranges(own, expectations, by).select(*keys, F.lit("missing").alias("kind"), "low", "high", null("string").alias("key"), (c("high") - c("low") + 1).alias("n"), null("array<string>").alias("ids"))
    inside = c("serial").between(c("serial_start"), c("serial_end"))
    kind = F.when(c("serial").isNull(), "invalid").when(inside, "duplicate").otherwise("unexpected")
    listed = member_lists(known.withColumns({"kind": kind, "low": c("serial").cast("long")}), [*keys, "kind", "low"], "record_id")
    listed = listed.filter("kind <> 'duplicate' or n > 1").select(*keys, "kind", "low", c("low").alias("high"), null("string").alias("key"), "n", c("members").alias("ids"))
    other = own.join(e.select(*keys), keys, "left_anti")
    unsupported = member_lists(other, keys, "record_id").select(*keys, F.lit("unsupported").alias("kind"), null("long").alias("low"), null("long").alias("high"), null("string").alias("key"), "n", c("members").alias("ids"))
    idents = member_lists(known.filter("key is not null"), [*by, "key"], "record_id").filter("n > 1")
    idents = idents.select(null("int").alias("part_number"), *by, F.lit("duplicate_ident").alias("kind"), null("long").alias("low"), null("long").alias("high"), "key", "n", c("members").alias("ids"))
    return gaps.select(*order).unionByName(listed.select(*order)).unionByName(unsupported.select(*order)).unionByName(idents.select(*order))


def _list(kind: str, entry: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))


def completeness_report(records: DataFrame, expectations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each expected part (and `by`): counts, the lists as arrays, and whether nothing stands against it.

    missing is an array of (low, high), duplicate and unexpected of (serial, n, ids), invalid of record ids. Arrays
    are a report's; completeness_lists has the same in rows of bounded size.
    """
    c = F.col
    keys = ["part_number", *by]
    lists = completeness_lists(records, expectations, by).filter(c("kind").isin("missing", "duplicate", "unexpected", "invalid"))
    entry = F.struct(c("low").alias("serial"), "n", "ids")
    per = lists.groupBy(*keys).agg(
        _list("missing", F.struct("low", "high")).alias("missing"),
        _list("duplicate", entry).alias("duplicate"),
        _list("unexpected", entry).alias("unexpected"),
        F.array_sort(F.flatten(_list("invalid", c("ids")))).alias("invalid"),
        F.sum(F.when(c("kind") == "missing", c("n"))).alias("missing_count"),
    )
    serial = X.parse_serial(c("serial_number"))
    expected = small(expectations.select(*keys, "serial_start", "serial_end"))
    counts = records.join(expected, keys).groupBy(*keys).agg(
        F.count("*").alias("record_count"),
        F.count_if(serial.between(c("serial_start"), c("serial_end"))).alias("valid_count"),
    )
    out = expectations.select(*keys, (c("serial_end").cast("long") - c("serial_start") + 1).alias("expected_count")).join(counts, keys, "left").join(per, keys, "left")
    zero = F.lit(0).cast("long")
    arrays = {k: F.coalesce(c(k), F.array().cast(out.schema[k].dataType)) for k in ("missing", "duplicate", "unexpected", "invalid")}
    missing = F.coalesce("missing_count", zero)
    return out.select(
        *keys,
        "expected_count",
        *[F.coalesce(k, zero).alias(k) for k in ("record_count", "valid_count")],
        (c("expected_count") - missing).alias("unique_expected_count"),
        missing.alias("missing_count"),
        *[x.alias(k) for k, x in arrays.items()],
    ).withColumn("complete", sum((F.size(k) for k in arrays), F.lit(0)) == 0)


def edition_verdict(report: DataFrame, lists: DataFrame, by: str = "lang") -> DataFrame:
    """(by, record_count, duplicate_idents, unsupported, complete): an edition is complete if all its parts are, no ident stands twice and no record is of an unknown part."""
    c = F.col
    parts = report.groupBy(by).agg(F.sum("record_count").alias("record_count"), F.bool_and("complete").alias("parts_complete"))
    ids = F.when(c("kind") == "unsupported", F.size("ids"))
    against = lists.filter(c("kind").isin("duplicate_ident", "unsupported")).groupBy(by).agg(F.countDistinct(F.when(c("kind") == "duplicate_ident", c("key"))).alias("duplicate_idents"), F.sum(ids).alias("unsupported"))
    zero = F.lit(0).cast("long")
    out = parts.join(against, by, "full").select(by, *[F.coalesce(k, zero).alias(k) for k in ("record_count", "duplicate_idents", "unsupported")], F.coalesce("parts_complete", F.lit(True)).alias("_parts"))
    return out.withColumn("complete", c("_parts") & (c("duplicate_idents") == 0) & (c("unsupported") == 0)).drop("_parts")


def suspicious_ident_lists(records: DataFrame) -> DataFrame:
    """(part_number, lang, ident, serials, n, chunk, ids): idents that one edition of a part carries on several serials, with those and the record ids."""
    keys = ["part_number", "lang", "ident"]
    keyed = records.select("part_number", "lang", X.ident_key(F.col("ident")).alias("ident"), X.parse_serial(F.col("serial_number")).alias("serial"), "record_id").filter("ident is not null")
    several = keyed.groupBy(*keys).agg(F.array_sort(F.collect_set("serial")).alias("serials")).filter(F.size("serials") > 1)
    return member_lists(keyed.join(several.select(*keys), keys, "left_semi"), keys, "record_id").join(several, keys).select(*keys, "serials", "n", "chunk", F.col("members").alias("ids"))


def house_members(records: DataFrame) -> DataFrame:
    """(doc_id, part_number, house_key, representative, n, chunk, members): who shares a house of a document and part.

    Peers of a record are the other members of its rows. representative is the smallest id; members are in rows of
    bounded size; houses of one are rows too. Records without a house number have none.
    """
    keys = ["doc_id", "part_number", "house_key"]
    keyed = records.withColumn("house_key", X.house_key(F.col("house"))).filter("house_key is not null")
    first = keyed.groupBy(*keys).agg(F.min("record_id").alias("representative"))
    return member_lists(keyed, keys, "record_id").join(first, keys).select(*keys, "representative", "n", "chunk", "members")


def house_order(key: Column) -> list[Column]:
    """Number-aware order of house keys: the leading number, then the second one of 3-12 or 3/12, then the text; keys without a number last."""
    number = lambda k: F.regexp_extract(key, r"^(\d+)(?:\D+(\d+))?", k).try_cast("decimal(38,0)")
    return [number(1).asc_nulls_last(), number(2).asc_nulls_first(), key.asc()]


STATES = ("ok", "missing", "duplicate", "unexpected")


def serial_rows(records: DataFrame, documents: DataFrame, expectations: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Rows of a serial report: part_number, edition, serial_number, serial_status, occurrence_count, chunk, source_record_ids, page_cursor.

    One for each expected serial of a part and edition (en, te, ur, over active documents) and one for each other serial
    text met; edition `canonical` is about the slots' elected records (canonical: part_number, slot_serial,
    canonical_id) if those are given. Serials with more than MEMBERS records go on in further chunks.
    """
    c = F.col
    editions = ["en", "te", "ur"]
    own = records.join(small(documents.filter("active_version").select("doc_id")), "doc_id").filter(c("lang").isin(*editions)).select("part_number", c("lang").alias("edition"), "record_id", F.trim("serial_number").alias("text"))
    if canonical is not None:
        editions.append("canonical")
        own = own.unionByName(canonical.filter("canonical_id is not null").select("part_number", F.lit("canonical").alias("edition"), c("canonical_id").alias("record_id"), c("slot_serial").cast("string").alias("text")))
    keys = ["part_number", "edition"]
    wanted = expectations.select("part_number", "serial_start", "serial_end", F.explode(F.array(*map(F.lit, editions))).alias("edition"))
    n = X.parse_serial(c("text"))
    met = own.join(small(wanted), keys).withColumn("n", F.when(n.between(c("serial_start"), c("serial_end")), n))
    met = met.withColumn("other", F.when(c("n").isNull(), F.coalesce(F.nullif("text", F.lit("")), F.lit("[missing]"))))
    lists = member_lists(met.select(*keys, c("n").alias("serial"), "other", "record_id").withColumn("serial", F.coalesce("serial", F.lit(-1))).withColumn("other", F.coalesce("other", F.lit(""))), [*keys, "serial", "other"], "record_id")
    slots = wanted.select(*keys, F.explode(F.sequence("serial_start", "serial_end")).alias("serial")).withColumn("other", F.lit(""))
    joined = slots.withColumn("_slot", F.lit(True)).join(lists, [*keys, "serial", "other"], "full")
    count = F.coalesce("n", F.lit(0).cast("long"))
    state = F.when(c("_slot").isNull(), "unexpected").when(count == 0, "missing").when(count > 1, "duplicate").otherwise("ok")
    cursor = F.when(c("_slot"), F.concat(F.lit("0:"), F.lpad(c("serial").cast("string"), 12, "0"))).otherwise(F.concat(F.lit("1:"), "other"))
    return joined.select(
        *keys,
        F.when(c("_slot"), c("serial").cast("string")).otherwise(c("other")).alias("serial_number"),
        state.alias("serial_status"),
        count.alias("occurrence_count"),
        F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"),
        F.coalesce("members", F.array().cast("array<string>")).alias("source_record_ids"),
        cursor.alias("page_cursor"),
    )
