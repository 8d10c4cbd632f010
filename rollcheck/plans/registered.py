"""Registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcheck.functions import text as X
from rollcheck.operators import completeness as L
from rollcheck.operators import evaluate as K
from rollcheck.operators import extraction as P
from rollcheck.operators import paging as G
from rollcheck.operators import quality as Q
from rollcheck.operators import reconcile as C
from rollcheck.operators import registry as R
from rollcheck.operators import review as V
from rollcheck.operators import search as S
from rollcheck.sources import io
from rollcheck.sources.bindings import frames, oracle
from rollcheck.streaming import ingest as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the bound frames under a name, with its SQL over the same views."""

    def add(f: Callable[[dict[str, DataFrame]], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(frames(spark, sf_dir))
        if sql:
            _ORACLE[name] = oracle(sql)
        return f

    return add


def scalar(name: str, table: str, key: str, made: Callable[[], Column], sql: str, where: str | None = None) -> None:
    """A column function over every row of a table."""
    view = table if table in ("part", "documents", "events", "customer", "orders", "lineitem") else f"fx_{table}"

    def run(f: dict[str, DataFrame]) -> DataFrame:
        return f[table].select(F.col(key), made().alias("v"))

    query(name, f"select {key}, {sql} as v from {view}")(run)


c = F.col
_names = lambda words: ", ".join(f"'{w}'" for w in words)
_gender = lambda x: f"case when lower(trim({x})) in ({_names(X.MALE)}) then 'male' when lower(trim({x})) in ({_names(X.FEMALE)}) then 'female' when lower(trim({x})) in ({_names(X.OTHER)}) then 'other' else 'unknown' end"
_house = lambda x: f"nullif(lower(regexp_replace(trim({x}), '\\s+', '', 'g')), '')"
_ident = lambda x: f"nullif(regexp_replace(upper(trim({x})), '[^A-Z0-9]', '', 'g'), '')"
_serial = lambda x: f"case when regexp_full_match(trim({x}), '[0-9]+') then try_cast(trim({x}) as int) end"
_age = lambda x: f"case when {x} between 18 and 125 then case when {x}<=25 then '18_25' when {x}<=35 then '26_35' when {x}<=45 then '36_45' when {x}<=60 then '46_60' when {x}<=75 then '61_75' else '76_plus' end else 'unknown_invalid' end"
_suspicious = lambda x: (
    f"coalesce(case when trim({x}) <> '' then (length(trim({x})) > 40 or not regexp_matches(trim({x}), '[0-9]') or regexp_matches(trim({x}), '[\\r\\n]') or not regexp_matches(regexp_replace(trim({x}), '\\s+', '', 'g'), '{X.HOUSE_SHAPE}') or regexp_matches(trim({x}), '(?i)(?:{X.HOUSE_LABELS})')) end, false)"
)
_norm = lambda x: f"coalesce(trim(regexp_replace(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '\\s*-\\s*', '-', 'g')), '')"

# --- functions
scalar("b1_norm_text", "part", "p_partkey", lambda: X.norm_text(F.concat(c("p_name"), F.lit("  -  "), c("p_type"))), _norm("(p_name || '  -  ' || p_type)"))
scalar("b2_norm_house", "records", "record_id", lambda: X.norm_house(F.concat(F.coalesce("house", F.lit("")), F.lit(" / A"))), f"regexp_replace({_norm("(coalesce(house, '') || ' / A')")}, '\\s*/\\s*', '/', 'g')")
scalar("b3_house_key", "records", "record_id", lambda: X.house_key(c("house")), _house("house"))
scalar("b4_ident_key", "records", "record_id", lambda: X.ident_key(F.concat(F.lit(" -"), c("ident"))), _ident("(' -' || ident)"))
scalar("b5_norm_field", "records", "record_id", lambda: X.norm_field(c("serial_number"), "serial_number"), "nullif(regexp_replace(serial_number, '[^0-9]', '', 'g'), '')")
scalar("b6_gender_group", "records", "record_id", lambda: X.gender_group(c("gender")), _gender("gender"))
scalar("b7_gender_en", "records", "record_id", lambda: X.gender_en(c("gender")), "case when lower(trim(gender)) in ('m','male') then 'male' when lower(trim(gender)) in ('f','female') then 'female' when lower(trim(gender)) in ('o','other') then 'other' else nullif(lower(trim(gender)),'') end")
scalar("b8_age_group", "records", "record_id", lambda: X.age_group(c("age")), _age("age"))
scalar("b9_age_band", "records", "record_id", lambda: X.age_band(c("age")), "case when age is null then 'missing' when age<=25 then '18-25' when age<=35 then '26-35' when age<=50 then '36-50' when age<=65 then '51-65' else '66+' end")
scalar("b10_effective", "records", "record_id", lambda: X.effective(c("age"), c("serial_number"), True), "coalesce(case when regexp_full_match(nullif(trim(serial_number),''), '[0-9]+') then try_cast(nullif(trim(serial_number),'') as int) end, age)")
scalar("b11_parse_serial", "records", "record_id", lambda: X.parse_serial(c("serial_number")), _serial("serial_number"))
scalar("b13_canonical_serial", "records", "record_id", lambda: X.is_canonical_serial(c("serial_number"), 1, 500), f"coalesce(cast(({_serial('serial_number')}) as varchar) = trim(serial_number) and ({_serial('serial_number')}) between 1 and 500, false)")
scalar("b14_suspicious_house", "records", "record_id", lambda: X.suspicious_house(F.concat_ws(" ", c("house"), c("gender"))), _suspicious("concat_ws(' ', house, gender)"))
scalar("b16_similarity", "part", "p_partkey", lambda: F.round(X.similarity(c("p_name"), c("p_type")), 6), f"round(case when {_norm('p_name')}='' or {_norm('p_type')}='' then 0.0 when contains({_norm('p_name')}, {_norm('p_type')}) or contains({_norm('p_type')}, {_norm('p_name')}) then least(length({_norm('p_name')}), length({_norm('p_type')}))/greatest(length({_norm('p_name')}), length({_norm('p_type')})) else 1 - levenshtein({_norm('p_name')}, {_norm('p_type')})/greatest(length({_norm('p_name')}), length({_norm('p_type')})) end, 6)")
_tri = lambda x: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w)+2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_trisim = lambda a, b: f"round(len(list_intersect({_tri(a)}, {_tri(b)}))::double / len(list_distinct(list_concat({_tri(a)}, {_tri(b)}))), 6)"
scalar("b17_trigram_similarity", "part", "p_partkey", lambda: F.round(X.trigram_similarity(c("p_name"), c("p_type")), 6), _trisim("p_name", "p_type"))
_wordlist = lambda x: f"string_split({x}, ' ')"
_letters = lambda x, a, b: f"array_to_string(list_transform({_wordlist(x)}, lambda w: chr((47+list_position(list_distinct(list_concat({_wordlist(a)}, {_wordlist(b)})), w))::int)), '')"
_turned = "(p_type || ' ' || p_name || ' steel')"
scalar("b18_edit_distance", "part", "p_partkey", lambda: F.concat_ws(":", F.levenshtein("p_name", "p_type"), X.token_distance(F.concat_ws(" ", c("p_name"), c("p_type")), F.concat_ws(" ", c("p_type"), c("p_name"), F.lit("steel")))), f"levenshtein(p_name, p_type)::int || ':' || levenshtein({_letters("(p_name || ' ' || p_type)", "(p_name || ' ' || p_type)", _turned)}, {_letters(_turned, "(p_name || ' ' || p_type)", _turned)})::int")
scalar("b19_edition_from_filename", "part", "p_partkey", lambda: X.edition_from_filename(F.concat(F.lit("roll-"), F.when(c("p_partkey") % 3 == 0, "TEL").when(c("p_partkey") % 3 == 1, "Urdu").otherwise("xx"), F.lit("-227.pdf"))), "case p_partkey%3 when 0 then 'te' when 1 then 'ur' else 'en' end")
scalar("b20_part_from_text", "part", "p_partkey", lambda: X.part_from_text(F.concat(F.lit("Part No. 227 and part "), (227 + c("p_partkey") % 3).cast("string")), F.lit("x.pdf"), [227, 228]), "case when p_partkey%3 = 1 then null else 227 end")
scalar("b21_revision_from_filename", "part", "p_partkey", lambda: X.revision_from_filename(F.concat(F.lit("roll_"), (2020 + c("p_partkey") % 5).cast("string"), F.lit(".pdf"))), "cast(2020 + p_partkey % 5 as varchar)")
_scripts = lambda: F.concat(F.when(c("doc_id") % 3 == 0, F.repeat(F.lit("రామ"), F.length("text"))).when(c("doc_id") % 3 == 1, F.repeat(F.lit("شوہر"), F.length("text"))).otherwise(F.lit("")), F.when(c("doc_id") % 7 == 0, "12").otherwise(c("text")))
scalar("b22_detect_language", "documents", "doc_id", lambda: X.detect_language(_scripts())["language"], "case when doc_id%3=0 and length(text) > 1 then 'te' when doc_id%3=1 and length(text) > 0 then 'ur' else 'en' end")
scalar("b23_expected_total", "documents", "doc_id", lambda: X.expected_total(F.concat(c("text"), F.lit(" Total Electors : "), (c("doc_id") + 10).cast("string"))), "cast(coalesce(nullif(regexp_extract(text || ' Total Electors : ' || (doc_id+10), '" + X.TOTALS[0] + "', 1), ''), regexp_extract(text, '" + X.TOTALS[1] + "', 1)) as int)")
scalar("b24_printed_page", "part", "p_partkey", lambda: X.printed_page(F.concat(F.lit("Total Pages 30 - Page : "), c("p_partkey").cast("string"))), "nullif(p_partkey, 0)::int")
_page_text = "case page%5 when 0 then 'Electors Summary' when 1 then 'a map of it' when 2 then 'Draft  Roll 2020' else status end"
scalar("b25_page_type", "pages", "doc_id", lambda: X.page_type(F.expr(_page_text), F.when(c("page") % 2 == 0, c("records_detected")).otherwise(0), c("page")), "case when page%2=0 and records_detected > 0 then 'voter' when page%5=0 then 'summary' when page%5=1 then 'map' when page%5=2 and page<=3 then 'cover' else 'unknown' end")
scalar("b26_record_labels", "documents", "doc_id", lambda: X.count_record_labels(F.concat(F.lit("1. Name: x\n"), c("text"))), "1 + len(regexp_extract_all(text, '(?im)(?:^|\\n)\\s*(?:\\[?\\d{1,4}\\]?[.)-]?\\s*)?(?:Name)\\s*:'))::int")
scalar("b27_relation_type", "records", "record_id", lambda: X.relation_type(F.concat(F.lit(" "), F.upper("relation_type"), F.lit(" "))), "relation_type")
scalar("b28_percent", "pages", "doc_id", lambda: X.percent(c("records_extracted"), c("records_detected")), "case when records_detected > 0 then round(greatest(0, least(100, records_extracted::decimal(20,4)/records_detected*100)), 1) else 0 end::decimal(18,1)")
scalar("b29_norm_search", "documents", "doc_id", lambda: X.norm_search(c("text")), "substr(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g'), 1, 120)")
scalar("b30_escape_like", "records", "record_id", lambda: X.escape_like(F.concat_ws("%", "house", "ident", F.lit("a_b"))), "replace(replace(concat_ws('%', house, ident, 'a_b'), '%', '\\%'), '_', '\\_')")
scalar("b31_route_query", "records", "record_id", lambda: X.route_query(F.coalesce("ident", "house", F.lit("a name"))), "case when regexp_matches(coalesce(ident, house, 'a name'), '(?i)^[A-Z]{3}[0-9]{7}$') then 'ident' when regexp_matches(coalesce(ident, house, 'a name'), '^[0-9][0-9A-Za-z/-]*$') then 'house' else 'name' end")
_message = "case issue_id%7 when 0 then 'Unable to process page' when 1 then 'Page sequence broken' when 2 then 'Printed page 3 missing' when 3 then 'Language unclear' when 4 then 'Detected 31' when 5 then issue_detail end"
scalar("b32_issue_type", "issues", "issue_id", lambda: X.issue_type(F.expr(_message)), "case issue_id%7 when 0 then 'page_failure' when 1 then 'page_sequence' when 2 then 'missing_page' when 3 then 'language' when 4 then 'malformed_record' else 'low_confidence' end")
scalar("b35_grid_cell", "pages", "doc_id", lambda: X.grid_cell((c("page") * 30).cast("double"), (c("page") * 41 % 1000).cast("double"), F.lit(600.0), F.lit(1000.0)), "case when floor((page*41%1000 - 32.0)/94.0) between 0 and 9 then (floor((page*41%1000 - 32.0)/94.0)*3 + greatest(0, least(2, floor(page*30/200.0))))::int end")
scalar("b37_evidence", "records", "record_id", lambda: X.evidence(c("house"), c("serial_number")), "case when house is null or serial_number is null then 'unavailable' when house=serial_number then 'match' else 'mismatch' end")
scalar("b38_field_diff", "records", "record_id", lambda: X.differs(c("house"), c("serial_number")), "coalesce(trim(house),'') <> coalesce(trim(serial_number),'')")
scalar("b39_map_access", "records", "record_id", lambda: F.map_concat(F.create_map(F.lit("ident"), c("ident")), F.create_map(F.lit("house"), c("house")))["house"], "house")
scalar("b40_clean_pages", "records", "record_id", lambda: F.array_join(X.clean_pages(F.array(c("age"), F.lit(3), c("age"))), ","), "array_to_string(list_sort(list_distinct([age, 3])), ',')")
scalar("b41_parse_box", "records", "record_id", lambda: X.parse_box(F.concat_ws(",", c("age"), F.lit("1,2,3,4"), F.when(c("age") % 2 == 0, "5").otherwise("z")))["x"], "case when age%2=0 then age::double end")
scalar("a5_payload_class", "documents", "doc_id", lambda: X.payload_class(c("text")), "case when starts_with(lower(ltrim(substr(text,1,1024))), '<html') then 'html' when contains(lower(substr(text,1,1024)), '%pdf-') then 'ok' else 'invalid' end")


@query("a5_page_payloads", "select page_id, 'html' as kind, sha256(html) as checksum from pages where starts_with(lower(ltrim(html)), '<!doctype html') union all select page_id, 'invalid', sha256(html) from pages where not starts_with(lower(ltrim(html)), '<!doctype html')")
def _a5(f):
    return f["pages_html"].select("page_id", X.payload_class(c("html")).alias("kind"), F.sha2("html", 256).alias("checksum"))


@query("a5_strict_payloads", "select doc_id, case doc_id%4 when 0 then 'ok' when 1 then 'html' else 'invalid' end as kind from documents")
def _a5s(f):
    front = F.when(c("doc_id") % 4 == 0, "%PDF-1.7 ").when(c("doc_id") % 4 == 1, " <html> ").when(c("doc_id") % 4 == 2, " %PDF-1.7 ").otherwise("%pdf-")
    return f["documents"].select("doc_id", X.payload_class(F.concat(front, F.coalesce("text", F.lit(""))), strict=True).alias("kind"))


@query("b12_slot_key", f"select record_id, case when ({_serial('serial_number')}) between e.serial_start and e.serial_end then r.part_number || ':' || ({_serial('serial_number')}) end as v from fx_records r join fx_expectations e on e.part_number=r.part_number")
def _b12(f):
    linked = R.link_records(f["records"], f["expectations"])
    return linked.select("record_id", F.when(c("slot_serial").isNotNull(), F.concat_ws(":", "part_number", "slot_serial")).alias("v"))


_LATIN = "case when name like 'Person%' then regexp_replace(lower(name), '\\s+', ' ', 'g') when name is null then '' else 'raama ' || substr(name, 5) end"


@query("b15_romanize", f"select record_id, {_LATIN} as v from fx_records")
def _b15(f):
    return f["records"].select("record_id", X.romanize(c("name")).alias("v"))


@query("b33_record_id")
def _b33(f):
    return f["records"].select("record_id", X.record_id(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), c("record_id")).alias("v"))


@query("b34_mean_confidence", "select record_id, (conf + age) / 2 * 100 as v from fx_records")
def _b34(f):
    return f["records"].select("record_id", X.mean_confidence(F.create_map(F.lit("a"), c("conf"), F.lit("b"), c("age").cast("double"), F.lit("c"), F.lit(None).cast("double"))).alias("v"))


# --- sources and sinks
@query("a3_active_records", "select r.record_id from fx_records r join fx_documents d on d.doc_id=r.doc_id where d.active_version")
def _a3(f):
    return R.active_records(f["records"], f["documents_roll"]).select("record_id")


@query("a4_compat_views", "select 'documents' as v, doc_id, lang as x from fx_documents union all select 'records', doc_id, record_id from fx_records union all select 'pages', doc_id, status from fx_pages")
def _a4(f):
    io.compat_views(f.spark, {"documents": f["documents_roll"], "pages": f["pages"], "records": f["records"], "issues": f["issues"]})
    return f.spark.sql("select 'documents' as v, doc_id, source_language as x from compat_uploaded_documents").unionByName(f["records"].select(F.lit("records").alias("v"), "doc_id", c("record_id").alias("x"))).unionByName(f["pages"].select(F.lit("pages").alias("v"), "doc_id", c("status").alias("x")))


@query("a1_load_registry", "select 'orders' as name, count(*) n, sum(o_orderkey)::bigint as keys from orders union all select 'customer', count(*), sum(c_custkey)::bigint from customer")
def _a1(f):
    typed = io.load_registry(f.spark, f.sf_dir, {"orders": "o_orderkey long, o_custkey long", "customer": "c_custkey long, c_name string"})
    keys = {"orders": "o_orderkey", "customer": "c_custkey"}
    one, two = (typed[k].agg(F.count("*").alias("n"), F.sum(keys[k]).alias("keys")).select(F.lit(k).alias("name"), "n", "keys") for k in keys)
    return one.unionByName(two)


@query("a6_inspect_filenames", """select doc_id, case when doc_id%13=0 then 'not_a_pdf' when part_number%5=0 and doc_id%3=0 then 'part_unknown' when part_number%3=0 and part_number%5<>0 and doc_id%3<>0 then 'part_conflict'
 when doc_id%7=0 and doc_id%4=0 then 'edition_unknown' when doc_id%7<>0 and doc_id%4<>0 and doc_id%11=0 and lang<>'te' then 'edition_conflict' end as refusal,
 case when doc_id%7=0 then null else lang end as detected_lang, cast(2000+doc_id%30 as int) as revision_year from fx_documents""")
def _a6(f):
    d, p = c("doc_id"), c("part_number")
    code = F.when(d % 7 == 0, "ROLL").when(c("lang") == "te", "tel").when(c("lang") == "ur", "URDU").otherwise("ENG")
    name = F.concat(F.lit("S1-"), code, F.lit("-x-"), (2000 + d % 30).cast("string"), F.when(d % 13 == 0, ".doc").otherwise(".PDF"))
    detected = F.when(p % 5 == 0, None).when(p % 3 == 0, p + 1).otherwise(p)
    files = f["documents_roll"].select("doc_id", name.alias("name"), F.when(d % 3 != 0, p).alias("declared_part"), detected.alias("detected_part"), F.when(d % 4 == 0, None).when(d % 11 == 0, "te").otherwise(c("lang")).alias("declared_lang"))
    return io.inspect_filenames(files).select("doc_id", "refusal", "detected_lang", "revision_year")


@query("a7_dedupe_by_checksum", "with k as (select sha256(text) s, count(*) n from documents group by 1) select d.doc_id from documents d join k on k.s=sha256(d.text) where k.n=1")
def _a7(f):
    files = f["documents"].select("doc_id", F.sha2("text", 256).alias("checksum"))
    repeated = files.groupBy("checksum").agg(F.count("*").alias("n")).filter("n > 1").select("checksum", F.lit("completed").alias("status"))
    return io.split_known_files(files, repeated)["new"].select("doc_id")


@query("a7_file_decisions", """with lost as (select distinct doc_id from fx_pages where status='requires_review' and error_type in ('page_processing_failed','page_persistence_failed')), known as (select d.filename, bool_or(processing_status in ('failed','interrupted','processing') or l.doc_id is not null) again from fx_documents d left join lost l using (doc_id) where d.part_number%5<>0 group by 1)
 select d.doc_id, case when k.filename is null then 'new' when again then 'resume' else 'refuse' end as decision from fx_documents d left join known k using (filename)""")
def _a7d(f):
    docs = f["documents_roll"].withColumn("checksum", F.sha2("filename", 256))
    known = docs.filter("part_number % 5 <> 0").select("doc_id", "checksum", c("processing_status").alias("status"))
    parts = io.split_known_files(docs.select("doc_id", "checksum"), known, f["pages"])
    each = [df.select("doc_id", F.lit(k).alias("decision")) for k, df in parts.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("h3_upsert_into", "select l_suppkey as k, coalesce(max(l_partkey) filter (l_orderkey%2=0 and l_suppkey%3=0), max(l_partkey) filter (l_orderkey%2=1)) as v from lineitem where l_orderkey%2=1 or l_suppkey%3=0 group by 1")
def _h3u(f):
    path = io.scratch_dir(f.spark, "upsert")
    rows = f["lineitem"].select(c("l_suppkey").alias("k"), c("l_partkey").alias("v"), "l_orderkey")
    io.upsert_into(rows.filter("l_orderkey % 2 = 1").select("k", "v"), path, ["k"], 16)
    later = rows.filter("l_orderkey % 2 = 0 and k % 3 = 0").select("k", "v")
    for _ in range(2):  # the second run changes nothing
        io.upsert_into(later, path, ["k"], 16)
    return f.spark.read.parquet(path).select("k", "v")


@query("a12_upsert_geography", "select c_nationkey as parent, c_mktsegment as child, case when min(c_custkey) filter (c_custkey%2=0) is not null then min(c_custkey) filter (c_custkey%2=0) else min(c_custkey) end as v from customer group by 1, 2")
def _a12u(f):
    path = io.scratch_dir(f.spark, "geography")
    ref = f["customer"].select(c("c_nationkey").alias("parent"), c("c_mktsegment").alias("child"), c("c_custkey").alias("v"))
    for part in (ref.filter("v % 2 = 1"), ref.filter("v % 2 = 0")):
        io.upsert_geography(part, path, "parent", "child", "v")
    return f.spark.read.parquet(path).select("parent", "child", "v")


_LINKED = f"linked as (select r.*, e.serial_start is not null ok, case when e.serial_start is not null then {_serial('r.serial_number')} end slot_serial from fx_records r left join fx_expectations e on e.part_number=r.part_number and ({_serial('r.serial_number')}) between e.serial_start and e.serial_end)"
_SLOTS = "slots as (select part_number, unnest(generate_series(serial_start, serial_end))::int serial_no from fx_expectations)"


@query("a10_master_dataset", f"with {_LINKED}, {_SLOTS}, per as (select part_number, slot_serial, string_agg(record_id, ',' order by case lang when 'en' then 1 else 2 end, record_id) ids from linked where slot_serial is not null group by 1,2) select s.part_number, s.serial_no, coalesce(p.ids, '') as ids from slots s left join per p on p.part_number=s.part_number and p.slot_serial=s.serial_no")
def _a10(f):
    master = io.master_dataset(R.expected_slots(f["expectations"]), R.link_records(f["records"], f["expectations"]))
    return master.select("part_number", "serial_no", F.array_join(F.transform("records", lambda r: r["record_id"]), ",").alias("ids"))


@query("a12_normalize_geography", "select r.r_name, n.n_name, min(c.c_custkey) c_custkey from region r join nation n on n.n_regionkey=r.r_regionkey join customer c on c.c_nationkey=n.n_nationkey group by 1,2")
def _a12(f):
    flat = f["customer"].join(R.small(f["nation"]), c("c_nationkey") == c("n_nationkey")).join(R.small(f["region"]), c("n_regionkey") == c("r_regionkey"))
    return io.normalize_geography(flat, "r_name", "n_name", "c_custkey")


@query("a14_directory_filter", "select c_custkey from customer where contains(lower(c_name), '00001') and c_mktsegment='BUILDING'")
def _a14(f):
    return io.directory_filter(f["customer"].select("c_custkey", c("c_name").alias("email"), c("c_mktsegment").alias("role")), "00001", "BUILDING").select("c_custkey")


# --- filters
@query("c1_apply_filters", "select record_id from fx_records where lang='te' and age=43")
def _c1(f):
    return S.apply_filters(f["records"], lang="te", age=43, ident=None).select("record_id")


@query("c3_age_tolerance", "select record_id from fx_records where age between 41 and 45")
def _c3(f):
    return f["records"].filter(X.within(c("age"), 43, 2)).select("record_id")


_MAPPED = "case when age%3=0 then null when age%3=1 then house else ident end"


@query("b38_fields_changed", f"select record_id, coalesce(case when age%4=0 then upper(gender) end, gender, '') as gender, (trim(coalesce(name,'')) <> case when age%5=0 then '' else trim(coalesce(name, '')) end or trim(coalesce(case when age%4=0 then upper(gender) end, gender, '')) <> trim(coalesce(gender, ''))) as changed from fx_records")
def _b38f(f):
    fields = ("name", "gender")
    corrected = F.when(c("age") % 4 == 0, F.create_map(F.lit("gender"), F.upper("gender")))
    entered = F.create_map(F.lit("name"), F.when(c("age") % 5 != 0, F.concat(F.lit(" "), c("name"), F.lit(" "))), F.lit("gender"), c("gender"))
    return f["records"].select("record_id", X.initial_fields(corrected, fields)["gender"].alias("gender"), X.fields_changed(entered, corrected, fields).alias("changed"))


@query("b39_with_entries", f"select record_id, ({_MAPPED}) as house, case when age%2=0 then name end as name, (({_MAPPED}) is not null)::int + (age%2=0 and name is not null)::int as entries from fx_records")
def _b39w(f):
    old = F.when(c("age") % 2 == 0, F.create_map(F.lit("name"), c("name"), F.lit("house"), F.lit("old")))
    old = F.when(c("name").isNotNull(), old)
    found = X.with_entries(old, {"house": F.when(c("age") % 3 == 0, None).when(c("age") % 3 == 1, c("house")).otherwise(c("ident"))})
    return f["records"].select("record_id", found["house"].alias("house"), found["name"].alias("name"), F.size(found).alias("entries"))


_CATEGORY = {
    "critical": "severity='critical'",
    "pages": "record_id is null or issue_type in ('page_failure','missing_page','malformed_record','page_sequence','card_count_mismatch','partial_page')",
    "records": "record_id is not null",
    "low_confidence": "issue_type='low_confidence'",
    "serial_gaps": "issue_type in ('serial_gap','missing_serial')",
    "house_number": "record_id is not null and (house is null or trim(house)='' or length(house)>40 or not regexp_matches(house,'[0-9]') or regexp_matches(house,'(?i)(photo|not available|elector|gender|age)') or coalesce(conf<95,false))",
    "possible_duplicate": "issue_type in ('possible_duplicate','duplicate_serial','duplicate_ident')",
    "language": "issue_type in ('language','language_incomplete')",
}


@query("c4_review_category", "with j as (select i.*, r.house, r.conf from fx_issues i left join fx_records r on r.record_id=i.record_id) " + " union all ".join(f"select '{k}' as category, issue_id from j where {w}" for k, w in _CATEGORY.items()))
def _c4(f):
    j = f["issues"].join(f["records"].select("record_id", "house", "conf"), "record_id", "left")
    hit = F.array_compact(F.array(*[F.when(p(), k) for k, p in V.CATEGORIES.items()]))
    return j.select(F.explode(hit).alias("category"), "issue_id")


@query("c5_contains_any", "select issue_id from fx_issues where contains(lower(concat_ws(' ', issue_detail, record_id)), 'user 1')")
def _c5(f):
    return f["issues"].filter(V.contains_any("USER 1", "issue_detail", "record_id")).select("issue_id")


@query("c6_dashboard_filter", "select record_id from fx_records r where lang='te' and verification_status='unverified' and starts_with(lower(trim(gender)),'f') and age between 30 and 60 and exists (select 1 from fx_documents d where d.doc_id=r.doc_id)")
def _c6(f):
    return Q.dashboard_filter(f["records"], f["documents_roll"], edition="te", status="unverified", gender="F", low=30, high=60).select("record_id")


@query("c9_needs_attention", "select record_id from fx_records where verification_status='requires_review' or conf < 95")
def _c9(f):
    return V.needs_attention(f["records"]).select("record_id")


# --- joins, set operations and windows
@query("d5_missing_primary", f"with {_LINKED}, {_SLOTS} select part_number, serial_no from slots s where not exists (select 1 from linked l where l.lang='en' and l.part_number=s.part_number and l.slot_serial=s.serial_no)")
def _d5(f):
    return R.missing_primary(R.link_records(f["records"], f["expectations"]), R.expected_slots(f["expectations"]))


@query("d11_unambiguous_idents", "select part_number, ident, min(serial_number) ident_serial from fx_records where ident is not null and serial_number is not null group by 1,2 having count(distinct serial_number)=1")
def _d11(f):
    return R.unambiguous_idents(f["records"])


@query("d14_house_peers", f"select record_id, count(*) over (partition by doc_id, part_number, {_house('house')}) - 1 as peers from fx_records where {_house('house')} is not null")
def _d14(f):
    return R.house_peers(f["records"])


@query("d4_open_issue_slots", f"with {_LINKED} select distinct part_number, slot_serial from linked l where slot_serial is not null and exists (select 1 from fx_issues i where i.status='open' and i.record_id=l.record_id)")
def _d4(f):
    return Q.open_issue_slots(f["issues"], R.link_records(f["records"], f["expectations"]))


@query("d15_latest_row", "select doc_id, issue_id, issue_type from (select *, row_number() over (partition by doc_id order by created_at desc, issue_id desc) n from fx_issues) where n=1")
def _d15(f):
    return V.latest_per_document(f["issues"]).select("doc_id", "issue_id", "issue_type")


@query("d18_lookup", f"with {_LINKED} select 'document' as what, filename as v from fx_documents where active_version and doc_id in (select doc_id from fx_pages where status='failed') union all select 'record', l.record_id from linked l join fx_documents d on d.doc_id=l.doc_id and d.active_version where exists (select 1 from linked o where o.part_number=l.part_number and o.slot_serial=l.slot_serial and o.verification_status='verified')")
def _d18(f):
    linked = R.link_records(f["records"], f["expectations"])
    docs = R.lookup_documents(f["documents_roll"], f["pages"].filter("status = 'failed'").select("doc_id"), True).select(F.lit("document").alias("what"), c("filename").alias("v"))
    return docs.unionByName(R.slot_records(linked, f["documents_roll"], linked.filter("verification_status = 'verified'")).select(F.lit("record").alias("what"), c("record_id").alias("v")))


@query("d19_source_locator", "select r.record_id, d.filename, r.part_number, d.revision_id, least(greatest(coalesce(r.page, 1), 1), greatest(d.pages, 1)) as page from fx_records r join fx_documents d on d.doc_id=r.doc_id")
def _d19(f):
    return R.source_locator(f["records"], f["documents_roll"]).drop("box")


@query("d19_source_box", "select r.record_id, case when age%4=0 then age::double when age%4=1 then 7::double end as x, case when age%4=0 then 2::double when age%4=1 then 8::double end as width from fx_records r join fx_documents d on d.doc_id=r.doc_id")
def _d19b(f):
    numbers = F.concat_ws(",", c("age"), F.lit("1,2,3,4,5"))
    text = F.when(c("age") % 4 == 0, numbers).when(c("age") % 4 == 1, F.lit('{"x":7,"y":1,"width":8,"height":2,"pageWidth":90,"pageHeight":90}')).when(c("age") % 4 == 2, "1,2,three")
    rows = f["records"].withColumn("bounding_box", text)
    return R.source_locator(rows, f["documents_roll"]).select("record_id", "box.x", "box.width")


@query("d16_snowflake", "select r.r_name, n.n_name, count(distinct c.c_custkey) customers, count(*) orders from region r join nation n on n.n_regionkey=r.r_regionkey join customer c on c.c_nationkey=n.n_nationkey join orders o on o.o_custkey=c.c_custkey group by 1,2")
def _d16(f):
    per = f["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = per.join(f["customer"], c("o_custkey") == c("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))
    dims = R.small(f["nation"]).join(R.small(f["region"]), c("n_regionkey") == c("r_regionkey"))
    return j.join(dims, c("c_nationkey") == c("n_nationkey")).groupBy("r_name", "n_name").agg(F.sum("customers").alias("customers"), F.sum("orders").alias("orders"))


@query("d17_compare_sets", f"with {_SLOTS}, o as (select distinct part_number, {_serial('serial_number')} serial_no from fx_records where ({_serial('serial_number')}) is not null) select coalesce(s.part_number, o.part_number) part_number, coalesce(s.serial_no, o.serial_no) serial_no, s.part_number is not null in_expected, o.part_number is not null in_observed from slots s full join o on o.part_number=s.part_number and o.serial_no=s.serial_no")
def _d17(f):
    seen = f["records"].select("part_number", X.parse_serial(c("serial_number")).alias("serial_no")).filter("serial_no is not null")
    return R.compare_sets(R.expected_slots(f["expectations"]), seen, ["part_number", "serial_no"])


@query("h3_upsert", "select record_id, case when age < 30 then age+1 else age end as age from fx_records")
def _h3(f):
    old = f["records"].select("record_id", "age")
    return R.upsert(old, old.filter("age < 30").select("record_id", (c("age") + 1).alias("age")), ["record_id"])


@query("f5_serial_gaps", f"with s as (select distinct doc_id, {_serial('serial_number')} n from fx_records where ({_serial('serial_number')}) is not null), g as (select doc_id, n, lag(n) over (partition by doc_id order by n) b from s) select doc_id, b+1 gap_from, n-1 gap_to, case when b+1=n-1 then cast(b+1 as varchar) else (b+1) || '-' || (n-1) end as gap from g where n-b>1")
def _f5(f):
    return Q.serial_gaps(f["records"])


@query("f6_page_sequence", "with s as (select doc_id, page, printed_page, max(printed_page) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding) so_far from fx_pages) select doc_id, page, printed_page, so_far, case when printed_page > so_far+1 then 'missing_page' else 'out_of_order' end as issue from s where printed_page > so_far+1 or printed_page <= so_far")
def _f6(f):
    return Q.page_sequence(f["pages"])


@query("f8_near_groups", f"with s as (select doc_id, ({_serial('serial_number')})::double v from fx_records where ({_serial('serial_number')}) is not null), a as (select *, case when v - lag(v) over (partition by doc_id order by v) <= 2 then 0 else 1 end x from s), b as (select *, sum(x) over (partition by doc_id order by v, x desc rows unbounded preceding) g from a) select doc_id, g::bigint as group_no, round(avg(v), 6) as mean_value, count(*) as n from b group by 1,2")
def _f8(f):
    values = f["records"].select("doc_id", X.parse_serial(c("serial_number")).cast("double").alias("v")).filter("v is not null")
    return P.near_groups(values, "doc_id", "v", 2)


# --- registry
@query("r1_expected_slots", f"with {_SLOTS} select * from slots")
def _r1(f):
    return R.expected_slots(f["expectations"])


@query("r2_quarantine", f"select r.record_id, case when serial_number is null then 'missing_serial' when not regexp_full_match(trim(serial_number), '[0-9]+') then 'non_numeric_serial' when not coalesce(regexp_full_match(trim(serial_number), '[0-9]{{1,9}}') and cast(try_cast(trim(serial_number) as int) as varchar)=trim(serial_number) and try_cast(trim(serial_number) as int) between e.serial_start and e.serial_end, false) then 'unexpected_or_noncanonical_serial' end as quarantine_reason from fx_records r left join fx_expectations e on e.part_number=r.part_number and e.part_number%4<>0")
def _r2(f):
    return R.quarantine(f["records"], f["expectations"].filter("part_number % 4 <> 0")).select("record_id", "quarantine_reason")


@query("r3_link_records", f"with {_LINKED} select record_id, slot_serial from linked")
def _r3(f):
    return R.link_records(f["records"], f["expectations"]).select("record_id", "slot_serial")


@query("r4_elect_canonical", f"with {_LINKED} select part_number, slot_serial, count(*) candidates, case when count(*)=1 then min(record_id) end canonical_id from linked where lang='en' and slot_serial is not null group by 1,2")
def _r4(f):
    return R.elect_canonical(R.link_records(f["records"], f["expectations"]))


@query("r5_elect_canonical_v0", "with own as (select *, count(*) over (partition by part_number, serial_number) n from fx_records where lang='en'), slots as (select part_number, serial_number from own where n=1 and serial_number is not null), idents as (select o.part_number, o.ident, min(o.serial_number) s from own o join slots using (part_number, serial_number) where o.ident is not null group by 1,2 having count(distinct o.serial_number)=1) select record_id, part_number, case when n=1 then serial_number end as slot_serial from own union all select r.record_id, r.part_number, coalesce(s.serial_number, i.s) from fx_records r left join slots s on s.part_number=r.part_number and s.serial_number=r.serial_number left join idents i on i.part_number=r.part_number and i.ident=r.ident where r.lang<>'en'")
def _r5(f):
    return R.elect_canonical_v0(f["records"])


@query("r6_distinct_slots_v0", "select distinct part_number, serial_number from fx_records where lang='en' and serial_number is not null")
def _r6(f):
    return R.distinct_slots_v0(f["records"])


@query("r6_slot_activity", "with met as (select distinct part_number, serial_number from fx_records where lang='en' and serial_number is not null and age%3<>0), known as (select distinct part_number, serial_number from fx_records where lang='te' and serial_number is not null) select coalesce(m.part_number, k.part_number) part_number, coalesce(m.serial_number, k.serial_number) serial_number, m.part_number is not null as active from met m full join known k on k.part_number=m.part_number and k.serial_number=m.serial_number")
def _r6a(f):
    return R.slot_activity_v0(f["records"].filter("lang = 'te' and serial_number is not null"), f["records"].filter("age % 3 <> 0"))


@query("r7_registry_invariant", "with s as (select part_number, count(*) n from (select part_number, unnest(generate_series(serial_start, serial_end - case when part_number%3=0 then 1 else 0 end)) x from fx_expectations) group by 1) select e.part_number, e.expected_total, s.n as slots, s.n=e.expected_total as holds from fx_expectations e join s using (part_number)")
def _r7(f):
    short = f["expectations"].withColumn("serial_end", c("serial_end") - F.when(c("part_number") % 3 == 0, 1).otherwise(0))
    return R.registry_invariant(R.expected_slots(short), f["expectations"])


@query("r8_quarantine_house", f"select record_id, case when not ({_suspicious('house')}) then house end as house, case when {_suspicious('house')} then 0.0 else conf end as conf, case when {_suspicious('house')} then 'requires_review' else 'unverified' end as verification_status from fx_records")
def _r8(f):
    return R.quarantine_house(f["records"])


@query("r8_house_issues", f"select record_id, doc_id, 'house_number' as issue_type from fx_records where {_suspicious("concat_ws(' ', house, gender)")}")
def _r8b(f):
    return R.house_issues(f["records"].withColumn("house", F.concat_ws(" ", "house", "gender")), f["issues"]).select("record_id", "doc_id", "issue_type")


@query("r9_activate_version", "with d as (select *, processing_status in ('completed','completed_with_warnings') ready from fx_documents) select doc_id, case when max(ready::int) over (partition by part_number, lang)=1 then row_number() over (partition by part_number, lang order by ready desc, doc_id desc)=1 else active_version end as becomes_active from d")
def _r9(f):
    return R.activate_version(f["documents_roll"], [c("doc_id").desc()]).select("doc_id", "becomes_active")


# --- completeness and reconciliation
_SCOPE = f"""scope as (select r.record_id, r.part_number, r.lang, r.created_at, nullif(upper(trim(r.ident)),'') ident, {_house('r.house')} house, r.age, nullif(lower(trim(r.gender)),'') gender,
 case when ({_serial('r.serial_number')}) between e.serial_start and e.serial_end then {_serial('r.serial_number')} end slot_serial
 from fx_records r join fx_documents d on d.doc_id=r.doc_id and d.active_version join fx_expectations e on e.part_number=r.part_number where r.lang in ('en','te'))"""
_ev = lambda x: f"case when en.{x} is null or te.{x} is null then 'unavailable' when en.{x}=te.{x} then 'match' else 'mismatch' end {x}_evidence"
_PAIRED = f"""{_SCOPE}, {_SLOTS},
 counts as (select part_number, slot_serial, count(*) filter (lang='en') en_count, count(*) filter (lang='te') te_count from scope where slot_serial is not null group by 1,2),
 ranked as (select *, row_number() over (partition by part_number, slot_serial, lang order by ORDERING) k from scope where slot_serial is not null),
 paired as (select s.part_number, s.serial_no slot_serial, coalesce(n.en_count,0) en_count, coalesce(n.te_count,0) te_count, en.record_id en_id, te.record_id te_id, {', '.join(_ev(x) for x in C.FIELDS)}
  from slots s left join counts n on n.part_number=s.part_number and n.slot_serial=s.serial_no
  left join ranked en on en.part_number=s.part_number and en.slot_serial=s.serial_no and en.lang='en' and en.k=1
  left join ranked te on te.part_number=s.part_number and te.slot_serial=s.serial_no and te.lang='te' and te.k=1)"""
_PAIRED_ID = _PAIRED.replace("ORDERING", "record_id")
_PAIRED_NEW = _PAIRED.replace("ORDERING", "created_at desc, record_id")
_bad = "+".join(f"({x}_evidence='mismatch')::int" for x in C.FIELDS)
_good = "+".join(f"({x}_evidence='match')::int" for x in C.FIELDS[1:])
_STATUS = f"case when en_count=0 then 'missing_en' when te_count=0 then 'missing_te' when en_count>1 or te_count>1 then 'duplicate_source' when ident_evidence='mismatch' then 'ident_conflict' when {_bad}=0 and (ident_evidence='match' or {_good}>=2) then 'reconciled' else 'needs_review' end"
_SERVICE = f"case when en_count>1 or te_count>1 then 'duplicate_source' when en_count=0 or te_count=0 then 'source_missing' when {_bad}>0 then 'needs_review' else 'reconciled' end"
_CLIENT = f"case when en_count<>1 or te_count<>1 then 'unmatched' when ident_evidence='mismatch' then 'conflict' when {_bad}=0 and (ident_evidence='match' or {_good}>=2) then 'verified' else 'needs_review' end"


def _roll(f):
    return f["records"], f["documents_roll"], f["expectations"]


for _name, _status, _text in (("q7_reconcile_client", C.status_client, _CLIENT), ("q8_reconcile_service", C.status_service, _SERVICE), ("q9_reconcile_status", C.status_sql, _STATUS)):
    query(_name, f"with {_PAIRED_ID} select part_number, slot_serial, en_id, te_id, {_text} as status from paired")(
        lambda f, s=_status: C.pair_editions(*_roll(f)).select("part_number", "slot_serial", c("en.record_id").alias("en_id"), c("te.record_id").alias("te_id"), s().alias("status"))
    )

_SERVED = f"""{_PAIRED_ID}, svc as (select part_number, slot_serial, en_count, te_count, case when en_count=1 then en_id end en_id, case when te_count=1 then te_id end te_id, {_SERVICE} status, {', '.join(f"case when en_count=1 and te_count=1 then {x}_evidence else 'unavailable' end {x}_evidence" for x in C.FIELDS)} from paired where en_count>0 or te_count>0)"""


@query("q8_service_results", f"with {_SERVED} select *, status='reconciled' as safe_to_link, concat_ws(',', {', '.join(f"case when {x}_evidence='mismatch' then '{x}' end" for x in C.FIELDS)}) conflict_fields, case status {' '.join(f"when '{k}' then '{v}'" for k, v in C.SERVICE_REASONS.items())} end reason from svc")
def _q8s(f):
    return C.service_results(*_roll(f)).withColumn("conflict_fields", F.array_join("conflict_fields", ","))


@query("q8_service_batches", f"with {_SERVED} select e.part_number, count(s.status) evaluated, {', '.join(f"count(*) filter (s.status='{k}') {k}" for k in C.SERVICE_REASONS)}, (select count(*) from scope where scope.part_number=e.part_number and slot_serial is null) unlinked from fx_expectations e left join svc s using (part_number) group by 1")
def _q8b(f):
    return C.service_batches(*_roll(f))


@query("q7_links", f"with {_PAIRED_ID}, k as (select *, {_CLIENT} decision from paired) select part_number, slot_serial, en_id, te_id, {', '.join(f'{x}_evidence' for x in C.FIELDS)}, decision, case decision when 'verified' then 'unique identity is corroborated by strong structured fields' else 'unique identity matched, but structured corroboration is incomplete or inconsistent' end reason from k where decision in ('verified', 'needs_review')")
def _q7l(f):
    return C.edition_links(*_roll(f))


@query("q7_conflicts", f"with {_PAIRED_ID}, k as (select *, {_CLIENT} decision from paired) select 'duplicate_identity' kind, lang, part_number, slot_serial, count(*) n, string_agg(record_id, ',' order by record_id) record_ids from scope where slot_serial is not null group by 2,3,4 having count(*)>1 union all select 'structural_conflict', lang, part_number, slot_serial, 1, record_id from scope where slot_serial is null union all select 'ident_conflict', null, part_number, slot_serial, 2, least(en_id, te_id) || ',' || greatest(en_id, te_id) from k where decision='conflict'")
def _q7c(f):
    return C.edition_conflicts(*_roll(f)).withColumn("record_ids", F.array_join("record_ids", ",")).drop("chunk")


@query("q7_unmatched", f"with {_PAIRED_ID}, k as (select *, {_CLIENT} decision from paired), linked as (select unnest([en_id, te_id]) record_id from k where decision in ('verified', 'needs_review')) select lang, record_id from scope anti join linked using (record_id)")
def _q7u(f):
    return C.unmatched_records(*_roll(f))


_SUMMARY = f"""with {_PAIRED_ID}, st as (select *, {_STATUS} status from paired),
 a as (select part_number, count(*) filter (en_count>0 and te_count>0) both_present, {', '.join(f"count(*) filter (status='{s}') {s}" for s in ('reconciled', 'needs_review', 'missing_en', 'duplicate_source', 'ident_conflict'))}, count(*) filter (te_count=0) missing_te from st group by 1),
 d as (select part_number, count(*) active_documents from fx_documents where active_version and lang in ('en','te') group by 1),
 s as (select part_number, count(*) source_records, count(*) filter (slot_serial is null) unlinked_records, count(distinct case when lang='en' then slot_serial end) en_linked_slots, count(distinct case when lang='te' then slot_serial end) te_linked_slots from scope group by 1)
 select e.part_number, e.expected_total, 'r1' as revisions, a.* exclude (part_number), d.active_documents, coalesce(s.source_records,0) source_records, coalesce(s.unlinked_records,0) unlinked_records, coalesce(s.en_linked_slots,0) en_linked_slots, coalesce(s.te_linked_slots,0) te_linked_slots
 from fx_expectations e join a using (part_number) join d using (part_number) left join s using (part_number)"""


@query("q9_reconciliation_summary", _SUMMARY)
def _q9(f):
    return C.reconciliation_summary(*_roll(f))


@query("q11_totals", f"select {', '.join(f'sum({x})::bigint as {x}' for x in ('expected_total', 'both_present', 'reconciled', 'needs_review', 'missing_en', 'duplicate_source', 'ident_conflict', 'missing_te', 'active_documents', 'source_records', 'unlinked_records', 'en_linked_slots', 'te_linked_slots'))} from (" + oracle(_SUMMARY) + ")")
def _q11(f):
    return C.totals(C.reconciliation_summary(*_roll(f)))


_EVIDENCE = f"with {_PAIRED_NEW} select part_number, slot_serial serial_no, {_STATUS} as status, en_id, te_id, lpad(cast(slot_serial as varchar), 8, '0') as sort_key from paired union all select part_number, null, 'unlinked', case when lang='en' then record_id end, case when lang='te' then record_id end, '~' || record_id from scope where slot_serial is null"


@query("q10_reconciliation_evidence", _EVIDENCE)
def _q10(f):
    return C.evidence_rows(*_roll(f))


_SCOPE_ALL = _SCOPE.replace("in ('en','te')", "in ('en','te','ur')")


@query("q1_edition_coverage", f"with {_SCOPE_ALL}, p as (select lang, count(*) source_records, count(distinct part_number*1000+slot_serial) linked, count(*) filter (slot_serial is null) unlinked from scope group by 1), t as (select sum(expected_total)::bigint n from fx_expectations) select l as lang, t.n as expected_slots, coalesce(source_records,0) source_records, coalesce(linked,0) linked_slots, coalesce(unlinked,0) unlinked_records, greatest(t.n - coalesce(linked,0), 0) unavailable_slots from (values ('en'),('te'),('ur')) v(l) cross join t left join p on p.lang=l")
def _q1(f):
    return C.edition_coverage(*_roll(f))


@query("q2_part_edition_quality", f"with {_SCOPE}, p as (select part_number, lang, count(*) source_records, count(distinct slot_serial) linked, count(*) filter (slot_serial is null) unlinked from scope group by 1,2) select e.part_number, l as lang, e.expected_total, coalesce(source_records,0) source_records, coalesce(linked,0) linked_slots, greatest(e.expected_total - coalesce(linked,0), 0) missing_slots, coalesce(unlinked,0) unlinked_records from fx_expectations e cross join (values ('en'),('te')) v(l) left join p on p.part_number=e.part_number and p.lang=l")
def _q2(f):
    return C.part_edition_quality(*_roll(f))


_COMPLETE = f"""with {_SLOTS}, met as (select part_number, {_serial('serial_number')} serial_no, count(*) occurrences, min(record_id) first_id from fx_records group by 1,2),
 q3 as (select coalesce(s.part_number, m.part_number) part_number, coalesce(s.serial_no, m.serial_no) serial_no, coalesce(m.occurrences, 0) occurrences, m.first_id, case when s.part_number is null then 'unexpected' when m.part_number is null then 'missing' when m.occurrences>1 then 'duplicate' else 'ok' end state from slots s full join (select * from met where serial_no is not null) m on m.part_number=s.part_number and m.serial_no=s.serial_no union all select part_number, serial_no, occurrences, first_id, 'unexpected' from met where serial_no is null)"""


@query("q3_serial_completeness", _COMPLETE + " select *, lpad(cast(part_number as varchar), 8, '0') || ':' || lpad(coalesce(cast(serial_no as varchar), '~'), 8, '0') as cursor from q3")
def _q3(f):
    return C.serial_completeness(f["records"], f["expectations"])


@query("q5_edition_completeness", _COMPLETE + f", s as (select part_number, count(*) filter (state='missing') missing, count(*) filter (state='duplicate') duplicate, count(*) filter (state='unexpected' and serial_no is not null) unexpected, coalesce(sum(occurrences) filter (serial_no is null), 0)::bigint invalid from q3 group by 1), i as (select part_number, count(*) n from (select part_number, {_ident('ident')} k from fx_records where ({_ident('ident')}) is not null group by 1,2 having count(*)>1) group by 1) select s.*, coalesce(i.n,0) duplicate_idents, missing+duplicate+unexpected+invalid=0 as complete from s left join i using (part_number)")
def _q5(f):
    return C.edition_completeness(f["records"], f["expectations"])


@query("q6_suspicious_idents", f"select part_number, lang, {_ident('ident')} as ident, count(distinct {_serial('serial_number')}) serials from fx_records where ({_ident('ident')}) is not null and ({_serial('serial_number')}) is not null group by 1,2,3 having count(distinct {_serial('serial_number')})>1")
def _q6(f):
    return C.suspicious_idents(f["records"])


@query("q13_release_gate", f"with {_PAIRED_ID}, st as (select *, {_STATUS} status from paired), p as (select part_number, count(*) filter (en_count=0 and te_count=0) missing_slots, count(*) filter (status='duplicate_source') duplicate_slots, count(*) filter ((en_count=0)<>(te_count=0)) incomplete_slots, count(*) filter (status<>'reconciled') unreconciled_slots from st group by 1), i as (select d.part_number, count(*) n from fx_issues i join fx_documents d on d.doc_id=i.doc_id and d.active_version where i.status='open' and i.severity='critical' group by 1) select p.*, coalesce(i.n,0) critical_issues, missing_slots+duplicate_slots+incomplete_slots+unreconciled_slots+coalesce(i.n,0)=0 as ready from p left join i using (part_number)")
def _q13(f):
    return C.release_gate(*_roll(f), f["issues"])


# --- completeness as lists, and paged reports
_EDITIONS = "ed as (select * from (values ('en'),('te')) v(lang)), e as (select x.*, ed.lang from fx_expectations x cross join ed where part_number<>1)"
_LISTS = f"""{_EDITIONS}, x as (select part_number, lang, record_id, {_serial('serial_number')} s, {_ident('ident')} k from fx_records where lang in ('en','te')),
 known as (select x.*, serial_start, serial_end from x join e using (part_number, lang)),
 gone as (select part_number, lang, unnest(generate_series(serial_start, serial_end)) n from e except select part_number, lang, s from known),
 isl as (select *, n - row_number() over (partition by part_number, lang order by n) g from gone),
 kinds as (select *, case when s is null then 'invalid' when s between serial_start and serial_end then 'duplicate' else 'unexpected' end kind from known),
 lists as (select part_number, lang, 'missing' kind, min(n)::bigint low, max(n)::bigint high, null::varchar k, count(*) n, null::varchar ids from isl group by part_number, lang, g
 union all select part_number, lang, kind, s::bigint, s::bigint, null, count(*), string_agg(record_id, ',' order by record_id) from kinds group by part_number, lang, kind, s having kind<>'duplicate' or count(*)>1
 union all select part_number, lang, 'unsupported', null, null, null, count(*), string_agg(record_id, ',' order by record_id) from x anti join e using (part_number, lang) group by 1,2
 union all select null, lang, 'duplicate_ident', null, null, k, count(*), string_agg(record_id, ',' order by record_id) from known where k is not null group by lang, k having count(*)>1)"""


def _edition_records(f):
    both = f["expectations"].filter("part_number <> 1").select("*", F.explode(F.array(F.lit("en"), F.lit("te"))).alias("lang"))
    return f["records"].filter("lang in ('en', 'te')"), both, ("lang",)


@query("q5_completeness_lists", f"with {_LISTS} select * from lists")
def _q5l(f):
    rows = L.completeness_lists(*_edition_records(f))
    whole = rows.groupBy("part_number", "lang", "kind", "low", "high", c("key").alias("k"), "n").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return whole.withColumn("ids", F.when(F.size("ids") > 0, F.array_join(F.array_sort("ids"), ",")))


_ENTRY = "low || ':' || n || ':' || ids"


@query("q5_completeness_report", f"""with {_LISTS}, per as (select part_number, lang, coalesce(sum(n) filter (kind='missing'), 0)::bigint missing_count, string_agg(low || '-' || high, ',' order by low) filter (kind='missing') missing,
 string_agg({_ENTRY}, ';' order by low) filter (kind='duplicate') duplicate, string_agg({_ENTRY}, ';' order by low) filter (kind='unexpected') unexpected, string_agg(ids, ',' order by ids) filter (kind='invalid') invalid from lists where part_number is not null and kind<>'unsupported' group by 1,2),
 n as (select part_number, lang, count(*) record_count, count(*) filter (s between serial_start and serial_end) valid_count from known group by 1,2)
 select e.part_number, e.lang, e.serial_end-e.serial_start+1::bigint expected_count, coalesce(record_count, 0) record_count, coalesce(valid_count, 0) valid_count, e.serial_end-e.serial_start+1-coalesce(missing_count, 0) unique_expected_count, coalesce(missing_count, 0) missing_count,
 coalesce(missing, '') missing, coalesce(duplicate, '') duplicate, coalesce(unexpected, '') unexpected, coalesce(invalid, '') invalid, per.part_number is null as complete from e left join per using (part_number, lang) left join n using (part_number, lang)""")
def _q5r(f):
    out = L.completeness_report(*_edition_records(f))
    entry = lambda r: F.concat_ws(":", r["serial"], r["n"], F.array_join(r["ids"], ","))
    return out.withColumns(
        {
            "missing": F.array_join(F.transform("missing", lambda r: F.concat_ws("-", r["low"], r["high"])), ","),
            "duplicate": F.array_join(F.transform("duplicate", entry), ";"),
            "unexpected": F.array_join(F.transform("unexpected", entry), ";"),
            "invalid": F.array_join("invalid", ","),
        }
    )


@query("q5_edition_verdict", f"""with {_LISTS}, against as (select lang, count(distinct k) filter (kind='duplicate_ident') duplicate_idents, coalesce(sum(n) filter (kind='unsupported'), 0)::bigint unsupported from lists group by 1)
 select ed.lang, (select count(*) from known where known.lang=ed.lang) record_count, coalesce(duplicate_idents, 0) duplicate_idents, coalesce(unsupported, 0) unsupported, not exists (select 1 from lists where lists.lang=ed.lang) as complete from ed left join against using (lang)""")
def _q5v(f):
    given = _edition_records(f)
    return L.edition_verdict(L.completeness_report(*given), L.completeness_lists(*given))


@query("q6_suspicious_ident_lists", f"with x as (select part_number, lang, record_id, {_ident('ident')} k, {_serial('serial_number')} s from fx_records) select part_number, lang, k as ident, string_agg(distinct s::varchar, ',' order by s::varchar) serials, count(*) n, string_agg(record_id, ',' order by record_id) ids from x where k is not null group by 1,2,3 having count(distinct s)>1")
def _q6l(f):
    texts = F.array_join(F.array_sort(F.transform("serials", lambda s: s.cast("string"))), ",")
    return L.suspicious_ident_lists(f["records"]).select("part_number", "lang", "ident", texts.alias("serials"), "n", F.array_join("ids", ",").alias("ids"))


@query("d14_house_members", f"select doc_id, part_number, {_house('house')} as house_key, min(record_id) representative, count(*) n, string_agg(record_id, ',' order by record_id) members from fx_records where ({_house('house')}) is not null group by 1,2,3")
def _d14m(f):
    return L.house_members(f["records"]).select("doc_id", "part_number", "house_key", "representative", "n", F.array_join("members", ",").alias("members"))


_SERIAL_ROWS = f"""active as (select r.part_number, r.lang edition, r.record_id, trim(r.serial_number) t, {_serial('r.serial_number')} n0 from fx_records r join fx_documents d on d.doc_id=r.doc_id and d.active_version),
 elected as (select r.part_number, 'canonical' edition, min(record_id) record_id, n0::varchar t, n0 from active r join fx_expectations e on e.part_number=r.part_number and n0 between serial_start and serial_end where edition='en' group by r.part_number, n0 having count(*)=1),
 own as (select a.*, case when n0 between serial_start and serial_end then n0 end n from (select * from active union all select * from elected) a join fx_expectations e using (part_number)),
 met as (select part_number, edition, n, case when n is null then coalesce(nullif(t, ''), '[missing]') end o, count(*) k, string_agg(record_id, ',' order by record_id) ids from own group by 1,2,3,4),
 every as (select e.part_number, v.edition, unnest(generate_series(serial_start, serial_end)) n from fx_expectations e cross join (values ('en'),('te'),('ur'),('canonical')) v(edition)),
 srows as (select part_number, edition, n::varchar serial_number, case when k is null then 'missing' when k>1 then 'duplicate' else 'ok' end serial_status, coalesce(k, 0) occurrence_count, coalesce(ids, '') source_record_ids, '0:' || lpad(n::varchar, 12, '0') page_cursor from every left join met using (part_number, edition, n)
  union all select part_number, edition, o, 'unexpected', k, ids, '1:' || o from met where n is null)"""


def _most_rows(f, editions):
    """Every slot of each edition and every record: no report of them has more rows."""
    slots = f["expectations"].agg(F.sum(c("serial_end") - c("serial_start") + 1)).first()[0] or 0
    return editions * slots + f["records"].count()


def _serial_page(f, *args):
    path = io.scratch_dir(f.spark, "serials")
    linked = R.link_records(R.active_records(f["records"], f["documents_roll"]), f["expectations"])
    G.write_paged(L.serial_rows(*_roll(f), R.elect_canonical(linked)), path, C.SERIAL_CURSOR, ("part_number", "edition", "serial_status"), 8, _most_rows(f, 4))
    return C.serial_page(f.spark, path, *args).withColumn("source_record_ids", F.array_join("source_record_ids", ",")).drop("chunk")


for _name, _args in (("q3_serial_page_edition", (2, "te", "all", 100, ("0:000000000450", 0))), ("q3_serial_page_duplicates", (1, "te", "duplicate", 20, None)), ("q3_serial_page_unexpected", (2, "te", "unexpected", 7, ("1:S2", 0))), ("q3_serial_page_canonical", (2, None, "missing", 30, ("0:000000000100", 0)))):
    _where = f"part_number={_args[0]} and edition='{_args[1] or 'canonical'}'" + (f" and serial_status='{_args[2]}'" if _args[2] != "all" else "") + (f" and page_cursor>'{_args[4][0]}'" if _args[4] else "")
    query(_name, f"with {_SERIAL_ROWS}, q as (select * from srows where {_where}) select *, (select count(*) from q) as total_count from q order by page_cursor limit {_args[3]}")(lambda f, x=_args: _serial_page(f, *x))


_ONE = lambda x: ", ".join(f"{x}.{k} {x}_{k}" for k in C.DETAILS)
_DETAIL = f"""own as (select r.*, d.revision_id, nullif(upper(trim(r.ident)),'') i, {_house('r.house')} h, nullif(lower(trim(r.gender)),'') g, case when ({_serial('r.serial_number')}) between e.serial_start and e.serial_end then {_serial('r.serial_number')} end slot_serial
  from fx_records r join fx_documents d on d.doc_id=r.doc_id and d.active_version left join fx_expectations e on e.part_number=r.part_number where r.lang in ('en','te')),
 ranked as (select *, row_number() over (partition by part_number, slot_serial, lang order by created_at desc, record_id) rn, count(*) over (partition by part_number, slot_serial, lang) cnt from own where slot_serial is not null),
 {_SLOTS},
 paired as (select s.part_number, s.serial_no slot_serial, coalesce(en.cnt, 0) en_count, coalesce(te.cnt, 0) te_count, {_ONE('en')}, {_ONE('te')}, {', '.join(f"case when en.{k} is null or te.{k} is null then 'unavailable' when en.{k}=te.{k} then 'match' else 'mismatch' end {n}_evidence" for k, n in (('i', 'ident'), ('h', 'house'), ('age', 'age'), ('g', 'gender')))}
  from slots s left join ranked en on en.part_number=s.part_number and en.slot_serial=s.serial_no and en.lang='en' and en.rn=1 left join ranked te on te.part_number=s.part_number and te.slot_serial=s.serial_no and te.lang='te' and te.rn=1),
 detail as (select concat_ws(':', 'slot', part_number, slot_serial) row_key, part_number, slot_serial::varchar serial_number, slot_serial serial_sort, {_STATUS} status, coalesce(en_verification_status, te_verification_status) verification_status, * exclude (part_number, slot_serial) from paired
  union all by name select 'source:' || record_id row_key, part_number, serial_number, coalesce(case when regexp_full_match(serial_number, '[0-9]+') then try_cast(serial_number as int) end, {C.LAST_SERIAL}) serial_sort, 'unlinked_source' status, verification_status, (lang='en')::bigint en_count, (lang='te')::bigint te_count,
  {', '.join(f"case when lang='{x}' then {k} end {x}_{k}" for x in ('en', 'te') for k in C.DETAILS)}, {', '.join(f"'unavailable' {k}_evidence" for k in C.FIELDS)} from own where slot_serial is null),
 texts as (select *, lower(concat_ws(' ', part_number, serial_number, {', '.join(f"{x}_{k}" for x in ('en', 'te') for k in ('name', 'relation_name', 'house', 'ident'))})) search_text from detail)"""


def _evidence_page(f, *args):
    path = io.scratch_dir(f.spark, "evidence")
    G.write_paged(C.evidence_detail(*_roll(f)), path, C.EVIDENCE_CURSOR, ("part_number", "status"), 8, _most_rows(f, 1))
    page = C.evidence_page(f.spark, path, *args)
    flat = [c(f"{x}.{k}").alias(f"{x}_{k}") for x in ("en", "te") for k in C.DETAILS]
    return page.select(*[x for x in page.columns if x not in ("en", "te", "search_text")], *flat)


for _name, _args in (
    ("q10_evidence_page", (None, "all", None, 100, (2, 480, "slot:2:480"))),
    ("q10_evidence_page_unlinked", (2, "unlinked_source", None, 25, None)),
    ("q10_evidence_page_search", (None, "all", "  Place 7 ", 40, (1, 30, "slot:1:30"))),
    ("q10_evidence_page_conflicts", (1, "duplicate_source", "elder 3", 25, None)),
):
    _where = " and ".join(["true", *([f"part_number={_args[0]}"] if _args[0] else []), *([f"status='{_args[1]}'"] if _args[1] != "all" else []), *([f"contains(search_text, '{_args[2].strip().lower()}')"] if _args[2] else [])])
    _after = f"(part_number, serial_sort, row_key) > {_args[4]}" if _args[4] else "true"
    query(_name, f"with {_DETAIL}, q as (select * exclude (search_text) from texts where {_where}) select *, (select count(*) from q) as total_count from q where {_after} order by part_number, serial_sort, row_key limit {_args[3]}")(lambda f, x=_args: _evidence_page(f, *x))


@query("q13_release_report", f"""with {_DETAIL}, own_slots as (select record_id, part_number, slot_serial from own where slot_serial is not null),
 crit as (select part_number, slot_serial serial_sort, count(*) n from fx_issues i join own_slots using (record_id) where i.status='open' and i.severity='critical' group by 1,2),
 k as (select d.*, coalesce(crit.n, 0) n, en_count=0 and te_count=0 missing, en_count>1 or te_count>1 twice, en_record_id is not null and te_record_id is not null sourced, coalesce(en_verification_status='verified' and te_verification_status='verified', false) checked from detail d left join crit using (part_number, serial_sort) where status<>'unlinked_source'),
 g as (select part_number, count(*) filter (not missing and not twice) unique_slots, count(*) filter (not missing and not twice and sourced) sourced_slots, count(*) filter (not missing and not twice and checked) verified_slots, count(*) filter (not missing and not twice and status='reconciled') reconciled_slots, count(*) filter (missing) missing_slots, count(*) filter (twice) duplicate_slots,
  count(*) filter (not missing and not twice and not sourced) incomplete_slots, count(*) filter (not missing and not twice and not checked) unverified_slots, count(*) filter (not missing and not twice and status<>'reconciled') unreconciled_slots, coalesce(sum(n) filter (not missing and not twice), 0)::bigint critical_issues from k group by 1)
 select *, concat_ws(',', {', '.join(f"case when {k}>0 then '{k}' end" for k in C.BLOCKERS)}) blockers, {' and '.join(f'{k}=0' for k in C.BLOCKERS)} as ready from g""")
def _q13r(f):
    return C.release_report(*_roll(f), f["issues"]).withColumn("blockers", F.array_join("blockers", ","))


@query("q16_serial_gap_issues", f"with n as (select distinct doc_id, {_serial('serial_number')} n from fx_records where ({_serial('serial_number')}) is not null), g as (select doc_id, n, lag(n) over (partition by doc_id order by n) b from n) select doc_id, 'serial_gap' issue_type, 'Possible missing/unreadable serial ' || (b+1) || case when n-1>b+1 then '–' || (n-1) else '' end issue_detail, 'open' as status from g where n-b>1")
def _q16i(f):
    return Q.serial_gap_issues(f["records"])


# --- quality
_ACTIVE = f"active as (select r.*, {_serial('r.serial_number')} n, e.serial_start, e.serial_end from fx_records r join fx_documents d on d.doc_id=r.doc_id and d.active_version join fx_expectations e on e.part_number=r.part_number)"
def _q4_sql(edition: str | None) -> str:
    mine = f"d.lang='{edition}'" if edition else "true"
    docs = f"join fx_documents d on d.doc_id=p.doc_id and d.active_version and {mine}"
    n = _serial("r.serial_number")
    return f"""with {_SLOTS}, act as (select r.*, {n} n, {mine} mine, case when ({n}) between e.serial_start and e.serial_end then {n} end slot from fx_records r join fx_documents d on d.doc_id=r.doc_id and d.active_version left join fx_expectations e on e.part_number=r.part_number),
 canon as (select part_number, slot, min(verification_status) state from act where lang='en' and slot is not null group by 1,2 having count(*)=1),
 sc as (select part_number, n, count(*) k from act where mine and n is not null group by 1,2), src as (select * from act where mine)
 select (select sum(expected_total)::bigint from fx_expectations) expected_slots, (select count(*) from slots) active_slots,
 {"(select count(*) from slots s left join sc on sc.part_number=s.part_number and sc.n=s.serial_no where sc.k is null)" if edition else "(select count(*) from slots) - (select count(*) from canon)"} missing_serials,
 {"(select count(*) from sc where k>1)" if edition else "0::bigint"} duplicate_serial_groups, {"count(*) filter (slot is null)" if edition else "0::bigint"} unexpected_serials,
 (select count(*) from canon where state='verified') verified_slots, (select count(*) from slots) - (select count(*) from canon where state='verified') unverified_slots,
 count(*) source_records, count(slot) linked_records, count(*) filter (slot is null) reconciliation_conflicts,
 {', '.join(f"count(*) filter ({x} is null or trim({x}::varchar)='') null_{y}" for x, y in (("name", "name"), ("relation_name", "relation"), ("house", "house"), ("age", "age"), ("ident", "ident")))},
 (select count(*) from (select upper(trim(ident)) from src where trim(ident)<>'' group by 1 having count(distinct case when slot is not null then part_number || ':' || slot else 'source:' || record_id end)>1)) duplicate_ident_groups,
 (select coalesce(sum(records_detected),0)::bigint from fx_pages p {docs}) expected_cards, (select coalesce(sum(records_extracted),0)::bigint from fx_pages p {docs}) extracted_cards,
 (select count(*) from fx_pages p {docs} where status in ('failed','requires_review') or error_type is not null) failed_pages, (select count(*) from fx_pages p {docs} where records_detected>records_extracted) partial_pages,
 {', '.join(f"(select count(*) from fx_issues p {docs} where p.status='open' and severity='{x}') {x}_issues" for x in ('critical', 'needs_review', 'informational'))}
 from src"""


_Q4 = _q4_sql(None)


@query("q4_quality_summary", _Q4)
def _q4(f):
    return Q.quality_summary(*_roll(f), f["pages"], f["issues"])


@query("q4_quality_summary_edition", _q4_sql("te"))
def _q4b(f):
    return Q.quality_summary(*_roll(f), f["pages"], f["issues"], edition="te")


@query("e17_coverage_floor", f"with {_SCOPE_ALL}, p as (select lang, count(distinct part_number*1000+slot_serial) n from scope group by 1), t as (select sum(expected_total) n from fx_expectations) select min(round(coalesce(p.n,0)::decimal(20,4)/t.n*100, 1))::decimal(18,1) least_pct, (select null_name+null_relation+null_house+null_age+null_ident from (" + oracle(_Q4) + ")) missing_fields from (values ('en'),('te'),('ur')) v(l) cross join t left join p on p.lang=v.l")
def _e17(f):
    return Q.coverage_floor(C.edition_coverage(*_roll(f)), Q.quality_summary(*_roll(f), f["pages"], f["issues"]))


_pct = lambda a, b: f"case when {b} > 0 then round(greatest(0, least(100, {a}::decimal(20,4)/({b})*100)), 1) else 0 end::decimal(18,1)"
_issues_sum = "(critical_issues+needs_review_issues+informational_issues)"


@query("q12_quality_analytics", f"select {_pct('linked_records', 'source_records')} linked_pct, {_pct('extracted_cards', 'expected_cards')} extracted_pct, {', '.join(f'{_pct(s + "_issues", _issues_sum)} {s}_pct' for s in ('critical', 'needs_review', 'informational'))}, {', '.join(f'{_pct("null_" + x, "source_records")} missing_{x}_pct' for x in ('name', 'relation', 'house', 'age', 'ident'))}, concat_ws(',', case when missing_serials>0 then 'missing_serials' end, case when duplicate_serial_groups>0 then 'duplicate_serials' end, case when unexpected_serials>0 then 'unexpected_serials' end, case when duplicate_ident_groups>0 then 'duplicate_idents' end, case when failed_pages>0 then 'failed_pages' end, case when critical_issues>0 then 'critical_issues' end) as blockers from (" + oracle(_Q4) + ")")
def _q12(f):
    return Q.quality_analytics(Q.quality_summary(*_roll(f), f["pages"], f["issues"]))


@query("q14_document_integrity", "with s as (select doc_id, count(*) n from fx_records group by 1), d as (select doc_id, sum(records_extracted)::bigint n from fx_pages group by 1) select coalesce(s.doc_id, d.doc_id) doc_id, coalesce(s.n,0) stored, coalesce(d.n,0) declared, coalesce(s.n,0)=coalesce(d.n,0) as agrees from s full join d on d.doc_id=s.doc_id")
def _q14(f):
    return Q.document_integrity(f["records"], f["pages"])


_person = f"case when {_norm('name')}<>'' and {_norm('house')}<>'' then concat_ws('|', {_norm('name')}, {_norm('relation_name')}, regexp_replace({_norm('house')}, '\\s*/\\s*', '/', 'g'), coalesce(age::varchar,'')) end"


@query("q15_duplicate_marking", f"with k as (select record_id, doc_id, nullif(ident,'') i, {_person} p from fx_records) select record_id, (i is not null and count(*) over (partition by doc_id, i) > 1) or (p is not null and count(*) over (partition by doc_id, p) > 1) as probable_duplicate from k")
def _q15(f):
    return Q.duplicate_marking(f["records"])


_VOTE = "v as (select doc_id, detected_language, count(*) n, min(page) first from fx_pages where detected_language is not null group by 1,2), w as (select * from (select *, row_number() over (partition by doc_id order by n desc, first) k from v) where k=1), vote as (select d.doc_id, coalesce(w.detected_language, d.lang) lang, coalesce(w.n, 0) votes from fx_documents d left join w on w.doc_id=d.doc_id)"


@query("q18_document_rollup", f"with {_VOTE}, p as (select doc_id, count(*) filter (status in ('processed','requires_review')) processed_pages, count(*) filter (status='requires_review') review_pages, count(*) filter (error_type='page_persistence_failed') lost_pages from fx_pages group by 1), r as (select doc_id, count(*) records, count(*) filter (verification_status='requires_review') review_records from fx_records group by 1), g as (select doc_id, count(*) serial_issues from (select doc_id, n - lag(n) over (partition by doc_id order by n) d from (select distinct doc_id, {_serial('serial_number')} n from fx_records where ({_serial('serial_number')}) is not null)) where d>1 group by 1), z as (select d.doc_id, vote.lang, d.expected_total, coalesce(processed_pages,0) processed_pages, coalesce(review_pages,0) review_pages, coalesce(lost_pages,0) lost_pages, coalesce(records,0) records, coalesce(review_records,0) review_records, coalesce(serial_issues,0) serial_issues from fx_documents d join vote using (doc_id) left join p using (doc_id) left join r using (doc_id) left join g using (doc_id)) select *, case when lost_pages>0 then 'interrupted' when review_pages>0 or review_records>0 or serial_issues>0 or records<>expected_total then 'completed_with_warnings' else 'completed' end as state from z")
def _q18(f):
    return Q.document_rollup(f["documents_roll"], f["pages"], f["records"], Q.serial_gaps(f["records"]).select("doc_id"))


_Q19 = "select doc_id, page + case when doc_id%11=0 then 20 else 0 end page, case when doc_id%5=0 then doc_id%7 end run_id, records_detected, records_extracted - case when page%13=0 then 99 else 0 end records_extracted, records_review + case when page%3=0 then records_extracted else 0 end records_review from fx_pages"


@query("q19_page_integrity", f"with p as ({_Q19}) select p.doc_id, p.page, case when d.doc_id is null then 'unknown_document' when p.page not between 1 and d.pages then 'page_outside_document' when p.run_id is not null then 'run_of_other_document' when records_detected not between 0 and 20 then 'too_many_records' when records_extracted not between 0 and records_detected then 'extracted_over_detected' when records_review not between 0 and records_extracted then 'review_over_extracted' end as violation from p left join (select * from fx_documents where doc_id%6<>0) d on d.doc_id=p.doc_id where d.doc_id is null or p.page not between 1 and d.pages or p.run_id is not null or records_detected not between 0 and 20 or records_extracted not between 0 and records_detected or records_review not between 0 and records_extracted")
def _q19(f):
    n = c("page")
    pages = f["pages"].select(
        "doc_id", (n + F.when(c("doc_id") % 11 == 0, 20).otherwise(0)).alias("page"), F.when(c("doc_id") % 5 == 0, c("doc_id") % 7).alias("run_id"), "records_detected",
        (c("records_extracted") - F.when(n % 13 == 0, 99).otherwise(0)).alias("records_extracted"), (c("records_review") + F.when(n % 3 == 0, c("records_extracted")).otherwise(0)).alias("records_review"),
    )
    runs = f["documents_roll"].select((c("doc_id") % 7).alias("run_id")).distinct().withColumn("doc_id", F.lit(-1))
    return Q.page_integrity(pages, f["documents_roll"].filter("doc_id % 6 <> 0"), runs, 20)


@query("e10_edition_vote", f"with {_VOTE} select * from vote")
def _e10(f):
    return Q.edition_vote(f["pages"], f["documents_roll"])


# --- demographics
_CANON = f"""{_ACTIVE}, canon as (select * from (select part_number, n slot_serial, record_id, age, case when age between 18 and 125 then age end valid_age, {_age('age')} age_group, {_gender('gender')} gender_group, {_house('house')} house_key, {_ident('ident')} ident_key, row_number() over (partition by part_number, n order by record_id) k from active where n between serial_start and serial_end and lang='en') where k=1)"""


@query("i1_insights", f"with {_CANON}, h as (select count(*) members from canon where house_key is not null group by part_number, house_key) select count(*) voters, {', '.join(f"count(*) filter (gender_group='{g}') {g}" for g in ('male', 'female', 'other', 'unknown'))}, count(valid_age) valid_ages, round(avg(valid_age), 1) mean_age, median(valid_age)::double median_age, min(valid_age) youngest, max(valid_age) oldest, (select count(*) from h) houses, (select max(members) from h) largest_house, (select round(avg(members), 1) from h) mean_house, (select count(*) from (select 1 from canon where ident_key is not null group by ident_key having count(*)>1)) duplicate_idents from canon")
def _i1(f):
    return Q.insights(Q.canonical_rows(*_roll(f)))


def _insights_sql(part: int | None = None, gender: str | None = None, age: str | None = None) -> str:
    """The report's figures one by one; arrays as texts."""
    inside = f"part_number={part}" if part is not None else "true"
    keep = [inside]
    if gender is not None:
        keep.append("gender_group in ('other','unknown')" if gender == "other_unknown" else f"gender_group='{gender}'")
    if age is not None:
        keep.append(f"age_group='{age}'")
    ident = "nullif(upper(regexp_replace(trim(ident), '\\s+', '', 'g')), '')"
    n = lambda where: f"(select count(*) from kept where {where})"
    house = lambda where: f"(select count(*) from houses where {where})"
    review = "status<>'verified' and (status='requires_review' or open_issue)"
    ages = "||';'||".join(f"'{a}:'||{n(f"age_group='{a}'")}" for a in Q.AGES)
    sizes = "||';'||".join(f"'{k}:'||{house(w)}" for k, w in zip(Q.HOUSE_KEYS, ("m=1", "m=2", "m between 3 and 4", "m between 5 and 6", "m>=7")))
    return f"""with {_ACTIVE.replace("active as (", "active0 as (")}, active as (select * from active0 where {inside}),
 canon as (select * from (select part_number, n slot_serial, record_id, age, verification_status status, case when age between 18 and 125 then age end valid_age, {_age('age')} age_group, {_gender('gender')} gender_group, {_house('house')} house_key, {ident} ident_key, row_number() over (partition by part_number, n order by record_id) k from active where n between serial_start and serial_end and lang='en') where k=1),
 opened as (select a.part_number, a.n slot_serial, count(*) filter (i.severity='critical') critical from active a join fx_issues i on i.record_id=a.record_id and i.status='open' where a.n between serial_start and serial_end group by 1,2),
 kept as (select canon.*, o.part_number is not null open_issue, coalesce(o.critical, 0) critical from canon left join opened o using (part_number, slot_serial) where {' and '.join(keep)}),
 houses as (select part_number, house_key, count(*) m from kept where house_key is not null group by 1,2),
 e as (select * from fx_expectations where {inside}),
 per as (select e.part_number, e.expected_total, count(k.record_id) available, count(*) filter (gender_group='male') male, count(*) filter (gender_group='female') female, count(*) filter (gender_group in ('other','unknown')) other_unknown, round(avg(valid_age), 1) mean_age, min(valid_age) youngest, max(valid_age) oldest, count(distinct house_key) houses, count(*) filter (status='verified') verified, count(*) filter ({review}) review from e left join kept k using (part_number) group by 1,2)
 select (select sum(expected_total)::bigint from e) expected_total, {n('true')} available_total, {', '.join(f"{n(f"gender_group='{g}'")} {c}" for g, c in (('male', 'male_total'), ('female', 'female_total'), ('other', 'other_total'), ('unknown', 'unknown_gender_total')))},
 {n('valid_age is not null')} valid_age_count, {n('age is null')} missing_age_count, {n('age is not null and valid_age is null')} invalid_age_count,
 (select round(avg(valid_age), 1) from kept) average_age, (select round(median(valid_age), 1)::double from kept) median_age, (select min(valid_age) from kept) youngest_age, (select max(valid_age) from kept) oldest_age,
 {house('true')} house_group_count, {house('m=1')} single_house_groups, {house('m=2')} two_house_groups, {house('m between 3 and 4')} three_four_house_groups, {house('m between 5 and 6')} five_six_house_groups, {house('m>=7')} seven_plus_house_groups,
 (select coalesce(max(m), 0) from houses) largest_house_group, (select round(avg(m), 1) from houses) average_voters_per_house,
 {n("status='verified'")} verified_total, {n(review)} needs_review_total, {n(f"status<>'verified' and not ({review})")} unverified_total,
 (select coalesce(sum(critical), 0)::bigint from kept) critical_issue_count, (select count(*) from (select 1 from kept where ident_key is not null group by ident_key having count(*)>1)) duplicate_ident_groups,
 {n("gender_group='unknown'")} missing_gender_count, {n('house_key is null')} missing_house_count, {n('ident_key is null')} missing_ident_count,
 (select sum(serial_end-serial_start+1)::bigint from e) - (select count(*) from canon) missing_serial_count,
 (select count(*) from active where lang in ('en','te') and not coalesce(n between serial_start and serial_end, false)) unexpected_serial_count,
 (select count(*) from (select 1 from active where lang in ('en','te') and n between serial_start and serial_end group by part_number, lang, n having count(*)>1)) duplicate_part_serial_groups,
 (select string_agg(concat_ws(':', part_number, expected_total, available, male, female, other_unknown, coalesce(mean_age::varchar, '-'), coalesce(youngest::varchar, '-'), coalesce(oldest::varchar, '-'), houses, verified, review), ';' order by part_number) from per) parts,
 {ages} as age_groups, {sizes} as house_groups, 1::bigint revision_count"""


def _insights(f, *filters):
    parts = F.transform("parts", lambda r: F.concat_ws(":", *[F.coalesce(r[k].cast("string"), F.lit("-")) for k in ("part", "expected", "available", "male", "female", "other_unknown", "average_age", "youngest_age", "oldest_age", "house_groups", "verified", "needs_review")]))
    counts = lambda name: F.array_join(F.transform(name, lambda r: F.concat_ws(":", r["key"], r["count"])), ";").alias(name)
    out = Q.insights_report(*_roll(f), f["issues"], *filters)
    return out.withColumns({"parts": F.array_join(parts, ";"), "age_groups": counts("age_groups"), "house_groups": counts("house_groups")})


for _name, _filters in (("i1_insights_report", ()), ("i1_insights_part_gender", (2, "other_unknown")), ("i1_insights_age", (None, "male", "36_45"))):
    query(_name, _insights_sql(*_filters))(lambda f, x=_filters: _insights(f, *x))


@query("i1_age_histogram", f"with {_CANON} select l as age_group, count(canon.record_id) n from (values {', '.join(f"('{a}')" for a in Q.AGES)}) v(l) left join canon on age_group=l group by 1")
def _i1a(f):
    return Q.age_histogram(Q.canonical_rows(*_roll(f)))


@query("i1_house_histogram", f"with {_CANON}, h as (select count(*) m from canon where house_key is not null group by part_number, house_key), s as (select case when m=1 then '1' when m=2 then '2' when m<=4 then '3_4' when m<=6 then '5_6' else '7_plus' end l, count(*) n from h group by 1) select v.l as house_size, coalesce(n, 0) n from (values {', '.join(f"('{a}')" for a in Q.HOUSES)}) v(l) left join s on s.l=v.l")
def _i1b(f):
    return Q.house_histogram(Q.canonical_rows(*_roll(f)))


@query("i1_part_breakdown", f"with {_CANON} select part_number, count(*) voters, count(*) filter (gender_group='male') male, count(*) filter (gender_group='female') female, count(distinct house_key) houses from canon group by 1")
def _i1c(f):
    return Q.part_breakdown(Q.canonical_rows(*_roll(f)))


@query("c2_demographic_filter", f"with {_CANON} select part_number, slot_serial from canon where gender_group in ('other','unknown') and age_group='26_35'")
def _c2(f):
    return Q.demographic_filter(Q.canonical_rows(*_roll(f)), None, "other_unknown", "26_35").select("part_number", "slot_serial")


@query("i2_canonical_aggregate", f"with {_CANON} select gender_group, age_group, count(*) n, count(distinct house_key) houses from canon group by 1,2")
def _i2(f):
    return Q.canonical_rows(*_roll(f)).groupBy("gender_group", "age_group").agg(F.count("*").alias("n"), F.countDistinct("house_key").alias("houses"))


@query("i3_dashboard_counts", "select case when age is null then 'missing' when age<=25 then '18-25' when age<=35 then '26-35' when age<=50 then '36-50' when age<=65 then '51-65' else '66+' end as age_band, count(*) records, count(*) filter (starts_with(lower(trim(gender)),'m')) m, count(*) filter (starts_with(lower(trim(gender)),'f')) f from fx_records group by 1")
def _i3(f):
    return Q.dashboard_counts(f["records"])


_HOUSE_TEXT = f"nullif(regexp_replace({_norm("coalesce(house, '')")}, '\\s*/\\s*', '/', 'g'), '')"
_GENDER_TEXT = _norm("coalesce(gender, '')")
_TOTALS = f"select {{part}} part_number, count(*) records, count(*) filter (starts_with(g,'m')) men, count(*) filter (starts_with(g,'f')) women, count(*) filter (g<>'' and not starts_with(g,'m') and not starts_with(g,'f')) others, count(*) filter (g='') no_gender, {', '.join(f"count(*) filter (band='{b}') as \"age_{b}\"" for b in Q.BANDS)}, count(*) filter (verification_status='verified') verified, count(*) filter (verification_status='requires_review') review, count(distinct case when h is not null then part_number || ':' || h end) houses, '{{scope}}' as scope from t"


@query("i3_dashboard_totals", f"with t as (select part_number, verification_status, {_GENDER_TEXT} g, {_HOUSE_TEXT} h, case when age is null then 'missing' when age<=25 then '18-25' when age<=35 then '26-35' when age<=50 then '36-50' when age<=65 then '51-65' else '66+' end band from fx_records) " + _TOTALS.format(part="null", scope="all") + " union all " + _TOTALS.format(part="part_number", scope="part") + " group by part_number")
def _i3t(f):
    return Q.dashboard_totals(f["records"])


@query("i4_house_groups", f"with {_CANON} select house_key, count(*) members, count(*) filter (gender_group='male') men, count(*) filter (gender_group='female') women from canon where house_key is not null group by 1 order by try_cast(house_key as int) nulls last, house_key limit 200")
def _i4(f):
    return Q.house_groups(Q.canonical_rows(*_roll(f)))


@query("i4_house_group_lists", f"with {_CANON}, g as (select house_key from canon where house_key is not null group by 1 order by try_cast(house_key as int) nulls last, house_key limit 200) select house_key, count(*) filter (gender_group='male') men, count(*) filter (gender_group='female') women, min(record_id) representative, count(*) n, string_agg(record_id, ',' order by record_id) members from canon join g using (house_key) group by 1")
def _i4l(f):
    rows = Q.house_group_lists(Q.canonical_rows(*_roll(f)))
    whole = rows.groupBy("house_key", "men", "women", "representative", "n").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members"))
    return whole.withColumn("members", F.array_join("members", ","))


@query("c8_house_filter", f"with {_CANON} select house_key, count(*) members from canon where contains(house_key, '9-9') group by 1")
def _c8(f):
    rows = Q.house_filter(Q.canonical_rows(*_roll(f)), " 9 - 9")
    return rows.groupBy("house_key").agg(F.count("*").alias("members"))


@query("c10_report_scope", f"with {_SCOPE} select lang, count(*) records from scope where part_number=3 and lang='te' group by 1")
def _c10(f):
    return Q.report_scope(C.part_edition_quality(*_roll(f)), 3, "te").select("lang", c("source_records").alias("records"))


@query("i5_comparable_revision", "select count(distinct revision_id)>1 as comparable, count(distinct revision_id) as revisions from fx_documents")
def _i5(f):
    return Q.has_comparable_revision(f["documents_roll"])


# --- review
_JOINED = "j as (select i.issue_id, i.issue_type, i.severity, i.status, i.issue_detail, i.created_at, i.record_id, d.active_version, coalesce(r.part_number, d.part_number) part_number, coalesce(r.lang, d.lang) lang, r.serial_number, r.name, r.relation_type, r.relation_name, r.house, r.age, r.gender, r.ident, r.verification_status, r.conf, d.filename, p.status page_status from fx_issues i join fx_documents d on d.doc_id=i.doc_id left join fx_records r on r.record_id=i.record_id left join fx_pages p on p.doc_id=i.doc_id and p.page=i.page)"
_SHOWN = ("issue_id", "issue_type", "severity", "record_id", "part_number", "lang", "serial_number", "name", "relation_type", "relation_name", "house", "age", "gender", "ident", "verification_status", "filename", "page_status", "created_at")
_FOUND = "contains(lower(concat_ws(' ', issue_type, issue_detail, part_number, serial_number, name, relation_name, house, ident, filename)), 'user 1')"


def _queue(f, **given):
    return V.review_queue(f["issues"], f["documents_roll"], f["records"], f["pages"], **given).select(*_SHOWN)


@query("v1_review_page", f"with {_JOINED}, x as (select * from j where status='open' and (record_id is null or issue_type in ('page_failure','missing_page','malformed_record','page_sequence')) and lang='te') select {', '.join(_SHOWN)}, (select count(*) from x) total from x order by created_at desc, issue_id desc limit 100 offset 10")
def _v1(f):
    found = V.review_queue_v1(f["issues"], f["documents_roll"], f["records"], f["pages"], category="pages", edition="te").select(*_SHOWN)
    return G.with_total(G.offset_page(found, [c("created_at").desc(), c("issue_id").desc()], 500, 10), found)


@query("v2_review_queue", f"with {_JOINED} select {', '.join(_SHOWN)} from j where active_version and status='open' and severity='critical' and {_FOUND}")
def _v2(f):
    return _queue(f, severity="critical", search=" USER 1")


@query("v2_review_page", f"with {_JOINED}, x as (select * from j where active_version and {_CATEGORY['house_number']}) select {', '.join(_SHOWN)}, (select count(*) from x) total from x where (created_at, issue_id) < (timestamp '2100-01-01', 0) order by created_at desc, issue_id desc limit 50")
def _v2b(f):
    import datetime

    found = _queue(f, status="all", category="house_number")
    return G.with_total(G.keyset_page(found, ["created_at", "issue_id"], (datetime.datetime(2100, 1, 1), 0), 50, descending=True), found)


@query("v3_issue_severity", "select issue_id, case when issue_type='low_confidence' then 'informational' when issue_type in ('page_failure','missing_page','malformed_record','possible_duplicate','serial_gap','page_sequence','missing_serial','duplicate_serial','unexpected_serial','duplicate_ident','card_count_mismatch','partial_page','reconciliation_conflict','verification_conflict') then 'critical' else 'needs_review' end as v from fx_issues")
def _v3(f):
    return f["issues"].select("issue_id", V.issue_severity(c("issue_type")).alias("v"))


_FACTS = "facts as (select issue_id, case issue_id%6 when 0 then 'low_ocr_confidence' when 1 then 'normalization_variance' when 2 then 'language_unavailable' when 3 then 'missing_serial' when 4 then 'partial_page' else 'house_number' end kind, case issue_id%5 when 0 then 'conflict' when 1 then null else 'confirmed' end identity_agreement, case issue_id%7 when 0 then 'conflict' when 1 then 'weak' else 'strong' end structured_agreement, issue_id%11=0 has_ident_conflict, issue_id%2=0 or issue_id%9=1 deterministic, issue_id%13<>0 values_kept from fx_issues)"


def _facts(f):
    n = c("issue_id")
    kind = F.when(n % 6 == 0, "low_ocr_confidence").when(n % 6 == 1, "normalization_variance").when(n % 6 == 2, "language_unavailable").when(n % 6 == 3, "missing_serial").when(n % 6 == 4, "partial_page").otherwise("house_number")
    facts = f["issues"].select(
        "issue_id", kind.alias("kind"), F.when(n % 5 == 0, "conflict").when(n % 5 != 1, "confirmed").alias("identity_agreement"), F.when(n % 7 == 0, "conflict").when(n % 7 == 1, "weak").otherwise("strong").alias("structured_agreement"),
        (n % 11 == 0).alias("has_ident_conflict"), ((n % 2 == 0) | (n % 9 == 1)).alias("deterministic"), (n % 13 != 0).alias("values_kept"), c("created_at").alias("resolved_at"),
        F.create_map(F.lit("detail"), c("issue_detail")).alias("original_values"), F.create_map(F.lit("detail"), F.lower("issue_detail")).alias("resulting_values"),
    )
    return facts.withColumns({f"has_{b}": F.lit(None).cast("boolean") for b in V.BLOCKERS if b != "ident_conflict"})


_BACKED = "kind='low_ocr_confidence' and identity_agreement='confirmed' and structured_agreement='strong'"


@query("v4_classify_issue", f"with {_FACTS} select issue_id, case when kind='missing_serial' then 'critical' when ({_BACKED}) or kind='language_unavailable' then 'informational' else 'needs_review' end severity_found, not coalesce(({_BACKED}) or kind='language_unavailable', false) as manual, case when kind='missing_serial' then 'identity_or_completeness' when {_BACKED} then 'corroborated' when kind='low_ocr_confidence' then 'not_corroborated' when kind='language_unavailable' then 'availability_only' else 'needs_person' end reason from facts")
def _v4(f):
    return V.classify_issue(_facts(f)).select("issue_id", "severity_found", "manual", "reason")


_PATH = "case when values_kept and not has_ident_conflict and identity_agreement='confirmed' and structured_agreement<>'conflict' then case when kind='low_ocr_confidence' and structured_agreement='strong' then 'structured_auto_verification' when kind='normalization_variance' and deterministic then 'deterministic_normalization' end end"


@query("v5_auto_resolution", f"with {_FACTS} select issue_id, ({_PATH}) is not null as auto, {_PATH} as path from facts")
def _v5(f):
    return V.auto_resolution(_facts(f)).select("issue_id", "auto", "path")


@query("v6_resolution_audit", f"with {_FACTS} select f.issue_id, 'auto_resolved' as action, {_PATH} as path, i.created_at as resolved_at, i.issue_detail as before, lower(i.issue_detail) as after from facts f join fx_issues i using (issue_id) where ({_PATH}) is not null")
def _v6(f):
    out = V.resolution_audit(V.auto_resolution(_facts(f)))
    return out.select("issue_id", "action", "path", "resolved_at", c("original_values.detail").alias("before"), c("resulting_values.detail").alias("after"))


_GIVEN = "g as (select issue_id, record_id, status, case issue_id%7 when 0 then 'reason_missing' when 1 then 'unknown_field' end early, issue_id%2=0 verify from fx_issues), ok as (select * from g where early is null and status='open' and record_id is not null)"


def _corrected(f):
    n = c("issue_id")
    values = F.create_map(F.when(n % 7 == 1, "colour").otherwise("house"), F.concat(F.lit("H"), n), F.lit("age"), F.when(n % 3 == 0, "77").otherwise("x"))
    given = f["issues"].select(n.alias("correction_id"), "issue_id", values.alias("values"), F.when(n % 7 == 0, "  ").otherwise(" seen ").alias("reason"), (n % 2 == 0).alias("verify"), n.alias("at"))
    return V.apply_corrections(f["records"], f["issues"], given)


@query("v7_apply_corrections", f"with {_GIVEN}, x as (select record_id, max(issue_id) n, max(verify::int)=1 v from ok group by 1) select r.record_id, r.house original_house, case when x.n is null then r.house else 'H' || x.n end house, case when x.n%3=0 then 77 else r.age end age, case when x.v then 'verified' else r.verification_status end verification_status from fx_records r left join x on x.record_id=r.record_id")
def _v7(f):
    return _corrected(f)["records"].select("record_id", "original_house", "house", "age", "verification_status")


@query("v7_corrected_issues", f"with {_GIVEN} select i.issue_id, case when ok.verify then 'resolved' else i.status end status, case when ok.verify then 'human_verified' when not ok.verify then 'human_correction' end resolution_type, case when ok.issue_id is not null then 'seen' end resolution_reason from fx_issues i left join ok using (issue_id)")
def _v7b(f):
    return _corrected(f)["issues"].select("issue_id", "status", "resolution_type", "resolution_reason")


@query("v7_refused_and_audit", f"with {_GIVEN} select issue_id, coalesce(early, case when status<>'open' then 'issue_not_open' else 'no_record' end) as what from g where early is not null or status<>'open' or record_id is null union all select issue_id, case when verify then 'review_corrected_and_verified' else 'review_correction_saved' end from ok")
def _v7c(f):
    out = _corrected(f)
    return out["rejected"].select("issue_id", c("rejected").alias("what")).unionByName(out["audit"].select("issue_id", c("action").alias("what")))


@query("v8_apply_verifications", "with v as (select issue_id, record_id from fx_issues where status='open' and issue_id%3=0 and record_id is not null) select record_id as id, case when record_id in (select record_id from v) then 'verified' else verification_status end as state from fx_records union all select issue_id::varchar, case when issue_id in (select issue_id from v) then 'resolved' else status end from fx_issues")
def _v8(f):
    out = V.apply_verifications(f["records"], f["issues"], f["issues"].filter("issue_id % 3 = 0").select("issue_id"))
    return out["records"].select(c("record_id").alias("id"), c("verification_status").alias("state")).unionByName(out["issues"].select(c("issue_id").cast("string").alias("id"), c("status").alias("state")))


@query("v9_auto_resolve", "select issue_id, case when status='open' and issue_type in ('page_failure','malformed_record') and exists (select 1 from fx_pages p where p.doc_id=i.doc_id and p.page=i.page and p.status='processed') then 'resolved' else status end as new_status from fx_issues i")
def _v9(f):
    return V.auto_resolve_reprocessed(f["issues"], f["pages"]).select("issue_id", "new_status")


@query("g8_recent_rows", "select issue_id, created_at from fx_issues order by created_at desc, issue_id desc limit 10")
def _g8(f):
    return Q.recent_rows(f["issues"].select("issue_id", "created_at"), "created_at", "issue_id")


@query("t5_new_issues", "select i.issue_id from fx_issues i where not exists (select 1 from fx_issues o where o.status='open' and o.doc_id=i.doc_id and o.issue_type=i.issue_type and o.issue_detail=i.issue_detail)")
def _t5(f):
    return V.new_issues(f["issues"], f["issues"]).select("issue_id")


# --- pages of results
@query("g1_offset_page", "select record_id, age from fx_records order by age desc, record_id offset 20 limit 100")
def _g1(f):
    return G.offset_page(f["records"].select("record_id", "age"), [c("age").desc(), c("record_id")], 1000, 20)


@query("g3_keyset_page", "select part_number, age, record_id from fx_records where (part_number, age, record_id) > (1, 30, '') order by 1,2,3 limit 50")
def _g3(f):
    return G.keyset_page(f["records"].select("part_number", "age", "record_id"), ["part_number", "age", "record_id"], (1, 30, ""), 50)


@query("g4_keyset_descending", "select created_at, issue_id from fx_issues where (created_at, issue_id) < (timestamp '2100-01-01', 0) order by 1 desc, 2 desc limit 50")
def _g4(f):
    import datetime

    return G.keyset_page(f["issues"].select("created_at", "issue_id"), ["created_at", "issue_id"], (datetime.datetime(2100, 1, 1), 0), 50, descending=True)


@query("g5_next_cursor", "select part_number, record_id from (select part_number, record_id from fx_records order by 1,2 limit 50) order by 1 desc, 2 desc limit 1")
def _g5(f):
    page = G.keyset_page(f["records"].select("part_number", "record_id"), ["part_number", "record_id"], None, 50)
    return G.next_cursor(page, ["part_number", "record_id"])


@query("f4_page_with_total", "select issue_id, (select count(*) from fx_issues where status='open') total from fx_issues where status='open' order by issue_id limit 20")
def _f4(f):
    whole = f["issues"].filter("status = 'open'").select("issue_id")
    return G.with_total(G.offset_page(whole, [c("issue_id")], 20), whole)


@query("g9_page_with_more", "select issue_id, true as has_more from fx_issues order by issue_id limit 20")
def _g9(f):
    return G.page_with_more(f["issues"].select("issue_id"), [c("issue_id")], 20)


# --- search
@query("s1_search_names", f"select p_partkey, score from (select p_partkey, case when {_norm('p_name')}='red widget' then 100.0 when contains({_norm('p_name')}, 'red widget') then 96.0 else round((len(list_intersect({_tri('p_name')}, {_tri("'red widget'")}))::double / len(list_distinct(list_concat({_tri('p_name')}, {_tri("'red widget'")}))))::decimal(10,6)*100, 1)::double end as score from part) where score >= 72")
def _s1(f):
    return S.search_names(f["part"].select("p_partkey", "p_name"), "p_name", "red widget").select("p_partkey", "score")


_tenths = lambda x, q: f"case when {x}='{q}' then 1000 when contains({x}, '{q}') then 960 else (select case when m>0 then (2000*k+m)//(2*m) else 0 end from (select len(list_intersect({_tri(x)}, {_tri(repr(q))})) k, len(list_distinct(list_concat({_tri(x)}, {_tri(repr(q))}))) m)) end"
_low = lambda x: f"lower(trim(coalesce({x},'')))"
_S1 = f"""t as (select r.*, {_tenths(_low('name'), 'person  77 of place 27')} a, {_tenths(_low('relation_name'), 'elder 47')} b from fx_records r join fx_documents d on d.doc_id=r.doc_id and d.active_version where r.lang='en'),
 x as (select *, ((2*(6*a+6*b)+12)//24/10)::decimal(18,1) match_score from t where a>=720 and b>=720)"""


@query("s1_search_records", f"with {_S1} select record_id, match_score, (select count(*) from x) total from x order by match_score desc, part_number, case when regexp_full_match(serial_number, '[0-9]+') then serial_number::int end nulls last, serial_number, record_id limit 100")
def _s1r(f):
    found = S.search_records(f["records"], f["documents_roll"], name=" Person  77 of Place 27", relation_name="Elder 47")
    return S.search_page(found, 100).select("record_id", "match_score", "total")


@query("s1_search_exact", f"select record_id, match_score::decimal(18,1) match_score from (select r.record_id, case when {_house('house')}='9' then 100.0 else 96.0 end match_score from fx_records r join fx_documents d on d.doc_id=r.doc_id and d.active_version where r.lang='te' and relation_type='Father' and lower(trim(gender))='female' and contains({_house('house')}, '9'))")
def _s1e(f):
    return S.search_records(f["records"], f["documents_roll"], edition="te", relation_type="Father", gender=" female", house="9", fuzzy=False).select("record_id", "match_score")


@query("s2_rank_exact", f"select record_id, round((100*8 + case when age=40 then 100 else greatest(85, 100-abs(age-40)*5) end*5 + 100*4)/17.0) as score, case when age=40 then 'exact' else 'partial' end as match_type from fx_records where part_number=2 and {_norm('house')}='9-9' and abs(age-40)<=30 and {_norm('gender')}='male'")
def _s2x(f):
    return S.rank_records(f["records"], {"part": 2, "house": "9 - 9", "age": 40, "gender": "MALE"}, tolerance=30).select("record_id", "score", "match_type")


@query("s2_rank_records")
def _s2(f):
    return S.rank_records(f["records"], {"name": "raama 12", "father": "Elder"}).select("record_id", "score", "match_type", F.array_join(F.transform("explanation", lambda e: e["kind"]), ",").alias("kinds"))


@query("s3_blocked_fuzzy_join", f"with n as (select distinct p_name t from part) select a.t left_text, b.t right_text, {_trisim('a.t', 'b.t')} similarity from n a, n b where {_trisim('a.t', 'b.t')} >= 0.9")
def _s3(f):
    return S.blocked_fuzzy_join(f["part"], f["part"], "p_name", "p_name", 0.9).withColumn("similarity", F.round("similarity", 6))


@query("s3_text_members", f"with n as (select distinct p_name t from part) select p_name as text, p_partkey as id from part where p_name in (select a.t from n a, n b where {_trisim('a.t', 'b.t')} >= 0.9)")
def _s3b(f):
    return S.text_members(f["part"], "p_partkey", "p_name", S.blocked_fuzzy_join(f["part"], f["part"], "p_name", "p_name", 0.9), "left")


# --- extraction tables
def _cards(f):
    r = f["records"]
    pairs = "stack(8, 'serial_number', serial_number, 'ident', ident, 'name', name, 'relation_name', relation_name, 'relation_type', relation_type, 'house', house, 'age', cast(age as string), 'gender', gender) as (field, value)"
    return r.selectExpr("record_id card_id", "conf/100 confidence", "'e1' engine", pairs)


@query("p8_build_records", f"select record_id card_id, try_cast(nullif(regexp_replace(serial_number, '[^0-9]', '', 'g'), '') as int) serial_no, ident, name, relation_name, relation_type, house, age, gender, round(conf/100, 6) confidence, 'e1' as engine, concat_ws(',', case when nullif(regexp_replace(serial_number, '[^0-9]', '', 'g'), '') is null then 'missing_serial' end, case when not coalesce(regexp_matches(ident, '{X.IDENT_SHAPE}'), false) then 'invalid_ident' end, case when not coalesce(age between 18 and 125, false) then 'invalid_age' end, case when {_suspicious('house')} then 'suspicious_house' end, case when conf/100 < 0.95 then 'low_confidence' end) as issues, issues<>'' as requires_review from fx_records")
def _p8(f):
    return P.build_records(_cards(f)).withColumn("issues", F.array_join("issues", ","))


@query("p10_issue_rows", f"with i as (select record_id card_id, unnest([case when nullif(regexp_replace(serial_number, '[^0-9]', '', 'g'), '') is null then 'missing_serial' end, case when not coalesce(regexp_matches(ident, '{X.IDENT_SHAPE}'), false) then 'invalid_ident' end, case when not coalesce(age between 18 and 125, false) then 'invalid_age' end, case when {_suspicious('house')} then 'suspicious_house' end, case when conf/100 < 0.95 then 'low_confidence' end]) issue_type from fx_records) select * from i where issue_type is not null")
def _p10(f):
    return P.issue_rows(P.build_records(_cards(f)))


@query("p9_page_batch", "select page as expected_page, count(*) filter (printed_page=page) kept, count(*) filter (printed_page<>page) isolated, count(*) cards from fx_pages group by 1")
def _p9(f):
    return P.page_batch(f["pages"].select(c("doc_id").alias("card_id"), c("printed_page").alias("page"), c("page").alias("expected_page")))


@query("p12_to_storage_row", f"select record_id, cast(({_serial('serial_number')}) as varchar) as serial_number, name, {_norm('name')} as normalized_name, house, {_house('house')} as normalized_house, round((conf + case when age%7=0 then null else 50 end) / 2, 6) as both_conf, round(case when age%7=0 then conf else (conf+50)/2 end, 6) as conf, case when conf<75 then 'requires_review' else 'unverified' end as verification_status, round(conf, 6) as name_confidence, case when age%7<>0 then 50.0::double end as age_confidence, cast(null as double) as house_confidence, 'r-' || (part_number%3) as revision_id, case when conf<75 then 'low_confidence' else '' end as codes from fx_records")
def _p12(f):
    r = f["records"]
    text = lambda name, house: F.struct(name.alias("name"), c("relation_type"), c("relation_name"), house.alias("house"), c("gender"), c("ident"))
    found = r.select(
        "record_id", "doc_id", "part_number", X.parse_serial(c("serial_number")).alias("serial_no"), "lang", "page", c("page").alias("printed_page"), F.lit(1).alias("card_index"), "age", c("name").alias("card_text"), F.lit(None).cast("string").alias("box"),
        text(c("name"), c("house")).alias("raw"), text(X.norm_text(c("name"), ascii_only=False), X.house_key(c("house"))).alias("normalized"),
        F.create_map(F.lit("name"), c("conf") / 100, F.lit("age"), F.when(c("age") % 7 != 0, 0.5)).alias("confidence"),
        (c("conf") < 75).alias("requires_review"), F.lit("cards").alias("method"), F.lit("p1").alias("parser_version"), F.concat(F.lit("r-"), c("part_number") % 3).alias("revision_id"), F.array_compact(F.array(F.when(c("conf") < 75, "low_confidence"))).alias("issue_codes"),
    )
    rows = P.to_storage_row(found)
    return rows.select("record_id", "serial_number", "name", "normalized_name", "house", "normalized_house", F.round((c("name_confidence") + c("age_confidence")) / 2, 6).alias("both_conf"), F.round("conf", 6).alias("conf"), "verification_status", F.round("name_confidence", 6).alias("name_confidence"), "age_confidence", "house_confidence", "evidence.revision_id", F.array_join("evidence.issue_codes", ",").alias("codes"))


@query("p11_page_status", "with k as (select doc_id*100+page page, record_id card_index, case when age%29=0 then 'failed' when age%23=0 then 'requires_review' else 'extracted' end state from fx_records where page is not null) select page, case when count(*) filter (state<>'extracted')>0 then 'requires_review' when page%2=0 then 'completed_with_warnings' else 'completed' end as status, string_agg(state, ',' order by card_index) as states from k group by 1")
def _p11(f):
    state = F.when(c("age") % 29 == 0, "failed").when(c("age") % 23 == 0, "requires_review").otherwise("extracted")
    cards = f["records"].filter("page is not null").select((c("doc_id") * 100 + c("page")).alias("page"), c("record_id").alias("card_index"), state.alias("state"))
    return P.page_status(cards, cards.select("page").distinct().filter("page % 2 = 0"))


@query("p13_check_outcomes", "select doc_id card_id, status field, 'attempts_not_contiguous' as violation from fx_pages group by 1,2 having list_sort(list(distinct page)) <> range(1, count(*)+1)")
def _p13(f):
    return P.check_outcomes(f["pages"].select(c("doc_id").alias("card_id"), c("status").alias("field"), c("page").alias("attempt"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("error")))


@query("p14_check_cards", "select doc_id page, printed_page card_index, 'order' as violation from (select *, row_number() over (partition by doc_id order by page) k from fx_pages) where k <> printed_page")
def _p14(f):
    return P.check_cards(f["pages"].select(c("doc_id").alias("page"), c("printed_page").alias("card_index"), c("page").alias("grid_row"), F.lit(0).alias("grid_col"), F.lit(1).alias("width"), F.lit(1).alias("height")))


@query("p15_run_manifest", "select doc_id job_id, case when doc_id%2=0 then '1,2,3' else '1,2,3,4' end as pages from fx_documents")
def _p15(f):
    jobs = f["documents_roll"].select(c("doc_id").alias("job_id"), F.when(c("doc_id") % 2 == 0, F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(1))).alias("pages"), F.lit(4).alias("total_pages"), F.lit(None).cast("string").alias("version"))
    return P.run_manifest(jobs).select("job_id", F.array_join("pages", ",").alias("pages"))


@query("p1_parse_blocks")
def _p1(f):
    r = f["records"]
    line = F.concat(F.coalesce("serial_number", F.lit("")), F.lit(". Name: Person "), c("part_number"), F.lit("\nFather Name: Elder\nHouse No: "), F.coalesce("house", F.lit("1")), F.lit("\nAge: "), c("age"), F.lit("\nGender: Male\n"))
    pages = r.groupBy(c("doc_id").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("text"))
    return P.parse_blocks(pages)


def _words(f):
    """Every numbered record as a word in the cell of its serial, 30 to a page."""
    rows = R.once(f["records"], n=X.parse_serial(c("serial_number")))
    n = c("n")
    cell = (n - 1) % 30
    page = c("doc_id").cast("long") * 1000 + F.floor((n - 1) / 30)
    left, top = (cell % 3) * 200, 32 + F.floor(cell / 3) * 94
    box = {"x0": left + 5, "y0": top + 2, "x1": left + 40, "y1": top + 12}
    return rows.filter(n >= 1).select(page.alias("page_id"), c("serial_number").alias("text"), c("conf"), *[v.cast("double").alias(k) for k, v in box.items()])


_CELL = f"doc_id::bigint*1000 + (({_serial('serial_number')})-1)//30 page_id, ((({_serial('serial_number')})-1)%30)::int as cell"


@query("p2_columnize")
def _p2(f):
    return P.columnize(_words(f), 600.0)


@query("p3_grid_cards")
def _p3(f):
    w = _words(f)
    label = w.select("page_id", F.concat(F.lit("Name: "), c("text")).alias("text"), "conf", "x0", (c("y0") + 40).alias("y0"), "x1", (c("y1") + 40).alias("y1"))
    return P.grid_cards(w.unionByName(label.filter("text not like '%7%'")), 600.0, 1000.0).select("page_id", "cell", "text", c("confidence.name").alias("name_confidence"))


@query("p4_grid_codes", f"select {_CELL}, min(serial_number) serial, null::varchar as ident, round(avg(conf)) as conf from fx_records where ({_serial('serial_number')}) >= 1 group by 1,2")
def _p4(f):
    return P.grid_codes(_words(f), 600.0, 1000.0)


@query("p5_layout_segments")
def _p5(f):
    w = _words(f)
    return P.layout_segments(w.withColumn("text", F.when(F.crc32("text") % 2 == 0, "Name:").otherwise(c("text"))), 600.0, 1000.0).select("page_id", "col", "at", "x", "y", "width", "height", F.array_join(F.map_keys("confidence"), ",").alias("labels"))


@query("p6_choose_layout", "with l as (select doc_id, len(regexp_extract_all(text, '(?im)(?:^|\\n)\\s*(?:\\[?\\d{1,4}\\]?[.)-]?\\s*)?(?:Name)\\s*:'))::int n from documents) select doc_id page_id, case doc_id%3 when 0 then 'grid' when 1 then 'columns' else case when n>0 then 'raw' else 'grid' end end as layout, case when doc_id%3<2 then n+1 else n end as labels from l")
def _p6(f):
    t, n = c("text"), c("doc_id") % 3
    more = lambda k: F.when(n == k, F.concat(t, F.lit("\nName: x"))).when(n == 2, F.lit("")).otherwise(t)
    return P.choose_layout(f["documents"].select(c("doc_id").alias("page_id"), more(0).alias("grid"), more(1).alias("columns"), t.alias("raw")))


@query("p7_backfill_codes", f"select {_CELL}, min(serial_number) serial from fx_records where ({_serial('serial_number')}) >= 1 group by 1,2")
def _p7(f):
    codes = P.grid_codes(_words(f), 600.0, 1000.0)
    bare = codes.select("page_id", "cell", F.lit(None).cast("string").alias("serial"), F.lit(None).cast("string").alias("ident"))
    return P.backfill_codes(bare, codes).select("page_id", "cell", "serial")


@query("a13_scan_words", "select part_number field_id, string_agg(record_id, ' ' order by record_id) as value, avg(conf/100) filter (conf>=0) as confidence from fx_records where trim(record_id)<>'' group by 1")
def _a13(f):
    tsv = f["records"].select(c("part_number").alias("field_id"), F.lit(1).alias("line"), c("record_id").alias("word_no"), F.lit(5).alias("level"), c("record_id").alias("text"), "conf")
    return P.scan_words(tsv)


@query("b36_field_boxes", "select doc_id card_id, 'house' as field, floor(page + 100*0.25)::bigint x0, floor(5 + 40*0.5)::bigint y0, ceil(page + 100*(0.25+0.5))::bigint x1, ceil(5 + 40*(0.5+0.25))::bigint y1 from fx_pages")
def _b36(f):
    cards = f["pages"].select(c("doc_id").alias("card_id"), c("page").alias("x"), F.lit(5).alias("y"), F.lit(100).alias("width"), F.lit(40).alias("height"))
    t = cards.sparkSession.createDataFrame([("house", 0.25, 0.5, 0.5, 0.25)], "field string, rx double, ry double, rw double, rh double")
    return P.field_boxes(cards, t)


# --- evaluation
@query("k2_ground_truth_coverage", "select p as part_number, l as lang, count(g.case_id) cases, count(g.case_id)>=480 as target_met from (select distinct part_number p from fx_gold) cross join (values ('en'),('te')) v(l) left join fx_gold g on g.part_number=p and g.lang=l group by 1,2")
def _k2(f):
    return K.ground_truth_coverage(f["gold"], f["gold"])


@query("k1_validate_ground_truth", "select part_number, serial_number, lang, case when not regexp_matches(ident, '^[A-Z]{3}[0-9]{7}$') then 'ident_format' when try_cast(serial_number as int) < 1 then 'serial' end as violation from fx_gold where not regexp_matches(ident, '^[A-Z]{3}[0-9]{7}$') or try_cast(serial_number as int) < 1")
def _k1(f):
    return K.validate_ground_truth(f["gold"])


_gold_forms = {"serial_number": "nullif(regexp_replace({}, '[^0-9]', '', 'g'), '')", "age": "nullif(regexp_replace({}, '[^0-9]', '', 'g'), '')", "ident": "nullif(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), '')", **{k: "nullif(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), '')" for k in ("name", "relation_name", "relation_type", "gender")}, "house": "nullif(trim(regexp_replace({}, '\\s+', ' ', 'g')), '')"}
_KEYED = "j as (" + " union all ".join(f"select o.config_id, o.case_id, g.lang, g.part_number, o.failure_code, '{k}' field, coalesce({v.format('g.' + k)},'') g, coalesce({v.format('o.' + k)},'') p from fx_gold g join fx_observations o using (case_id) where g.{k} is not null" for k, v in _gold_forms.items()) + ")"


@query("k3_exact_accuracy", f"with {_KEYED} select config_id, field, count(*) cases, count(*) filter (g=p and g<>'') correct, count(*) filter (p='') missing, count(*) filter (p<>'' and g<>p) incorrect, count(*) filter (field='ident' and p<>'' and not regexp_matches(p, '^[A-Z]{{3}}[0-9]{{7}}$')) bad_idents, round(avg(case when field='age' then abs(try_cast(p as int)-try_cast(g as int)) end), 6) age_mae from j group by 1,2")
def _k3b(f):
    return K.field_metrics(f["gold"], f["observations"]).select("config_id", "field", "cases", "correct", "missing", "incorrect", "bad_idents", "age_mae")


# edits by words: each different word of the pair stands for one letter; edits by characters lie in ASCII parts only
_split = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w<>'')"
_coded = lambda x: f"array_to_string(list_transform({_split(x)}, lambda w: chr((47+list_position(list_distinct(list_concat({_split('g')}, {_split('p')})), w))::int)), '')"
_text = "field in ('name','relation_name')"
_FIELD_FIGURES = f"""count(*) cases, count(*) filter (g=p and g<>'') correct, count(*) filter (p<>'' and g<>p) incorrect, count(*) filter (p='') missing, count(*) filter (p='' and failure_code is not null) failures,
 round(count(*) filter (g=p and g<>'')/count(*), 6) accuracy, round(sum(levenshtein(g, p)) filter ({_text})/sum(length(g)) filter ({_text}), 6) cer, round(sum(levenshtein({_coded('g')}, {_coded('p')})) filter ({_text})/sum(len({_split('g')})) filter ({_text}), 6) wer,
 count(*) filter (field='ident' and p<>'' and not regexp_matches(p, '^[A-Z]{{3}}[0-9]{{7}}$')) bad_idents, count(case when field='age' then try_cast(p as int)-try_cast(g as int) end) parseable_ages, round(avg(case when field='age' then abs(try_cast(p as int)-try_cast(g as int)) end), 6) age_mae"""


@query("k3_field_metrics", f"with {_KEYED} select config_id, field, {_FIELD_FIGURES} from j group by 1,2")
def _k3(f):
    return K.field_metrics(f["gold"], f["observations"])


_SCOPED = f"m as (select config_id, 'overall' scope, field, {_FIELD_FIGURES} from j group by 1,3 union all select config_id, 'language:' || lang, field, {_FIELD_FIGURES} from j group by config_id, lang, field)"


@query("k3_metrics_by_edition", f"with {_KEYED}, {_SCOPED} select * from m")
def _k3e(f):
    return K.field_metrics_by_edition(f["gold"], f["observations"])


_CARDS = f"cards as (select config_id, case_id, lang, part_number, count(*) evaluated, count(*) filter (p='') as empty from j group by all), w as (select c.*, o.retry_count, o.runtime_ms, o.memory_mb, concat({', '.join(f"coalesce({v.format('o.' + k)}, '')" for k, v in _gold_forms.items())})<>'' as good from cards c join fx_observations o using (config_id, case_id))"
_CARD_FIGURES = "count(*) cases, count(*) filter (good) successful, count(*) filter (not good) extraction_failures, sum(evaluated)::bigint evaluated_fields, sum(w.empty)::bigint empty_fields, count(*) filter (retry_count>0) retried, round(count(*) filter (retry_count>0)/count(*), 6) retry_rate, sum(runtime_ms) runtime_ms, max(memory_mb) memory_mb"


@query("k4_aggregate_metrics", f"with {_KEYED}, {_CARDS} select config_id, lang, part_number, {_CARD_FIGURES} from w group by grouping sets ((config_id), (config_id, lang), (config_id, part_number))")
def _k4(f):
    return K.aggregate_metrics(f["gold"], f["observations"])


_swapped = "len(list_filter(range(1, length(g)+1), lambda i: upper(substr(g,i,1)) || upper(substr(p,i,1)) in ('O0','0O','I1','1I','S5','5S','B8','8B','Z2','2Z')))>0"
_plain = lambda x: f"regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')"


@query("k5_error_classes", f"with {_KEYED} select config_id, field, error, count(*) n from (select *, case when g=p and g<>'' then null when regexp_matches(coalesce(failure_code,''), 'crop|layout|geometry') then 'crop_layout_issue' when regexp_matches(coalesce(failure_code,''), 'parse|invalid') then 'field_parser_rejection' when p='' then 'empty' when replace(g,' ','')=replace(p,' ','') then 'spacing' when {_plain('g')}={_plain('p')} then 'punctuation' when length(g)=length(p) and {_swapped} then 'digit_letter_confusion' when lang='te' and field in ('name','relation_name') then 'script_confusion' else 'wrong_character' end error from j) where error is not null group by 1,2,3")
def _k5(f):
    return K.error_classes(f["gold"], f["observations"])


@query("k6_retry_impact", "with a as (select g.case_id, g.ident=coalesce(a.ident,'') x, g.ident=coalesce(b.ident,'') y, 'ident' field from fx_gold g join fx_observations a on a.case_id=g.case_id and a.config_id='a' join fx_observations b on b.case_id=g.case_id and b.config_id='b' union all select g.case_id, g.age=a.age, g.age=b.age, 'age' from fx_gold g join fx_observations a on a.case_id=g.case_id and a.config_id='a' join fx_observations b on b.case_id=g.case_id and b.config_id='b') select field, count(*) filter (not x) failed, count(*) filter (not x and y) recovered, count(*) filter (not x and not y) still_failed, count(*) filter (x and not y) broken from a group by 1")
def _k6(f):
    return K.retry_impact(f["gold"], f["observations"], "a", "b").filter("field in ('ident', 'age')")


_RANKED = f"""{_SCOPED}, ranks as (select *, row_number() over (order by ident_accuracy desc, serial_number_accuracy desc, telugu_name_accuracy desc, mean_accuracy desc, runtime_ms, config_id) place from (
 select config_id, coalesce(max(accuracy) filter (scope='overall' and field='ident'), -1) ident_accuracy, coalesce(max(accuracy) filter (scope='overall' and field='serial_number'), -1) serial_number_accuracy, coalesce(max(accuracy) filter (scope='language:te' and field='name'), -1) telugu_name_accuracy,
 round(coalesce(avg(accuracy) filter (scope='overall'), -1), 6) mean_accuracy, (select sum(runtime_ms) from fx_observations o where o.config_id=m.config_id) runtime_ms from m group by config_id))"""


@query("k7_rank_configs", f"with {_KEYED}, {_RANKED} select * from ranks")
def _k7(f):
    return K.rank_configs(f["gold"], f["observations"])


@query("k8_check_observations", "select case_id, config_id, 'retry_not_allowed' as violation from fx_observations where config_id='b' and retry_count>0")
def _k8(f):
    return K.check_observations(f["gold"], f["observations"], ["b"])


@query("k8_every_violation", """with o as (select case_id, case when case_id%50=0 then 'z' else config_id end config_id, retry_count from fx_observations where case_id%40<>0 union all select case_id, config_id, retry_count from fx_observations where case_id%45=0 union all select case_id+1000000, config_id, retry_count from fx_observations where case_id%60=0)
 select case_id, config_id, 'retry_not_allowed' violation from o where config_id='b' and retry_count>0 union all select case_id, config_id, 'repeated' from o group by 1,2 having count(*)>1 union all select case_id, config_id, 'unknown_case' from o where case_id not in (select case_id from fx_gold) union all select case_id, config_id, 'unknown_config' from o where config_id='z'
 union all select g.case_id, k.config_id, 'missing_case' from fx_gold g cross join (values ('a'),('b')) k(config_id) anti join o on o.case_id=g.case_id and o.config_id=k.config_id""")
def _k8e(f):
    o = f["observations"].select("case_id", "config_id", "retry_count")
    odd = o.filter("case_id % 40 <> 0").withColumn("config_id", F.when(c("case_id") % 50 == 0, "z").otherwise(c("config_id")))
    odd = odd.unionByName(o.filter("case_id % 45 = 0")).unionByName(o.filter("case_id % 60 = 0").withColumn("case_id", c("case_id") + 1_000_000))
    return K.check_observations(f["gold"], odd, ["b"], ["a", "b"])


@query("p14_page_counts", """with p as (select doc_id page, max(records_extracted) + 1 candidate_count, (count(*) + case when doc_id%3=0 then 1 else 0 end)::int validated_count from fx_pages where doc_id%7<>0 group by doc_id), n as (select doc_id page, count(*) n from fx_pages group by 1),
 r as (select coalesce(p.page, n.page) page, case when p.page is null then 'unknown_page' when candidate_count not between 0 and 30 then 'candidates' when validated_count<>coalesce(n, 0) then 'count' when validated_count>candidate_count then 'over_candidates' end violation from p full join n on n.page=p.page) select * from r where violation is not null""")
def _p14c(f):
    pages = f["pages"].filter("doc_id % 7 <> 0").groupBy(c("doc_id").alias("page")).agg((F.max("records_extracted") + 1).alias("candidate_count"), F.count("*").alias("_n"))
    pages = pages.select("page", "candidate_count", (c("_n") + F.when(c("page") % 3 == 0, 1).otherwise(0)).cast("int").alias("validated_count"))
    return P.check_page_counts(pages, f["pages"].select(c("doc_id").alias("page")))


_BOUNDS = dict(accuracy={"ident": 0.9, "age": 0.8, "name": 0.5}, cer={"name": 0.05, "ident": 0.5}, wer={"name": 0.3}, languages=("te", "xx"), failure_rate=0.001, empty_rate=0.05, runtime_per_card=12.5)
_POLICY = "pol as (select * from (values " + ", ".join([f"('{s}', '{k}', '{m}', {v})" for s in ("overall", "language:te", "language:xx") for m in ("accuracy", "cer", "wer") for k, v in _BOUNDS[m].items()] + [f"('overall', null, '{m}', {_BOUNDS[m]})" for m in K.CARD_METRICS]) + ") v(scope, field, metric, bound))"
_BREACHES = f"""{_KEYED}, {_RANKED}, {_CARDS}, {_POLICY}, c as (select config_id, {_CARD_FIGURES} from w group by 1),
 long as ({' union all '.join(f"select config_id, scope, field, '{k}' metric, {k} as value from m" for k in K.FIELD_METRICS)} union all select config_id, 'overall', null, 'failure_rate', extraction_failures/cases from c union all select config_id, 'overall', null, 'empty_rate', empty_fields/evaluated_fields from c union all select config_id, 'overall', null, 'runtime_per_card', runtime_ms/cases from c),
 held as (select k.config_id, pol.*, long.value, case when value is null then 'is unmeasured' when pol.metric='accuracy' and value<bound then 'is below policy' when pol.metric<>'accuracy' and value>bound then 'exceeds policy' end verdict from (select distinct config_id from fx_observations) k cross join pol left join long on long.config_id=k.config_id and long.scope=pol.scope and long.field is not distinct from pol.field and long.metric=pol.metric),
 breaches as (select *, concat_ws(' ', scope, field, case metric {' '.join(f"when '{k}' then '{v}'" for k, v in (K.FIELD_METRICS | K.CARD_METRICS).items())} end, verdict) reason from held where verdict is not null)"""


@query("k9_policy_breaches", f"with {_BREACHES} select config_id, scope, field, metric, bound::double as bound, round(value, 6) as value, reason from breaches")
def _k9p(f):
    return K.policy_breaches(f["gold"], f["observations"], K.policy_rows(f.spark, **_BOUNDS)).withColumn("value", F.round("value", 6))


@query("k9_gate_candidates", f"with {_BREACHES}, b as (select config_id, string_agg(reason, ', ' order by reason) blockers from breaches group by 1), g as (select r.config_id, place, coalesce(blockers, '') blockers, blockers is null as eligible from ranks r left join b using (config_id)) select *, coalesce(place=(select min(place) from g where eligible), false) as selected from g")
def _k9(f):
    return K.gate_candidates(f["gold"], f["observations"], K.policy_rows(f.spark, **_BOUNDS))


@query("k9_evidence_blockers", """with g as (select count(*) cards, count(*) filter (lang='en') en, count(*) filter (lang='te') te, coalesce(list_sort(list(distinct part_number) filter (part_number is not null)), []) parts from fx_gold), o as (select count(distinct config_id) configs from fx_observations)
 select 'verified case count is below the policy minimum' as blocker from g where cards < 1000000 union all select 'English coverage is missing' from g where en = 0 union all select 'Telugu coverage is missing' from g where te = 0
 union all select 'coverage is not of the required parts' from g where parts <> [1, 2, 3] union all select 'too few configurations were measured' from o where configs < 3""")
def _k9e(f):
    return K.evidence_blockers(f["gold"], f["observations"], [1, 2, 3], 1_000_000, 3)


@query("k10_report_checksum")
def _k10(f):
    return K.report_checksum(K.field_metrics(f["gold"], f["observations"]))


@query("k10_changed_buckets", "select config_id, field from fx_gold cross join (values ('a'),('b')) k(config_id) cross join (values ('age')) v(field) where false")
def _k10c(f):
    report = K.field_metrics(f["gold"], f["observations"])
    return K.changed_rows(report, K.verify_manifest(report.repartition(3), K.report_manifest(report))).select("config_id", "field")


@query("t4_resume_set", "select doc_id, page, case when status='processed' or (status='requires_review' and coalesce(error_type,'') not in ('page_processing_failed','page_persistence_failed')) then 'skip' when status='requires_review' then 'retry' else 'process' end as action from fx_pages")
def _t4(f):
    return T.resume_set(f["pages"])


@query("t1_check_batch", """with n as (select doc_id, page, count(*) n from fx_records group by 1,2), k as (select doc_id, page, count(*) k from fx_issues group by 1,2)
 select r.record_id, case when n.n > 30 or coalesce(k.k, 0) > 300 then 'batch_too_large' when r.part_number+case when r.age%31=0 then 1 else 0 end <> d.part_number then 'part_mismatch'
 when r.verification_status='verified' then 'not_unverified' when r.age%37=0 then 'linked_or_verified'
 when r.serial_number is not null and not coalesce(regexp_full_match(r.serial_number, '[0-9]+') and try_cast(r.serial_number as int) between e.serial_start and e.serial_end, false) then 'invalid_serial' end as refusal
 from fx_records r join n on n.doc_id is not distinct from r.doc_id and n.page is not distinct from r.page left join k on k.doc_id=r.doc_id and k.page=r.page join fx_documents d on d.doc_id=r.doc_id join fx_expectations e on e.part_number=d.part_number""")
def _t1c(f):
    rows = f["records"].withColumns({"part_number": c("part_number") + F.when(c("age") % 31 == 0, 1).otherwise(0), "slot_serial": F.when(c("age") % 37 == 0, 1)})
    return T.check_batch(rows, f["documents_roll"], f["expectations"], f["issues"]).select("record_id", "refusal")


@query("t1_judge_batch", "select record_id, case when age%2=0 then 'idempotent' when age%3=0 then 'rejected' else 'inserted' end as outcome from fx_records")
def _t1(f):
    rows = f["records"].select("record_id", *T.EVIDENCE)
    stored = rows.filter("age % 2 = 0").unionByName(rows.filter("age % 2 = 1 and age % 3 = 0").withColumn("age", c("age") + 1))
    return T.judge(rows, stored).select("record_id", "outcome")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLE)
