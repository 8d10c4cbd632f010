"""Literal cases of functions and operators."""

import uuid

import pytest
from pyspark.sql import functions as F
from rollcheck.functions import text as X
from rollcheck.operators import evaluate, extraction, paging, quality, reconcile, registry, review, search
from rollcheck.sources import io
from rollcheck.streaming import ingest


def one(spark, value, made, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(made(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, " Ａ  -  b ", X.norm_text) == "a-b"
    assert one(spark, "12 / A", X.norm_house) == "12/a"
    assert one(spark, "రాము", X.romanize) == "raamu"
    assert one(spark, "احمد", X.romanize) == "ahmd"
    assert one(spark, "సంరక్షకుడు", X.romanize) == "samrakshakudu"
    assert one(spark, "దుఃఖం", X.romanize) == "duhkham"
    assert one(spark, "José Ａb", X.romanize) == "jos ab"
    assert one(spark, None, X.romanize) == ""
    assert one(spark, "1-2/A", X.suspicious_house) is False and one(spark, "Photo Available", X.suspicious_house) is True
    assert one(spark, "మొత్తం ఓటర్లు: 1014", X.expected_total) == 1014
    assert one(spark, "తండ్రి", X.relation_type) == "Father"
    assert one(spark, "పురుషుడు", X.gender_group) == "male"
    assert one(spark, "abcడేటా కొత్త", X.detect_language).language == "te"
    assert one(spark, "౧౨౩", lambda c: X.norm_field(c, "serial_number")) == "123"
    assert one(spark, "k", lambda c: X.record_id(F.lit(str(uuid.NAMESPACE_DNS)), c)) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "k"))
    assert one(spark, '{"x":1,"y":2,"width":3,"height":4,"pageWidth":5,"pageHeight":6}', X.parse_box).width == 3
    assert one(spark, "1,2,3", X.parse_box) is None
    assert one(spark, "word", lambda c: F.round(X.trigram_similarity(c, F.lit("two words")) * 100, 1)) == 36.4
    assert one(spark, "one two three", lambda c: X.token_distance(c, F.lit("one too three four"))) == 2


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, doc_id int, part_number int, serial_number string, lang string, ident string, house string, age int, gender string, created_at date, conf double").withColumns(
        {"name": F.lit(None).cast("string"), "relation_name": F.lit(None).cast("string"), "relation_type": F.lit("Father"), "verification_status": F.lit("unverified"), "page": F.lit(1)}
    )


def base(spark):
    exp = spark.createDataFrame([(1, 1, 4, 4)], "part_number int, serial_start int, serial_end int, expected_total int")
    docs = spark.createDataFrame([(10, 1, "en", True, "r1"), (11, 1, "te", True, "r1"), (12, 1, "te", False, "r1")], "doc_id int, part_number int, lang string, active_version boolean, revision_id string")
    rec = records(
        spark,
        [
            ("a", 10, 1, "1", "en", "ABC0000001", "1", 30, "male", None, 99.0),
            ("b", 11, 1, "1", "te", "ABC0000001", "1", 30, "male", None, 99.0),
            ("c", 10, 1, "2", "en", None, None, 40, "male", None, 99.0),
            ("d", 11, 1, "2", "te", None, None, None, "male", None, 99.0),
            ("e", 10, 1, "3", "en", "X", "2", 50, "f", None, 99.0),
            ("f", 12, 1, "3", "te", "X", "2", 50, "f", None, 99.0),
            ("g", 10, 1, "x", "en", None, None, 20, None, None, 99.0),
        ],
    )
    return rec, docs, exp


def test_three_rule_sets_differ(spark):
    pairs = reconcile.pair_editions(*base(spark))
    get = lambda s: {r.slot_serial: r.v for r in pairs.select("slot_serial", s().alias("v")).collect()}
    assert get(reconcile.status_sql) == {1: "reconciled", 2: "needs_review", 3: "missing_te", 4: "missing_en"}
    assert get(reconcile.status_service) == {1: "reconciled", 2: "reconciled", 3: "source_missing", 4: "source_missing"}
    assert get(reconcile.status_client) == {1: "verified", 2: "needs_review", 3: "unmatched", 4: "unmatched"}


def test_counts_add_up(spark):
    rec, docs, exp = base(spark)
    s = reconcile.reconciliation_summary(rec, docs, exp).first()
    assert s.expected_total == 4 and s.unlinked_records == 1 and s.en_linked_slots == 3
    assert registry.registry_invariant(registry.expected_slots(exp), exp).first().holds
    gaps = quality.serial_gaps(rec.filter("serial_number <> '2'")).collect()
    assert [(g.doc_id, g.gap) for g in gaps] == [(10, "2")]


def test_evaluation_rates(spark):
    gold = spark.createDataFrame([(1, 1, "en", "1", "ABC0000001", "abcd", "20")], "case_id int, part_number int, lang string, serial_number string, ident string, name string, age string")
    obs = spark.createDataFrame([(1, "a", 0, 1.0, None, "1", None, "abce", "23")], "case_id int, config_id string, retry_count int, runtime_ms double, failure_code string, serial_number string, ident string, name string, age string")
    got = {r.field: r for r in evaluate.field_metrics(gold, obs).collect()}
    assert got["name"].cer == 0.25 and got["age"].age_mae == 3 and got["ident"].missing == 1
    kinds = {(r.field, r.error) for r in evaluate.error_classes(gold, obs).collect()}
    assert ("ident", "empty") in kinds and ("name", "wrong_character") in kinds


def test_pages_concatenate_to_whole(spark):
    df = spark.range(25).select((F.col("id") % 3).alias("a"), "id")
    got, after = [], None
    while rows := paging.keyset_page(df, ["a", "id"], after, 7).collect():
        got += [(r.a, r.id) for r in rows]
        after = got[-1]
    assert got == sorted((i % 3, i) for i in range(25))
    with pytest.raises(ValueError):
        paging.keyset_page(df, ["a", "id"], (1, None), 5)


def test_parse_blocks_and_columns(spark):
    text = "1. Name: Ravi Kumar\nFather Name: Suresh\nHouse No: 1-2\nAge: 34\nGender: Male\nABC1234567\n2. Name: Sita\nHouse No: Photo\nAge: 7\nGender: Female\n"
    rows = extraction.parse_blocks(spark.createDataFrame([(1, text)], "page_id long, text string")).collect()
    assert [(r.serial_no, r.name, r.house, r.age, r.ident, r.status) for r in rows] == [(1, "Ravi Kumar", "1-2", 34, "ABC1234567", "extracted"), (2, "Sita", None, None, None, "requires_review")]
    words = spark.createDataFrame([(1, "b", 90.0, 50.0, 0.0, 60.0, 10.0), (1, "a", 90.0, 5.0, 1.0, 20.0, 11.0), (1, "c", 90.0, 210.0, 0.0, 220.0, 10.0)], extraction.WORDS)
    assert extraction.columnize(words, 300.0).first().text == "a b\nc"


def test_corrections(spark):
    rec = base(spark)[0]
    issues = spark.createDataFrame([(1, "a", "open"), (2, "a", "open"), (3, "b", "open"), (4, "c", "resolved"), (5, None, "open"), (6, "zz", "open"), (7, "d", "open")], "issue_id int, record_id string, status string")
    given = spark.createDataFrame(
        [
            (1, 1, {"age": "31"}, "seen", False, 1), (2, 2, {"age": "32", "house": None}, " seen ", True, 2), (3, 3, {"house": "9"}, " ", True, 3), (4, 4, {"house": "9"}, "seen", True, 4),
            (5, 5, {"house": "9"}, "seen", True, 5), (6, 6, {"house": "9"}, "seen", True, 6), (7, 9, {"house": "9"}, "seen", True, 7), (8, 7, {"colour": "9"}, "seen", True, 8), (9, 7, {"house": "9"}, "x" * 501, True, 9),
        ],
        "correction_id int, issue_id int, values map<string,string>, reason string, verify boolean, at int",
    )
    out = review.apply_corrections(rec, issues, given)
    a = out["records"].filter("record_id = 'a'").first()
    assert (a.age, a.original_age, a.house, a.verification_status) == (32, 30, "1", "verified")
    assert {r.correction_id: r.rejected for r in out["rejected"].collect()} == {3: "reason_missing", 4: "issue_not_open", 5: "no_record", 6: "unknown_record", 7: "unknown_issue", 8: "unknown_field", 9: "reason_too_long"}
    assert {r.issue_id: (r.status, r.resolution_type) for r in out["issues"].filter("issue_id < 3").collect()} == {1: ("open", "human_correction"), 2: ("resolved", "human_verified")}
    assert {(r.correction_id, r.action) for r in out["audit"].collect()} == {(1, "review_correction_saved"), (2, "review_corrected_and_verified")}
    seen = review.apply_verifications(rec, issues, spark.createDataFrame([(3,), (4,), (5,)], "issue_id int"))
    assert {r.record_id for r in seen["records"].filter("verification_status = 'verified'").collect()} == {"b"}
    assert {r.issue_id for r in seen["issues"].filter("status = 'resolved'").collect()} == {3, 4}


def test_issue_policy(spark):
    ddl = "issue_id int, kind string, identity_agreement string, structured_agreement string, has_missing_record boolean, has_ident_conflict boolean, has_duplicate_identity boolean, has_structural_conflict boolean, deterministic boolean, values_kept boolean"
    no = [None] * 4
    rows = [
        (1, "low_ocr_confidence", "confirmed", "strong", *no, None, True),
        (2, "low_ocr_confidence", "confirmed", "weak", *no, None, True),
        (3, "missing_record", None, None, *no, None, None),
        (4, "normalization_variance", "confirmed", None, *no, True, True),
        (5, "normalization_variance", "confirmed", "conflict", *no, True, True),
        (6, "ident_conflict", "confirmed", "strong", *no, True, True),
        (7, "low_ocr_confidence", "confirmed", "strong", None, True, None, None, None, True),
        (8, "language_unavailable", None, None, *no, None, None),
        (9, "house_number", "confirmed", "strong", *no, True, True),
        (10, "low_ocr_confidence", "confirmed", "strong", *no, None, False),
    ]
    got = {r.issue_id: (r.severity_found, r.manual, r.path) for r in review.auto_resolution(spark.createDataFrame(rows, ddl)).collect()}
    assert got[1] == ("informational", False, "structured_auto_verification")
    assert got[2] == ("needs_review", True, None)
    assert got[3] == ("critical", True, None)
    assert got[4] == ("needs_review", True, "deterministic_normalization")
    assert got[8] == ("informational", False, None)
    assert [got[k][2] for k in (5, 6, 7, 9, 10)] == [None] * 5


def test_quarantine_ladder(spark):
    exp = base(spark)[2]
    rec = spark.createDataFrame([("a", 9, None), ("b", 9, "x"), ("c", 9, "1"), ("d", 1, "01"), ("e", 1, "2"), ("f", 1, "3"), ("g", 1, "1234567890"), ("h", 1, "")], "record_id string, part_number int, serial_number string")
    got = {r.record_id: r.quarantine_reason for r in registry.quarantine(rec, exp, F.col("record_id") == "f").collect()}
    odd = "unexpected_or_noncanonical_serial"
    assert got == {"a": "missing_serial", "b": "non_numeric_serial", "c": odd, "d": odd, "e": None, "f": "legacy_orphan", "g": odd, "h": "non_numeric_serial"}


def test_duplicates_need_the_same_person(spark):
    rows = [("a", "Ravi", "Suresh", "1-2", 30, None), ("b", "Sita", "Suresh", "1-2", 30, None), ("c", " RAVI ", "suresh", "1 - 2", 30, None), ("d", None, "x", "1-2", 30, "E"), ("e", "z", "y", None, 1, "E"), ("f", "Ravi", "Suresh", "1-2", 31, "")]
    rec = spark.createDataFrame([(r, 1, *v) for r, *v in rows], "record_id string, doc_id int, name string, relation_name string, house string, age int, ident string")
    assert {r.record_id for r in quality.duplicate_marking(rec).filter("probable_duplicate").collect()} == {"a", "c", "d", "e"}


def test_error_classes(spark):
    cases = [
        ("ABC0000001", "A8C0000001", "ident", "en", None, "digit_letter_confusion"), ("rama", "roma", "name", "te", None, "script_confusion"), ("rama", "roma", "name", "en", None, "wrong_character"),
        ("ra ma", "rama", "name", "en", None, "spacing"), ("rama", "rama.", "name", "en", None, "punctuation"), ("rama", "", "name", "en", "CROP_empty", "crop_layout_issue"),
        ("rama", "x", "name", "en", "parse_error", "field_parser_rejection"), ("rama", "", "name", "en", None, "empty"), ("rama", "rama", "name", "en", "crop", None),
    ]
    df = spark.createDataFrame(cases, "g string, p string, f string, l string, c string, want string")
    got = df.select("want", evaluate.error_class(*map(F.col, "gpflc")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_grid_cards_and_segments(spark):
    at = lambda text, x, y, conf=90.0: (1, text, conf, x, y, x + 20.0, y + 10.0)
    rows = [at("17", 5.0, 34.0, 80.0), at("abc1234567", 120.0, 35.0), at("Name:", 5.0, 70.0, 70.0), at("Ravi", 40.0, 72.0, 90.0), at("Age:", 5.0, 90.0, 50.0), at("30", 40.0, 90.0, 60.0), at("lone", 405.0, 500.0)]
    words = spark.createDataFrame(rows, extraction.WORDS)
    card = extraction.grid_cards(words, 600.0, 1000.0).collect()
    assert [(c.cell, c.text, c.confidence) for c in card] == [(0, "--- RECORD ---\nSerial Number: 17\nEPIC: ABC1234567\n17 abc1234567\nName: Ravi\nAge: 30", {"name": 80, "age": 55, "ident": 85})]
    more = spark.createDataFrame([*rows, at("Name:", 5.0, 170.0), at("Sita", 40.0, 170.0)], extraction.WORDS)
    found = extraction.layout_segments(more, 600.0, 1000.0).orderBy("at").collect()
    assert [(round(r["at"]), r.x, r.y, r.width, r.height) for r in found] == [(76, 5.0, 34.0, 135.0, 66.0), (175, 5.0, 170.0, 55.0, 10.0)]
    assert found[0].confidence == {"name": 80, "age": 55, "ident": 85} and found[1].confidence == {"name": 90}


def test_votes_rollup_resume(spark):
    docs = spark.createDataFrame([(1, "en", 2), (2, "te", None), (3, "en", 5)], "doc_id int, lang string, expected_total int")
    pages = spark.createDataFrame([(1, 1, "processed", None, "te"), (1, 2, "requires_review", "page_processing_failed", "en"), (1, 3, "requires_review", "low_text", None), (2, 1, "processed", None, None), (3, 1, "failed", "page_persistence_failed", None)], "doc_id int, page int, status string, error_type string, detected_language string")
    assert {r.doc_id: (r.lang, r.votes) for r in quality.edition_vote(pages, docs).collect()} == {1: ("te", 1), 2: ("te", 0), 3: ("en", 0)}
    rec = spark.createDataFrame([(1, "unverified"), (1, "unverified"), (2, "unverified")], "doc_id int, verification_status string")
    got = {r.doc_id: r.state for r in quality.document_rollup(docs, pages, rec, rec.limit(0)).collect()}
    assert got == {1: "completed_with_warnings", 2: "completed", 3: "interrupted"}
    assert {(r.doc_id, r.page): r.action for r in ingest.resume_set(pages).collect()} == {(1, 1): "skip", (1, 2): "retry", (1, 3): "skip", (2, 1): "skip", (3, 1): "process"}


def test_activation_keeps_an_edition(spark):
    rows = [(1, 1, "en", "completed", True), (2, 1, "en", "processing", False), (3, 1, "te", "processing", True), (4, 1, "te", "failed", False), (5, 2, "en", "completed", True), (6, 2, "en", "completed_with_warnings", False)]
    docs = spark.createDataFrame(rows, "doc_id int, part_number int, lang string, processing_status string, active_version boolean")
    assert {r.doc_id for r in registry.activate_version(docs, [F.col("doc_id").desc()]).filter("becomes_active").collect()} == {1, 3, 6}


def test_search_and_join(spark):
    df = spark.createDataFrame([(1, "ravi kumar"), (2, "ravi kumarr"), (3, "sita"), (4, "ravi kumar"), (5, "José"), (6, None)], "id int, n string")
    pairs = search.blocked_fuzzy_join(df, df, "n", "n", 0.7)
    assert {(r.left_text, r.right_text) for r in pairs.collect()} == {(a, b) for a in ("ravi kumar", "ravi kumarr") for b in ("ravi kumar", "ravi kumarr")} | {("sita", "sita"), ("José", "José")}
    assert {(r.text, r.id) for r in search.text_members(df, "id", "n", pairs, "left").collect()} == {("ravi kumar", 1), ("ravi kumar", 4), ("ravi kumarr", 2), ("sita", 3), ("José", 5)}


def test_rank_records(spark):
    rows = [("a", "Maria", "Father", "José", "1 / 2", 30, "F", "X1", "7"), ("b", "రాము", "Mother", "సీత", "3", 32, "M", "X2", "8"), ("c", None, "Father", "Ravi", None, None, None, None, None)]
    df = spark.createDataFrame([(r, 1, "en", *v) for r, *v in rows], "record_id string, part_number int, lang string, name string, relation_type string, relation_name string, house string, age int, gender string, ident string, serial_number string")
    get = lambda filters, **k: {r.record_id: (r.score, r.match_type, [e.field for e in r.explanation]) for r in search.rank_records(df, filters, **k).collect()}
    assert get({"name": "maria"}) == {"a": (100, "exact", ["name"])}
    assert get({"name": "raamu"}) == {"b": (92, "transliteration", ["name"])}
    assert get({"name": "Marja"}) == {"a": (80, "fuzzy", ["name"])} and get({"name": "Marja"}, fuzzy=False) == {}
    assert get({"father": "jos"}) == {"a": (96, "partial", ["father"])} and get({"mother": "jos"}) == {}
    assert get({"house": "1/2", "age": 32, "ident": "x1", "serial": "7"}, tolerance=2) == {"a": (98, "partial", ["house", "age", "ident", "serial"])}
    assert set(get({})) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        search.rank_records(df, {"colour": "red"})


def test_refused_parameters(spark):
    rec, docs, exp = base(spark)
    for call in (lambda: search.search_records(rec, docs, age=12), lambda: search.search_records(rec, docs, edition="xx"), lambda: review.review_queue(rec, docs, rec, status="gone"), lambda: quality.quality_summary(rec, docs, exp, rec, rec, edition="xx")):
        with pytest.raises(ValueError):
            call()


def test_files(spark, tmp_path):
    good = tmp_path / "g.csv"
    good.write_text("case_id,part_number,lang,serial_number,ident,name,age\n1,1,en,1,ABC0000001,x,20\n")
    assert io.read_ground_truth(spark, str(good)).count() == 1
    bad = tmp_path / "b.csv"
    bad.write_text("case_id,case_id\n1,2\n")
    with pytest.raises(ValueError):
        io.read_ground_truth(spark, str(bad))
    df = spark.createDataFrame([(1, [("en", "x")])], "id int, r array<struct<lang:string,v:string>>")
    io.export_csv(df, str(tmp_path / "csv"), "r")
    assert '"lang' in spark.read.text(str(tmp_path / "csv")).filter(F.col("value").contains("en")).first().value.replace("\\", "")
    assert io.export_json(df, str(tmp_path / "json")).first().rows == 1
    io.log_export(spark, str(tmp_path / "ledger"), "csv", 1, "completed")
    io.log_export(spark, str(tmp_path / "ledger"), "json", -2, "failed", "disk full", str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).first().action == "dataset.export.failed"
    io.export_csv(df, str(tmp_path / "by"), "r", ("en", "te"))
    assert spark.read.option("header", True).csv(str(tmp_path / "by")).columns == ["id", "en_r", "te_r"]
    quoted = tmp_path / "q.csv"
    quoted.write_text('"a,b",c\n1,2\n')
    assert io.read_ground_truth(spark, str(quoted), ["a,b", "c"]).first()["a,b"] == "1"
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    with pytest.raises(ValueError):
        io.log_export(spark, str(tmp_path / "ledger"), "xml", 1, "completed")


def test_registry_files_and_names(spark, tmp_path):
    spark.createDataFrame([(1, 5)], "part_number int, serial_start int").write.parquet(str(tmp_path / "expectations.parquet"))
    typed = io.load_registry(spark, str(tmp_path), {"expectations": io.REGISTRY["expectations"]})["expectations"]
    assert tuple(typed.first()) == (1, 5, None, None)
    files = [("AC-ENG-227-2024.pdf", 227, 227, "te"), ("AC-ENG-227-2024.pdf", 227, 227, None), ("x.pdf", 227, None, None), ("x.txt", 227, 227, "en"), ("AC-URD-228.pdf", 227, 228, "ur"), (None, 1, 1, "en")]
    got = io.inspect_filenames(spark.createDataFrame(files, "name string, declared_part int, detected_part int, declared_lang string")).collect()
    assert [r.refusal for r in got] == ["edition_conflict", None, "edition_unknown", "not_a_pdf", "part_conflict", "not_a_pdf"]
    assert [r.revision_year for r in got] == [2024, 2024, None, None, None, None]


def test_page_row(spark):
    row = extraction.to_page_row(spark.createDataFrame([(1, 3)], "page int, attempts int")).first()
    assert (row.retry_count, row.extraction_attempts) == (2, 3)
