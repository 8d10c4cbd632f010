"""Work that must not grow with a large expectation, table or group."""

import duckdb
from pyspark.sql import functions as F
from rollcheck.operators import extraction, paging, reconcile, registry, search
from rollcheck.plans import registered
from rollcheck.streaming import ingest

from test_units import base


def test_links_list_no_slots(spark):
    """A part of 2**31 - 1 expected serials: links, conflicts and service results cost what the records cost."""
    rec, docs, exp = base(spark)
    huge = exp.withColumn("serial_end", F.lit(2**31 - 1))
    assert sorted((r.slot_serial, r.en_id, r.te_id, r.decision) for r in reconcile.edition_links(rec, docs, huge).collect()) == [(1, "a", "b", "verified"), (2, "c", "d", "needs_review")]
    assert sorted(r.record_id for r in reconcile.unmatched_records(rec, docs, huge).collect()) == ["e", "g"]
    assert [(r.kind, r.record_ids) for r in reconcile.edition_conflicts(rec, docs, huge).collect()] == [("structural_conflict", ["g"])]
    assert sorted((r.slot_serial, r.status) for r in reconcile.service_results(rec, docs, huge).collect()) == [(1, "reconciled"), (2, "reconciled"), (3, "source_missing")]
    r = reconcile.service_batches(rec, docs, huge).first()
    assert (r.evaluated, r.reconciled, r.source_missing, r.unlinked) == (3, 2, 1, 1)


def test_blockers_sql_on_many_cards(spark, tmp_path):
    """Each blocker stands alone: with a million cards the others remain."""
    con = duckdb.connect()
    con.sql(f"copy (select x::bigint p_partkey, 'a b' p_name, 'T' p_type, 'Brand' p_brand, 1 p_size from range(1000000) t(x)) to '{tmp_path}/part.parquet' (format parquet)")
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    for t in ("orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = sorted(con.sql(registered.oracle_sql()["k9_evidence_blockers"]).fetchall())
    got = sorted(tuple(r) for r in registered.queries()["k9_evidence_blockers"](spark, str(tmp_path)).collect())
    assert got == want == [("coverage is not of the required parts",), ("too few configurations were measured",)]


def test_slots_of_one_partition_are_dealt_out(spark):
    """Expectations in one partition become slots in several, and keys with a null meet none of the other side."""
    exp = spark.range(0, 64).selectExpr("cast(id as int) part_number", "1 serial_start", "10 serial_end").coalesce(1)
    slots = registry.expected_slots(exp)
    assert slots.rdd.getNumPartitions() > 1 and slots.count() == 640
    pair = spark.createDataFrame([(1, 1), (1, None), (1, 1)], "a int, b int")
    assert sorted(map(str, registry.compare_sets(pair, pair, ["a", "b"]).collect())) == sorted(["Row(a=1, b=1, in_expected=True, in_observed=True)", "Row(a=1, b=None, in_expected=True, in_observed=False)", "Row(a=1, b=None, in_expected=False, in_observed=True)"])


SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_parse_a_serial_once(spark):
    """However often a cell's place is referred to, a serial is parsed once for each reading of the records; lines are made once."""
    for name, readings in (("p4_grid_codes", 1), ("p7_backfill_codes", 2), ("p3_grid_cards", 2), ("p5_layout_segments", 1)):
        plan = plan_of(registered.queries()[name](spark, SF))
        assert plan.count("^[0-9]+$") == readings, name
        assert name == "p7_backfill_codes" or "Join" not in plan, name


def test_segments_of_columns_with_and_without_labels(spark):
    word = lambda text, y, x=5.0: (1, text, 80.0, x, y, x + 30.0, y + 10.0)
    words = [word("far", 10.0), word("near", 60.0), word("Name:", 100.0), word("b", 140.0), word("Name:", 200.0), word("c", 310.0), word("d", 330.0), word("bare", 50.0, 205.0)]
    rows = extraction.layout_segments(spark.createDataFrame(words, extraction.WORDS), 600.0, 1000.0).orderBy("at").collect()
    assert [(r.col, r["at"], r.y, r.height) for r in rows] == [(0, 105.0, 60.0, 90.0), (0, 205.0, 200.0, 120.0)]


def test_ranking_romanizes_and_compares_once(spark):
    df = spark.createDataFrame([("a", "రామ 12", "Father", "Elder 1"), ("b", "Somebody Else", "Father", "Elder")], "record_id string, name string, relation_type string, relation_name string")
    found = search.rank_records(df, {"name": "raama 12", "father": "Elder"})
    assert plan_of(found).count("levenshtein(") <= 8
    assert [(r.record_id, r.score, r.match_type) for r in found.collect()] == [("a", 94.0, "transliteration")]


def test_rules_read_a_batch_once(spark):
    """The batch is joined to its documents once; a page is too large by its own records or by issues, a null page too."""
    rec = [(f"r{i}", 1, 1, 1, str(i + 1), "unverified") for i in range(31)] + [("x", 1, 1, 2, "1", "unverified"), ("y", 1, 1, 3, "2", "unverified"), ("z", 1, 1, None, "3", "unverified")]
    rec = spark.createDataFrame(rec, "record_id string, doc_id long, part_number int, page int, serial_number string, verification_status string")
    docs = spark.createDataFrame([(1, 1, "en")], "doc_id long, part_number int, lang string")
    exp = spark.createDataFrame([(1, 1, 500)], "part_number int, serial_start int, serial_end int")
    issues = spark.range(602).selectExpr("1L doc_id", "case when id < 301 then 2 when id < 601 then 3 end page").filter("page = 2 or page is null").unionByName(spark.range(300).selectExpr("1L doc_id", "3 page"))
    out = ingest.check_batch(rec, docs, exp, issues)
    assert plan_of(out).count("LogicalRDD [record_id#") == 1
    assert {r.record_id: r.refusal for r in out.collect()} == {**{f"r{i}": "batch_too_large" for i in range(31)}, "x": "batch_too_large", "y": None, "z": None}


def test_ranges_of_a_paged_result_grow_with_its_rows(spark, tmp_path, monkeypatch):
    """A range is sorted in one task, so a larger result has more of them; pages and totals stay the same."""
    monkeypatch.setattr(paging, "RANGE_ROWS", 100)
    rows = spark.range(1000).selectExpr("id % 7 part", "id at")
    for name, known in (("counted", None), ("given", 1000)):
        path = str(tmp_path / name)
        paging.write_paged(rows, path, ["part", "at"], ("part",), 2, known)
        assert spark.read.parquet(f"{path}/directory").agg(F.max("page_range"), F.sum("n")).first()[:] == (9, 1000)
        page = paging.read_page(spark, path, ["part", "at"], 5, (3, 17), {"part": 3}).collect()
        assert [(r["at"], r.total_count) for r in page] == [(at, 143) for at in (24, 31, 38, 45, 52)]
