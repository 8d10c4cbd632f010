import glob
import os

import pytest
from pyspark.sql import functions as F
from rollcheck.functions import text as X
from rollcheck.operators import completeness as L
from rollcheck.operators import evaluate as K
from rollcheck.operators import paging as G
from rollcheck.operators import quality as Q
from rollcheck.operators import reconcile as C
from rollcheck.sources import io

RECORD = "part_number int, serial_number string, ident string, record_id string"


def test_missing_ranges_of_a_huge_part(spark):
    """A thousand million expected serials: the cost follows the records."""
    top = 1_000_000_000
    met = {1, 2, 65_535, 65_536, 65_537, 70_000, 131_071, 131_072, 5_000_000, 999_999_999}
    rows = [(1, str(n), None, f"r{n}") for n in met] + [(1, "5000000", None, "again"), (1, "0", None, "low"), (1, str(top + 1), None, "high"), (1, "x", None, "odd"), (1, None, None, "none")]
    rows += [(3, "1", None, "p3"), (9, "4", None, "far")]
    expectations = spark.createDataFrame([(1, 1, top), (2, 1, top), (3, 1, 1)], "part_number int, serial_start int, serial_end int")
    got = {r.part_number: r for r in L.completeness_report(spark.createDataFrame(rows, RECORD), expectations).collect()}
    want, before = [], 0
    for n in [*sorted(met), top + 1]:
        if n - before > 1:
            want.append((before + 1, n - 1))
        before = n
    one = got[1]
    assert [tuple(r) for r in one.missing] == want
    assert (one.record_count, one.valid_count, one.unique_expected_count, one.missing_count) == (len(met) + 5, len(met) + 1, len(met), top - len(met))
    assert [(r.serial, r.n, r.ids) for r in one.duplicate] == [(5_000_000, 2, ["again", "r5000000"])]
    assert [(r.serial, r.n, r.ids) for r in one.unexpected] == [(0, 1, ["low"]), (top + 1, 1, ["high"])]
    assert one.invalid == ["none", "odd"] and not one.complete
    assert [tuple(r) for r in got[2].missing] == [(1, top)] and not got[2].complete
    assert got[3].complete and not got[3].missing
    lists = L.completeness_lists(spark.createDataFrame(rows, RECORD), expectations)
    assert [(r.n, r.ids) for r in lists.filter("kind = 'unsupported'").collect()] == [(1, ["far"])]
    assert L.completeness_lists(spark.createDataFrame([], RECORD), expectations).count() == 3


def test_members_of_a_huge_group_are_many_rows(spark):
    rows = spark.range(25_000).selectExpr("case when id < 20000 then 'big' else concat('h', id) end as house", "cast(id as string) as record_id", "1 as doc_id", "1 as part_number")
    got = L.house_members(rows).cache()
    big = got.filter("house_key = 'big'").collect()
    assert {r.n for r in big} == {20_000} and {r.representative for r in big} == {"0"} and len(big) == 20
    assert max(len(r.members) for r in big) < 1.2 * L.MEMBERS
    assert sorted(m for r in big for m in r.members) == sorted(map(str, range(20_000)))
    assert got.filter("house_key <> 'big'").count() == 5_000
    keys = ["12", "3-12", "3-2", "3/5", "a", None, "", "10b", "10"]
    df = spark.createDataFrame([(k,) for k in keys if k], "house_key string")
    assert [r.house_key for r in df.orderBy(*L.house_order(F.col("house_key"))).collect()] == ["3-2", "3/5", "3-12", "10", "10b", "12", "a"]


def test_pages_read_their_ranges(spark, tmp_path):
    path = str(tmp_path / "paged")
    rows = spark.range(5_000).selectExpr("cast(id % 7 as int) as part_number", "cast(id as int) as at", "case when id % 3 = 0 then 'x' else 'y' end as kind")
    G.write_paged(rows, path, ["part_number", "at"], ("part_number", "kind"), 20)
    whole = sorted((r.part_number, r.at, r.kind) for r in rows.collect())
    after, seen = None, []
    while True:
        page = G.read_page(spark, path, ["part_number", "at"], 100, after, {"kind": "x"})
        got = [tuple(r) for r in page.collect()]
        if not got:
            break
        seen += got
        after = got[-1][:2]
    assert [g[:3] for g in seen] == [w for w in whole if w[2] == "x"] and {g[3] for g in seen} == {1667}
    middle = G.read_page(spark, path, ["part_number", "at"], 10, (3, 2500), {"kind": "y"}, remaining=True)
    assert {r.total_count for r in middle.collect()} == {sum(w > (3, 2500) and w[2] == "y" for w in whole)}
    read = spark.read.parquet(f"{path}/rows")
    folders = {f.split("page_range=")[1].split("/")[0] for f in read.inputFiles()}
    plan = middle._jdf.queryExecution().executedPlan().toString()
    assert len(folders) == 20 and "PartitionFilters: [" in plan and "page_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    found = G.read_page(spark, path, ["part_number", "at"], 10, None, {"part_number": 2}, F.col("at") % 100 == 2)
    assert [(r.at, r.total_count) for r in found.collect()] == [(w[1], sum(v[0] == 2 and v[1] % 100 == 2 for v in whole)) for w in whole if w[0] == 2 and w[1] % 100 == 2][:10]
    for wrong in ((1,), (1, None)):
        with pytest.raises(ValueError):
            G.read_page(spark, path, ["part_number", "at"], 10, wrong)
    with pytest.raises(ValueError):
        G.read_page(spark, path, ["part_number", "at"], 10, None, {"at": 1})
    with pytest.raises(ValueError):
        C.evidence_page(spark, path, status="odd")
    with pytest.raises(ValueError):
        C.serial_page(spark, path, 1, "xx")


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    io.upsert_into(spark.range(100).selectExpr("id as k", "0 as v", "cast(null as string) as note"), path, ["k"], 8)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    before = files()
    change = spark.createDataFrame([(7, 1, "a"), (7, 2, None), (500, 3, "b")], "k long, v int, note string")
    for _ in range(2):
        io.upsert_into(change, path, ["k"], 8)
        got = {r.k: (r.v, r.note) for r in spark.read.parquet(path).collect()}
        assert got == {k: (0, None) for k in range(100)} | {7: (2, None), 500: (3, "b")}
    touched = {r.b for r in change.selectExpr("cast(pmod(xxhash64(k), 8) as int) as b").collect()}
    kept = {f: t for f, t in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept.items() <= files().items()
    io.upsert_into(spark.createDataFrame([(7, 9, "z"), (501, 9, "z")], "k long, v int, note string"), path, ["k"], 8, keep_old=True)
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert got[7] == 2 and got[501] == 9 and len(got) == 102


def test_word_distance_beyond_a_byte(spark):
    words = [f"w{k}" for k in range(300)]
    one = words[:150] + ["other"] + words[151:]
    rows = [(" ".join(words), " ".join(one), 1), (" ".join(words), " ".join(reversed(words)), 300), (" ".join(words), " ".join(words[1:]), 1), ("", "a  b", 2), ("é ñ", "é ñ", 0)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert [r.d for r in df.select(X.token_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [n for _, _, n in rows]


def test_manifest_locates_a_change(spark):
    report = spark.range(500).selectExpr("id", "cast(id * 2 as string) as v", "case when id % 2 = 0 then 1 end as w")
    frozen = K.report_manifest(report).cache()
    assert K.verify_manifest(report.orderBy(F.rand(1)).repartition(5), frozen).count() == 0
    assert K.manifest_root(frozen).first() == K.manifest_root(K.report_manifest(report.orderBy(F.desc("id")))).first()
    changed = report.withColumn("v", F.when(F.col("id") == 77, "odd").otherwise(F.col("v")))
    different = K.verify_manifest(changed, frozen)
    assert 1 <= different.count() <= 2
    assert 77 in {r.id for r in K.changed_rows(changed, different).collect()}
    assert K.manifest_root(K.report_manifest(changed)).first().sha256 != K.manifest_root(frozen).first().sha256


def test_wrong_filters_are_refused(spark):
    rows = spark.createDataFrame([(1, "male", "18_25")], "part_number int, gender_group string, age_group string")
    for part, gender, age in ((None, "other", None), (None, None, "20")):
        with pytest.raises(ValueError):
            Q.demographic_filter(rows, part, gender, age)
    with pytest.raises(ValueError):
        Q.check_demographics(9, None, None, rows)


def test_insights_scan_records_once(spark):
    from rollcheck.sources.bindings import frames

    f = frames(spark, "/root/testdata/sf0.001")
    plan = Q.insights_report(f["records"], f["documents_roll"], f["expectations"], f["issues"].select("record_id", "status", "severity"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # the issues' view looks the first record of an order up, by its own scan of two key columns
    assert sum("l_suppkey" in line and "l_linestatus" in line and "Relation" in line for line in text.splitlines()) == 2
