"""Snapshot changes and orphan references on small tables."""

import datetime

from pyspark.sql import functions as F

from lexmill.functions.lookalike import consistent
from lexmill.functions.reading import as_read
from lexmill.operators.orphans import KEY, orphan_keys, orphan_references, orphan_report
from lexmill.operators.snapshot_diff import snapshot_changes
from lexmill.plans.general_problems import article_code
from lexmill.sources.tables import blank, trimmed

DAY = datetime.datetime(2024, 1, 1)
ROWS = "snap int, key string, body string, at timestamp, record_key string, h long"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, DAY if len(r) == 3 else r[3], "x", 1)[:4] + ("x", 1) for r in rows], ROWS)
    found = snapshot_changes(df, snapshot=F.col("snap"), key=F.col("key"), content=as_read("body"), loaded=F.col("at"))
    return sorted(map(tuple, found.collect()))


def test_added_removed_changed(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (2, "c", "n"), (4, "a", "z"), (4, "c", "n")]
    assert changes(spark, rows) == [(2, "a", "changed"), (2, "b", "removed"), (2, "c", "added")]


def test_same_reading_is_no_change(spark):
    one = "Điều 1.\nQuy định &ldquo;này&rdquo;  về đò"
    other = "Điều 1.\r\n\r\nQuy ðịnh “này” về đò"
    assert changes(spark, [(1, "a", one), (2, "a", other), (1, "b", None), (2, "b", "")]) == []


def test_repeated_rows_the_latest_counts(spark):
    later = DAY + datetime.timedelta(days=9)
    assert changes(spark, [(1, "a", "x"), (1, "a", "y", later), (2, "a", "y"), (2, "a", "y")]) == []


def test_nulls_empty_and_single_snapshots(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "a", "x")]) == []
    assert changes(spark, [(1, None, "x"), (2, None, "y"), (None, "a", "x"), (1, "z", "1"), (2, "z", "1")]) == []


def test_hot_key_and_long_text(spark):
    long = "ngày 3 " * 60_000
    rows = [(1, "hot", long)] * 200 + [(2, "hot", long + "1")] * 200 + [(1, str(i), "") for i in range(50)] + [(2, str(i), "") for i in range(50)]
    assert changes(spark, rows) == [(2, "hot", "changed")]


def test_orphans_and_reasons(spark):
    refs = [("t", 1, "r1", "k1"), ("t", 2, "r1", "k1"), ("t", 2, "r2", "k2"), ("t", 2, "r3", "k3"), ("t", 2, "r3", "k3"), ("t", 1, "r4", " "), ("t", 1, "r5", None), ("u", 1, "r1", "k1"), ("t", None, "r9", "k1")]
    targets = [("t", 1, "k1"), ("t", 3, "k2"), ("t", 1, None)]
    columns = "ref_table string, period int, row_key string, ref_key string, n int, reason string"
    r = spark.createDataFrame([(*x, 5, "clash") for x in refs], columns)
    t = spark.createDataFrame([(*x, 1) for x in targets], "ref_table string, period int, ref_key string, periods int")
    found = sorted(tuple(x) for x in orphan_references(r, t).collect())
    assert found == [("t", 2, "r1", "k1", "deleted"), ("t", 2, "r2", "k2", "late"), ("t", 2, "r3", "k3", "missing"), ("u", 1, "r1", "k1", "missing")]
    report = {tuple(x)[:3]: (x.n_references, x.n_keys) for x in orphan_report(r, t).collect()}
    assert report[("t", 2, "late")] == (1, 1)


def test_heavy_orphan_keys_are_told_by_broadcast(spark):
    refs = spark.range(5_000).select(F.lit("t").alias("ref_table"), F.lit(1).alias("period"), F.col("id").cast("string").alias("row_key"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "held").otherwise(F.concat(F.lit("k"), "id")).alias("ref_key"))
    targets = spark.createDataFrame([("t", 1, "held"), ("t", 2, "hot")], "ref_table string, period int, ref_key string")
    found = orphan_references(refs, targets).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in found} == {"late": 1667, "missing": 1666}
    assert orphan_references(refs.limit(0), targets).count() == 0


def test_padding_of_any_white_space_is_not_part_of_a_key(spark):
    refs = spark.createDataFrame([("t", 1, "r1", "\tk1\t"), ("t", 1, "r2", "\u00a0k2\u3000"), ("t", 1, "r3", " \t\u2003"), ("t", 1, "r4", "k3\r\n")], "ref_table string, period int, row_key string, ref_key string")
    targets = spark.createDataFrame([("t", 1, "k1"), ("t", 1, " k3\t")], "ref_table string, period int, ref_key string")
    assert [tuple(r) for r in orphan_references(refs, targets).collect()] == [("t", 1, "r2", "k2", "missing")]
    padded = spark.createDataFrame([("\t\u2009",), ("\u00a0x\t",), (None,)], "x string")
    assert [tuple(r) for r in padded.select(blank("x"), trimmed("x")).collect()] == [(True, ""), (False, "x"), (True, None)]


def test_heavy_keys_leave_before_the_shuffle(spark):
    refs = spark.range(9_000).select(F.lit("t").alias("ref_table"), F.lit(1).alias("period"), F.col("id").cast("string").alias("row_key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("ref_key"))
    targets = spark.createDataFrame([("t", 2, "hot")], "ref_table string, period int, ref_key string")
    heavy, light = orphan_keys(refs.select(*KEY), targets)
    assert [tuple(r) for r in heavy.collect()] == [("t", 1, "hot", 3_000, "late")] and light.where("ref_key = 'hot'").count() == 0
    plan = orphan_references(refs, targets)._jdf.queryExecution().optimizedPlan().toString()
    # The references that are shuffled have met the few heavy keys in an anti join before.
    assert "LeftAnti" in plan and plan.index("Join Inner", plan.index("Union") + 200) < plan.index("LeftAnti")


def test_labels_name_codes_however_written(spark):
    labels = ["Điều 3.12.NĐ.7.5. Tên", " điều  3.12.nđ.7.5", "Ðiều 3.12.NÐ.7.5.​ Tên", "Điều 3.12.NĐ.7.5 Tên 4.1", "Tên", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(article_code(F.col("x"))).collect()] == ["3.12.NĐ.7.5"] * 4 + [""] * 2


def test_consistent_form():
    cases = {
        "quу định": "quy định", "ｖｉệｃ": "việc", "Тhông": "Thông", "ðồng Ɖiều": "đồng Điều", "a​b­c": "abc", "x y　z": "x y z",
        "е̣̂": "ệ", "α‐amylase": "α-amylase", "Ⅳ": "IV", "5 kΩ m² ½ nº ° … – “x”": "5 kΩ m² ½ nº ° … – “x”", "“правила перевозки”": "“правила перевозки”",
        "规定所称，是指（含）。": "规定所称，是指（含）。", "một，hai": "một,hai", "d̵o": "đo", "": "",
    }
    for given, wanted in cases.items():
        assert consistent(given) == wanted, given
        assert consistent(wanted) == wanted
    assert consistent(None) is None
