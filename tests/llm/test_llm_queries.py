"""The registered queries of the subpackage over the smallest tables."""

import os

import pytest

from lexmill.functions.lookalike import consistent
from lexmill.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "p3_found": ["point_id", "field"], "p4_found": ["chat_id", "defect_type"], "p5_found": ["snapshot_no", "mapc", "field"], "p6_found": ["config_id", "mapc"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "sent_end"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    # So few texts show no limit: three of a loader and snapshot have to lie at it.
    assert (rows or name == "p3_limits") and (name not in COLUMNS or df.columns == COLUMNS[name])
    if name in COLUMNS and name != "p7_ids":
        assert len(set(rows)) == len(rows)


def test_p5_equals_brute_force(spark):
    rows = queries._articles(spark, DATA).select("snapshot_no", "mapc", *queries.TEXT_FIELDS).collect()
    wanted = {(r.snapshot_no, r.mapc, f) for r in rows for f in queries.TEXT_FIELDS if r[f] is not None and consistent(r[f]) != r[f]}
    assert {tuple(r) for r in queries.p5_found(spark, DATA).collect()} == wanted


def test_p6_equals_its_definition(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("parsed_article", "chunk_config"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert {tuple(r) for r in queries.p6_found(spark, DATA).collect()} == set(con.execute(queries.SQL["p6_found"]).fetchall())


def test_p7_has_every_document_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = queries.p7_ids(spark, DATA)
    assert ids.count() == docs.count() and ids.join(docs, "doc_id").where("coalesce(text, '') = '' and size(ids) > 0").count() == 0
    assert queries.p7_round_trip(spark, DATA).where("not same").count() == 0
