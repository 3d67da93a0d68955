"""Tables that show whether the queries do the whole job: rows that the generated tables have few or none of."""

from collections import Counter

from pyspark.sql import functions as F

from lexmill.operators.corpus import article_documents
from lexmill.plans import catalogue


def saved(spark, folder, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_documents_without_vector_are_searched(spark, tmp_path):
    texts = {50: "alpha beta\nmore", 51: "alpha beta gamma", 52: "delta", 100: "delta\nepsilon", 150: ""}
    folder = saved(spark, tmp_path, documents=([(i, t, None) for i, t in texts.items()], "doc_id long, text string, law_id string"), embeddings=([(50, [1.0, 0.0], "a"), (52, [0.0, 1.0], "b")], "vec_id long, embedding array<float>, label string"))
    found = {(r.request_id, r.key): (r.bm25 > 0, r.n_channels) for r in catalogue.QUERIES["hybrid_search_all"](spark, folder).collect()}
    assert found == {(50, 50): (True, 2), (50, 51): (True, 1), (50, 52): (False, 1), (100, 100): (True, 1), (100, 52): (True, 1)}
    assert {r.request_id for r in catalogue.QUERIES["context_blocks_all"](spark, folder).collect()} == {50, 100}
    assert {r.request_id: r.status for r in catalogue.QUERIES["evidence_all"](spark, folder).collect()} == {50: "ok", 100: "ok", 150: "no_results"}


def test_every_snapshot_and_a_sixth(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("parsed_article", "index_document"):
        spark.read.parquet(f"{source}/{name}.parquet").withColumn("snapshot_no", F.expr("snapshot_no + 1")).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{source}/chat_log.parquet").write.parquet(f"{tmp_path}/chat_log.parquet")
    rows = lambda name, folder: Counter(map(repr, catalogue.QUERIES[name](spark, str(folder)).collect()))
    for name in ("file_manifest", "corpus_order", "claims_supported"):
        assert rows(name, tmp_path) == rows(name, source), name
    for name in ("sections", "section_chunks", "incremental_merge_all"):
        column = "merged_no" if name == "incremental_merge_all" else "snapshot_no"
        assert {r[0] for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(column).distinct().collect()} >= {3, 4, 5, 6}, name


def test_copies_are_folded_before_they_are_collected(spark):
    meta = [F.lit("x").alias(c) for c in ("law_id", "article_code", "article_name", "title", "issuer", "effective_date", "mapc")]
    rows = spark.range(10_000).select(*meta, F.col("id").alias("pos"), F.when(F.col("id") == 7, "other").when(F.col("id") == 8, " ").otherwise(F.lit("copy")).alias("content"))
    docs = article_documents(rows, "pos", F.lit("k"))
    doc = docs.first()
    assert (doc.chunk_count, doc.content) == (10_000, "copy\n\nother")
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    collects = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "_c#" in collects and "count(1)" not in collects and "count(1)" in plan
