"""Queries that ask with every row of their table that has an id, not with a part of them."""

from hashlib import md5

from lexmill.operators.search import clipped
from lexmill.plans import catalogue

DOCUMENTS = [(1, "alpha beta\nmore", "L1"), (2, "alpha beta gamma", " l1"), (3, "delta", None), (50, "delta\nepsilon", "L2"), (51, "alpha beta\nelse", "L2"), (52, "", "L2"), (53, None, None), (None, "alpha", "L1")]


def documents(spark, folder) -> str:
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, law_id string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (52, [0.6, 0.8], "b")], "vec_id long, embedding array<float>, label string").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_every_document_asks_in_hybrid_search(spark, tmp_path):
    found = {}
    for r in catalogue.QUERIES["hybrid_search"](spark, documents(spark, tmp_path)).collect():
        found.setdefault(r.request_id, {})[r.key] = (r.bm25 > 0, r.vector > 0, r.bonus)
    lexical = {1: (True, True, 0.45), 2: (True, False, 0.45), 51: (True, False, 0.0)}
    assert found == {
        1: lexical | {3: (False, False, 0.0), 52: (False, True, 0.0)},
        2: {1: (True, False, 0.45), 2: (True, False, 0.45), 51: (True, False, 0.0)},
        3: {3: (True, True, 0.0), 50: (True, False, 0.0), 52: (False, True, 0.0), 1: (False, False, 0.0)},
        # Two documents with one first line: each has the hits, with its own law.
        50: {3: (True, False, 0.0), 50: (True, False, 0.45)},
        51: {1: (True, False, 0.0), 2: (True, False, 0.0), 51: (True, False, 0.45)},
        52: {1: (False, True, 0.0), 3: (False, True, 0.0), 52: (False, True, 0.45)},
    }


def test_every_document_has_a_context(spark, tmp_path):
    found = {r.request_id: r.context_md5 for r in catalogue.QUERIES["context_blocks"](spark, documents(spark, tmp_path)).collect()}
    shown = lambda *texts: md5("\n\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1)).encode()).hexdigest()
    assert set(found) == {1, 2, 3, 50, 51, 52}
    assert found[50] == shown("delta\nepsilon", "delta")


def test_a_clipped_text_ends_in_no_space_of_any_script(spark):
    texts = spark.createDataFrame([("\xa0" + "a" * 1_399 + "\xa0b",), ("　",), ("\ta\n",)], "t string")
    assert [r.t for r in texts.select(clipped("t").alias("t")).collect()] == ["a" * 1_399, "", "\ta\n"]


def test_every_document_has_its_evidence_told(spark, tmp_path):
    found = {r.request_id: (r.n_hits, r.n_structured, r.status) for r in catalogue.QUERIES["evidence"](spark, documents(spark, tmp_path)).collect()}
    assert found == {1: (4, 4, "ok"), 2: (3, 3, "ok"), 3: (4, 3, "ok"), 50: (2, 1, "ok"), 51: (3, 3, "ok"), 52: (3, 2, "ok"), 53: (0, 0, "no_results")}


def test_every_chat_has_its_strong_hits_told(spark, tmp_path):
    code = "Điều 1.1.LQ.1.1"
    chats = [(1, f"{code} quy định gì?"), (2, f"{code} quy định gì?"), (3, "mức phạt"), (50, "quy định"), (51, "không có"), (52, None), (None, "quy định")]
    spark.createDataFrame(chats, "chat_id long, question string").write.parquet(f"{tmp_path}/chat_log.parquet")
    spark.createDataFrame([("p1", "m1", f"{code}. quy định"), ("p2", "m2", "mức phạt quy định")], "point_id string, mapc string, content string").selectExpr("*", "timestamp'2024-01-01' as indexed_at").write.parquet(f"{tmp_path}/index_document.parquet")
    fields = "article_code string, article_name string, article string, law_id string, title string, issuer string, effective_date string, topic_id string, de_muc string, source_note string, raw_content string"
    rows = [(m, c, *[None] * 10) for m, c in (("m1", code), ("m2", "Điều 2.2.LQ.2.2"))]
    spark.createDataFrame(rows, f"mapc string, {fields}").selectExpr("*", "1 as snapshot_no", "timestamp'2024-01-01' as loaded_at").write.parquet(f"{tmp_path}/parsed_article.parquet")
    found = {r.chat_id: (r.n_strong, r.n_hits) for r in catalogue.QUERIES["strong_exact_hits"](spark, str(tmp_path)).collect()}
    assert found == {1: (1, 2), 2: (1, 2), 3: (0, 1), 50: (0, 2)}


def test_every_chat_searches_the_sections(spark, tmp_path):
    chats = [(1, "mức phạt là gì"), (2, "mức phạt là gì"), (50, "đê"), (51, "đê sông"), (52, None), (53, ""), (None, "đê")]
    spark.createDataFrame(chats, "chat_id long, question string").write.parquet(f"{tmp_path}/chat_log.parquet")
    sections = [("p1", "m1", "mức phạt với đê"), ("p2", "m2", "thủ tục sông")]
    spark.createDataFrame(sections, "point_id string, mapc string, content string").selectExpr("*", "timestamp'2024-01-01' as indexed_at").write.parquet(f"{tmp_path}/index_document.parquet")
    found = {}
    for r in catalogue.QUERIES["section_search"](spark, str(tmp_path)).orderBy("request_id", "rerank").collect():
        found.setdefault(r.request_id, []).append((r.key, r.rerank_score))
    assert found == {1: [("p1", 0.5), ("p2", 0.0)], 2: [("p1", 0.5), ("p2", 0.0)], 50: [("p1", 1.0), ("p2", 0.0)]} | {51: found[51]} and sorted(found[51]) == [("p1", 0.5), ("p2", 0.5)]
