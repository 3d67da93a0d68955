"""Text, extraction, chunking, corpus, search, HTML and streaming operators on small fixtures."""

import collections
import datetime
import html
import json
import math
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions.extract import citations, effective_date, issuers_by_code, law_id, query_features, query_filters, source_note, title_parts
from lexmill.functions.text import as_flag, clean_text, clipped, collapse, compared, first_json_object, format_source, informative_tokens, iso_date, legal_reference, point_id, retrieval_text, tokens, without_prefixes
from lexmill.operators.chunking import article_sections, with_heading
from lexmill.operators.corpus import article_documents, backfilled, corpus_stats, group_key, latest_rows, replaced, total_order
from lexmill.operators.evaluation import claim_support, claims, displayed_sources, first_relevant_rank, grounding, label_scores, latencies, retrieval_quality
from lexmill.operators.search import bm25_topk, date_passes, exact_bonus, hybrid_merge, vector_topk, with_fallback
from lexmill.operators.splitter import chunks, windows
from lexmill.sources.html import articles, html_nodes, js_array, lookups
from lexmill.sources.index_store import Collections, collection_name, evaluation_cases, retained, upserted


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r)[1:] for r in rows]


def brute_clean(text):
    text = html.unescape(text or "").replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n")
    lines = [re.sub(r"[ \t\f\v]+", " ", x).strip(" ") for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(" \n")


def test_clean_text(spark):
    texts = ["a&nbsp;&amp; b", " x \r\n\r\n\r\n y\t\tz ", None, "", "\n\n", "&#273;ò", "a\n \n\nb", "x &unknown; y"]
    assert values(spark, texts, clean_text("x")) == [brute_clean(x) for x in texts]
    assert values(spark, [" a  b　c ", None], collapse("x")) == ["a b c", ""]


def test_tokens(spark):
    assert values(spark, ["Điều 5.a, ĐÒ đò!", None], tokens("x")) == [["điều", "5", "a", "đò", "đò"], []]
    assert values(spark, ["các đò ngang 123 đò ngang"], informative_tokens("x", ["các"])) == [["ngang"]]


def test_scalars(spark):
    assert values(spark, ["1/2/2020", "2020-02-30", "2020-2-3", "", None, "31/12/1999 "], iso_date("x")) == ["2020-02-01T00:00:00Z", "", "2020-02-03T00:00:00Z", "", "", "1999-12-31T00:00:00Z"]
    name = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    assert values(spark, ["a", "đ|x", ""], point_id("chunk", F.col("x"))) == [str(uuid.uuid5(name, f"chunk:{x}")) for x in ("a", "đ|x", "")]
    assert values(spark, ["abc  def", "ab"], *clipped("x", 5)) == [("abc", True), ("ab", False)]
    assert values(spark, ["Yes", "off", "?", None], as_flag("x")) == [True, False, None, None]
    assert values(spark, ['text {"a": {"b": 1}} end', "none"], first_json_object("x")) == ['{"a": {"b": 1}}', ""]
    tricky = ['```json\n{"a": "}"} rest {"b": 2}\n```', '{bad} then {"a": [1, {"b": "{"}]} x', "{never closed", None]
    assert values(spark, tricky, first_json_object("x")) == ['{"a": "}"}', '{"a": [1, {"b": "{"}]}', "", ""]
    assert values(spark, ["A,  b! Đò_1", None], compared("x")) == ["a b đò_1", ""]
    assert values(spark, ["Phạm vi. phạm vi: Nội dung"], without_prefixes(F.col("x"), F.lit("Phạm vi"), F.lit("Phạm vi"))) == ["Nội dung"]
    row = spark.createDataFrame([("Điều 1", " ", "", "Luật đò", "Quốc hội", None, "Điều 1")], "article_code string, article_name string, law_id string, title string, issuer string, effective_date string, article string")
    assert row.select(format_source(), legal_reference()).first()[:] == ("Điều 1 - Luật đò - Quốc hội", "Điều 1 của Luật đò")
    assert row.select(retrieval_text("title", "title", "article_code", "issuer")).first()[0] == "Luật đò. Điều 1. Quốc hội"


def test_extraction(spark):
    notes = ["(Điều 3 Thông tư số 10/2020/TT-BTC Quy định về đò ngày 01/02/2020 của Bộ Tài chính, có hiệu lực thi hành kể từ ngày 5/3/2020)", "Điều 4 Nghị định số 1/2019/NĐ-CP, có hiệu lực từ ngày 1 tháng 2 năm 2019", "Không có gì", None]
    found = values(spark, notes, *source_note("x").values())
    assert found[0] == ("Thông tư số 10/2020/TT-BTC", "Quy định về đò", "Điều 3", "Bộ Tài chính", "5/3/2020")
    assert found[1] == ("Nghị định số 1/2019/NĐ-CP", "", "Điều 4", "Chính phủ", "01/02/2019")
    assert found[2] == found[3] == ("", "", "", "", "")
    assert values(spark, ["Thông tư liên tịch số 1/2006/TTLT-BCA-BQP-BCA", "Luật số 5/2010/QH12", "UBTVQH11"], issuers_by_code("x")) == ["Bộ Công an; Bộ Quốc phòng", "Quốc hội", "Ủy ban Thường vụ Quốc hội"]
    assert values(spark, ["Điều 1.2.TT.3.4. Tên điều", "Không"], *title_parts("x")) == [("Điều 1.2.TT.3.4.", "Tên điều"), ("Không", "")]
    asked = query_filters("x")
    assert values(spark, ["điều 1.2.tt.3.4 của Luật số 5/2010/QH12", "Điều 7 có hiệu lực 1/1/2020?", "Điều 8."], *asked.values()) == [("Luật số 5/2010/QH12", "Điều 1.2.TT.3.4", "", "", "", "", ""), ("", "", "Điều 7", "1/1/2020", "", "", ""), ("", "", "Điều 8", "", "", "", "")]
    assert values(spark, ["Luật Đê điều của Quốc hội quy định gì?", "Đề mục 5.1 - Thuế, của Bộ Tài chính"], *[asked[c] for c in ("title", "de_muc", "issuer")]) == [("Luật Đê điều của Quốc hội", "", "Quốc hội"), ("", "Đề mục 5.1 - Thuế", "Bộ Tài chính")]
    flags = query_features(asked, F.col("x"))
    assert values(spark, ["Luật Đê điều là gì?", "Ai nộp?"], *flags.values()) == [(False, False, True, False, False, True, False, True), (False,) * 8]
    cited = ["Điều 5, Khoản 2, Điểm a, Luật số 1/2000/QH10", "Điều 7", "Luật số 1/2000/QH10"]
    assert values(spark, ["Theo Điều 5 Khoản 2 Điểm a của Luật số 1/2000/QH10. Xem " + "thêm " * 20 + "Điều 7 và Điều 7"], citations("x")) == [cited]
    assert values(spark, ["Không", None], citations("x")) == [[], []]
    assert values(spark, ["LUẬT SỐ 5/2010/QH12 x"], law_id("x")) == ["LUẬT SỐ 5/2010/QH12"]
    assert values(spark, ["có hiệu lực kể từ ngày 7/8/2001"], effective_date("x")) == ["7/8/2001"]


def test_sections(spark):
    body = "Mở đầu\n1. Khoản một:\nghi chú\na) điểm a\ntiếp\nb) điểm b\n2. Khoản hai"
    rows = spark.createDataFrame([("m1", body, "Điều 1"), ("m2", "chỉ một\ndòng", "Điều 2"), ("m3", "", ""), ("m4", None, None)], "mapc string, raw string, head string")
    cut = article_sections(rows, ["mapc"], "raw")
    found = collections.defaultdict(list)
    for r in cut.orderBy("mapc", "section_no").collect():
        found[r.mapc].append(r.section)
    lead = "Mở đầu\n1. Khoản một:\nghi chú\n"
    assert found["m1"] == [lead + "a) điểm a\ntiếp", lead + "b) điểm b", "Mở đầu\n2. Khoản hai"]
    assert found["m2"] == ["chỉ một\ndòng"] and found["m3"] == found["m4"] == [""]
    headed = with_heading(cut.join(rows.select("mapc", "head"), "mapc"), ["head"]).where("mapc = 'm2'").first()
    assert headed.content == "Điều 2\nchỉ một\ndòng"
    made = chunks(cut.join(rows.select("mapc", "head"), "mapc"), ["mapc", "section_no"], "section", "head", 210, 20)
    assert made.where("mapc = 'm3'").collect()[0].content == "" and made.where("mapc = 'm2'").first().content == "Điều 2\nchỉ một\ndòng"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. ;\n", max_size=300), st.integers(1, 50), st.integers(0, 60))
def test_windows_stay_under_the_limit(text, size, overlap):
    pieces = windows(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    assert "".join("".join(pieces).split()) == "" if not text.strip() else pieces
    letters = collections.Counter(text.replace(" ", "").replace("\n", ""))
    got = collections.Counter("".join(pieces).replace(" ", "").replace("\n", ""))
    assert all(got[x] >= n for x, n in letters.items())


def test_corpus_operators(spark):
    rows = spark.createDataFrame([("f", "L", 1, "Tên", "", ""), ("f", "L", 2, "Tên dài", "ngày 3 của Bộ A", "1/1/2000"), ("f", "L", 3, "", "Bộ A", None), ("f", "", 4, "", "", ""), ("g", "L", 5, None, None, None)], "file_id string, law_id string, pos long, title string, issuer string, effective_date string")
    found = {r.pos: (r.title, r.issuer, r.effective_date) for r in backfilled(rows, ["file_id", "law_id"], "pos", ["title", "effective_date"]).collect()}
    assert found == {1: ("Tên", "Bộ A", "1/1/2000"), 2: ("Tên dài", "ngày 3 của Bộ A", "1/1/2000"), 3: ("Tên dài", "Bộ A", "1/1/2000"), 4: ("", "", ""), 5: ("", "", "")}
    stats = corpus_stats(rows, "title", ["issuer"]).first()
    assert (stats.n_rows, stats.n_empty, stats.max_length, stats.missing_issuer) == (5, 3, 7, 3)
    assert sorted(r.pos for r in replaced(rows, rows.limit(0), rows.where("pos = 1"), "law_id").collect()) == [4]
    again = latest_rows(rows.unionByName(rows), ["pos"], "title")
    assert again.count() == 5
    ordered = total_order(rows.repartition(3), [F.col("pos")])
    assert [r.position for r in ordered.orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    parts = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "a"), ("f", 4, " ")], "file_id string, pos int, content string").selectExpr("*", "'L' law_id", "'Điều 1' article_code", "'' article", "'Tên' article_name", "'T' title", "null issuer", "'1/2/2000' effective_date", "'m' mapc")
    doc = article_documents(parts, "pos", group_key()).first()
    assert (doc.content, doc.chunk_count, doc.effective_date_iso, doc.content_truncated) == ("a\n\nb", 4, "2000-02-01T00:00:00Z", False)


DOCS = [("d1", "đò ngang đò", "A"), ("d2", "phí kho", "B"), ("d3", "", "A"), ("d4", None, None), ("d5", "đò kho kho phí", "B"), ("d6", "đò ngang đò", "A")]


def brute_bm25(docs, question, allowed=lambda kind: True):
    toks = {d: re.findall(r"[0-9A-Za-zÀ-ỹ]+", (t or "").lower()) for d, t, _ in docs}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    out = []
    for d, _, kind in docs:
        score = 0.0
        for q in re.findall(r"[0-9A-Za-zÀ-ỹ]+", question.lower()):
            df, tf = sum(q in t for t in toks.values()), toks[d].count(q)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks[d]) / avg))
        if round(score, 6) > 0 and allowed(kind):
            out.append((round(score, 6), d))
    return [(d, s) for s, d in sorted(out, key=lambda x: (-x[0], x[1]))]


def test_bm25(spark):
    docs = spark.createDataFrame([(*d, 1.0) for d in DOCS], "doc_id string, content string, kind string, score double")
    asked = spark.createDataFrame([(1, "đò đò phí", ""), (2, "kho", "b"), (3, "không", ""), (4, None, "")], "query_id int, question string, kind string")
    found = collections.defaultdict(list)
    for r in bm25_topk(docs, asked, 3).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, round(r.score, 6)))
    assert dict(found) == {1: brute_bm25(DOCS, "đò đò phí")[:3], 2: brute_bm25(DOCS, "kho")[:3]}
    filtered = bm25_topk(docs, asked, 3, filters={"kind": "kind"}).where("query_id = 2").orderBy("rank").collect()
    assert [r.doc_id for r in filtered] == [d for d, _ in brute_bm25(DOCS, "kho", lambda k: (k or "").lower() == "b")]
    assert bm25_topk(docs, asked.limit(0), 3).count() == 0 and bm25_topk(docs.limit(0), asked, 3).count() == 0


def test_vectors_and_merge(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.6, 0.8], 2), (3, [0.0, 0.0], 1), (4, None, 1), (5, [2.0, 0.1], 2)], "vec_id long, embedding array<float>, label int")
    asked = rows.where("vec_id = 1").selectExpr("7 query_id", "embedding", "2 label")
    found = [(r.vec_id, r.semantic) for r in vector_topk(rows, asked, 4).orderBy("rank").collect()]
    assert found == [(1, 1.0), (5, 0.998752), (2, 0.6), (3, 0.0)]
    boosted = [r.vec_id for r in vector_topk(rows, asked, 2, label=("label", "label"), bonus=0.5).orderBy("rank").collect()]
    assert boosted == [5, 2]
    hits = spark.createDataFrame([(1, 0, "bm25", "a", 4.0, 0.0), (1, 0, "vector", "a", 0.5, 0.0), (1, 1, "bm25", "b", 2.0, 0.45), (1, 0, "vector", "c", -0.3, 0.0)], "request_id int, query_no int, channel string, key string, score double, bonus double")
    merged = {r.key: (r.combined, r.rank) for r in hybrid_merge(hits).collect()}
    assert merged == {"a": (1.1, 1), "b": (0.75, 2), "c": (0.1, 3)}
    fallback = with_fallback(hits.where("key = 'a'"), hits.withColumn("request_id", F.col("query_no")), "request_id").collect()
    assert sorted((r.request_id, r.fell_back) for r in fallback) == [(0, True)] * 3 + [(1, False)] * 2
    bonus = spark.range(1).select(*exact_bonus({"article": (F.lit("Điều 1 "), F.lit("điều 1")), "law_id": (F.lit("L"), F.lit("l")), "title": (F.lit(""), F.lit(""))})).first()
    assert bonus[0] == 1.85 and bonus[1] == ["article", "law_id"]
    dates = spark.range(1).select(*[date_passes(F.lit(d), F.lit("2000"), F.lit(""), m) for d in ("1999", "2001", "") for m in ("pass", "drop")]).first()
    assert list(dates) == [False, False, True, True, True, False]


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (3, "d", 1)], "q int, d string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "b"), (2, "c"), (4, "z")], "q int, d string")
    quality = retrieval_quality(first_relevant_rank(hits, truth, "q", "d"), 5).first()
    assert (quality.n_queries, quality.hit_1, quality.hit_3, quality.hit_10, quality.mrr_hits, quality.mrr_all) == (3, 0.0, 0.6667, None, 0.4167, 0.2778)
    times = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double").withColumn("k", F.lit("r"))
    assert latencies(times, ["k"], "x").first()[1:] == (4, 4.25, 3.0, 9.1)
    answers = spark.createDataFrame([(1, "Chủ kho nộp phí neo đậu. Ngắn. Trời hôm nay nắng to lắm: không liên quan gì."), (2, None)], "k int, a string")
    evidence = spark.createDataFrame([(1, "chủ kho phải nộp phí neo đậu"), (1, None)], "k int, evidence string")
    found = claim_support(claims(answers, "k", "a"), evidence, "k")
    assert [(r.claim_no, r.supported) for r in found.orderBy("claim_no").collect()] == [(0, True), (1, False), (2, False)]
    assert grounding(found, "k").first().score == 0.3333
    hinted = claim_support(claims(answers, "k", "a"), evidence, "k", spark.createDataFrame([(1, ["trời hôm nay", ""])], "k int, hints array<string>"))
    assert [r.supported for r in hinted.orderBy("claim_no").collect()] == [True, True, False]
    stated = spark.createDataFrame([(1, "- Điều này chưa đủ căn cứ để kết luận. - x - Ngắn"), (2, "")], "k int, a string")
    alone = claim_support(claims(stated, "k", "a"), evidence, "k")
    assert [r.supported for r in alone.collect()] == [True]
    report = spark.createDataFrame([(1, False), (2, True), (3, False)], "k int, citation_ok boolean")
    assert {r.k: r.score for r in grounding(alone, "k", report).collect()} == {1: 0.85, 2: 1.0, 3: 0.85}
    shown = spark.createDataFrame([(["Điều 1", "Điều 1 - Luật", " Điều 1 - Luật ", None, "B"],)], "s array<string>").select(displayed_sources(F.col("s"), 2)).first()[0]
    assert shown == ["Điều 1 - Luật", "B"]
    pruned = lambda *x: spark.createDataFrame([(list(x),)], "s array<string>").select(displayed_sources(F.col("s"), 9)).first()[0]
    assert pruned("Điều 1", "Luật số 2/2020", "Điều 1 - Tên - Luật số 2/2020") == ["Điều 1 - Tên - Luật số 2/2020"]
    assert pruned("một hai ba bốn năm", "một hai ba bốn năm sáu") == ["một hai ba bốn năm", "một hai ba bốn năm sáu"]
    assert pruned("Điều 1") == ["Điều 1"] and pruned() == [] and pruned("Luật số 5 - a", "Luật số 5 - b") == ["Luật số 5 - a", "Luật số 5 - b"]
    labels = values(spark, ["Mức phạt hành vi?", "thủ tục", "gì"], label_scores(F.col("x"), {"a": ["mức phạt", "hành vi"], "b": ["thủ tục"]}))
    assert [(x.label, x.score) for x in labels] == [("a", 0.99), ("b", 0.99), (None, 0.0)]


PAGE = """<html><head><script>var s = "<p class='pDieu'>no</p>";</script></head><body><h3>Kho vận<br>bốc xếp</h3><div class="_content">
<p class="pChuong">Chương I</p><p class="pChuong">Quy định chung</p>
<p class="pDieu"><a name="m1"></a>Điều 1.2.TT.3.1. Phạm vi &amp; đối tượng</p>
<p class="pGhiChu">(Điều 1 Thông tư số 1/2020/TT-BTC, có hiệu lực từ ngày 1/2/2020)<p class="pNoiDung"><p>1. Một</p><p>2. Hai</p></p>
<p class="pChiDan"><a href="#">Điều 9</a>; <a href="#">Điều 9</a></p><p class="pChiDan"><a>Điều 8</a></p>
<p class="pDieu"><a name="m2"></a>Điều 1.2.TT.3.2. Không nội dung</p>
<p class="pChuong">Chương II</p><p class="pDieu"><a name="m3">Điều khác</p><p class="pNoiDung">Nội dung</p></div><p class="pDieu">ngoài</p></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("f1", PAGE), ("f2", "<p>x"), ("f3", None), ("f4", "")], "file_id string, html string")
    found = articles(html_nodes(pages, "file_id", "html"), "file_id").orderBy("article_no").collect()
    assert [(r.mapc, r.article_code, r.article_name, r.chapter_code, r.chapter_title) for r in found] == [
        ("m1", "Điều 1.2.TT.3.1.", "Phạm vi & đối tượng", "Chương I", "Quy định chung"), ("m2", "Điều 1.2.TT.3.2.", "Không nội dung", "Chương I", "Quy định chung"), ("m3", "Điều khác", "", "Chương II", ""),
    ]
    assert found[0].raw_content == "1. Một\n\n2. Hai" and found[0].related_articles == ["Điều 9", "Điều 8"] and found[0].law_id == "Thông tư số 1/2020/TT-BTC"
    assert found[1].raw_content == "" and found[2].raw_content == "Nội dung"
    script = 'var jdChuDe = [{"Value": "c1", "Text": "A ] \\" b", "STT": 1}, {"Value": ""}]; var jdDeMuc=[{"Value":"d1","Text":"D","ChuDe":"c1"}];'
    assert len(js_array(script, "jdChuDe")) == 2 and js_array(script, "none") == []
    topics, parts = lookups(spark, script)
    assert topics.collect()[0].name == 'A ] " b' and parts.collect()[0].topic == "c1"


def test_index_store(spark, tmp_path):
    store, one = Collections(spark, str(tmp_path)), spark.createDataFrame([("p1", 1), ("p2", 1)], "point_id string, v int")
    store.write("a_v1", one)
    assert store.switch("a", "a_v1") is None and store.read("a").count() == 2
    store.write("a_v2", upserted(store.read("a"), spark.createDataFrame([("p2", 2), ("p3", 2), ("p3", 2)], "point_id string, v int")))
    assert store.switch("a", "a_v2") == "a_v1" and store.switch("a", "a_v2") == "a_v2"
    assert {(r.point_id, r.v) for r in store.read("a").collect()} == {("p1", 1), ("p2", 2), ("p3", 2)}
    names = spark.createDataFrame([("a_v1",), ("a_v2",), ("a_v3",), ("b_v1",)], "name string")
    assert {r.name: r.keep for r in retained(names, "a_", 1, ["a_v1"]).collect()} == {"a_v1": True, "a_v2": False, "a_v3": True}
    assert collection_name("a", None, "20240101") == "a_v20240101" and collection_name("a", "7", "x", "own") == "own"
    cases = tmp_path / "cases.jsonl"
    cases.write_text("\n".join(json.dumps(x) for x in ({"query": " q ", "ground_truth_mapc": '["m1", "m2"]'}, {"query": "r", "ground_truth_mapc": "m3, m4"}, {"query": " "})))
    assert [(r.query, r.ground_truth_mapc) for r in evaluation_cases(spark, str(cases)).orderBy("query").collect()] == [("q", ["m1", "m2"]), ("r", ["m3", "m4"])]


def test_messages_and_threads(spark):
    from lexmill.operators.evaluation import folded_events, messages, step_times
    from lexmill.streaming.threads import thread_states_batch

    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("s", "t", at, "q1", "a1"), ("s", "t", at + datetime.timedelta(1), "q2", " "), ("s", None, at, "q", None)], "session_id string, thread_id string, at timestamp, q string, a string")
    said = messages(rows, ["session_id", "thread_id"], "at", "q", "a").where("thread_id = 't'").orderBy("message_no").collect()
    assert [(r.role, r.text) for r in said] == [("user", "q1"), ("assistant", "a1"), ("user", "q2")]
    chats = spark.createDataFrame([("s", "t", 1, "need_clarify"), ("s", "t", 2, None), ("s", None, 3, "need_clarify")], "session_id string, thread_id string, chat_id long, status string")
    assert {(r.thread_id, r.n_messages, r.waiting) for r in thread_states_batch(chats).collect()} == {("t", 2, False), ("", 1, True)}
    events = spark.createDataFrame([(1, at, 1, "a", 1.0), (1, at + datetime.timedelta(seconds=3), 2, "b", 2.0), (1, at + datetime.timedelta(seconds=5), 3, "a", 3.0)], "u int, ts timestamp, id int, kind string, value double")
    assert {(r.kind, r.last_value) for r in folded_events(events, "u", ["ts", "id"], "kind", "value").collect()} == {("a", 3.0), ("b", 2.0)}
    assert {(r.kind, r.total_s) for r in step_times(events, "u", "ts", "id", "kind").collect()} == {("a", 3.0), ("b", 2.0)}


def test_models_and_reranking(spark):
    from lexmill.models import embedded
    from lexmill.operators.rerank import overlap_model, reranked, variants

    df = spark.createDataFrame([("đò ngang",), ("đò ngang",), ("",), (None,)], "x string").select(embedded("x").alias("v"))
    vectors = [r.v for r in df.collect()]
    assert vectors[0] == vectors[1] and abs(sum(x * x for x in vectors[0]) - 1) < 1e-5 and not any(vectors[2]) and not any(vectors[3])
    hits = spark.createDataFrame([(1, "a", 0.9, 1, "q x", "z"), (1, "b", 0.8, 2, "q x", "q x"), (1, "c", 0.7, 3, "q x", None), (1, "d", 0.6, 4, "q x", "q")], "r int, key string, combined double, rank int, q string, c string")
    assert [x.key for x in reranked(hits, "r", "q", "c", 2, overlap_model).orderBy("rerank").collect()] == ["b", "a"]
    assert [x.key for x in reranked(hits, "r", "q", "c", 2).orderBy("rerank").collect()] == ["a", "b"]
    found = query_filters("x")
    asked = variants(F.col("x"), found, ["mức phạt", "thủ tục"])
    assert values(spark, ["Mức  phạt theo Điều 1.2.TT.3.4?", "gì", None], asked) == [["Mức phạt theo Điều 1.2.TT.3.4?", "Điều 1.2.TT.3.4", "mức phạt Điều 1.2.TT.3.4"], ["gì"], []]
