"""Ground truth, filters, evidence, citations and issuers on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from lexmill.functions.extract import source_note
from lexmill.functions.text import compared, informative_tokens
from lexmill.operators.evaluation import STOP_WORDS, citation_report, filter_hit_rates, relevant_ranks, same_context, truth_matches
from lexmill.functions.session import kept, release, written
from lexmill.operators.corpus import index_documents
from lexmill.operators.search import evidence_status, has_filters, is_strong_hit, passes_filters
from lexmill.operators.skew import split_join
from lexmill.sources.html import html_nodes, section_labels, snapshot_root
from lexmill.sources.index_store import collection_name
from lexmill.sources.records import forgotten


def test_issuers_by_every_way(spark):
    """Stated, named, by joint codes, by a code in the title, by how the note begins, by the number's type."""
    force = ", có hiệu lực thi hành kể từ ngày 01/02/2016)"
    notes = {
        "(Điều 2 Thông tư số 27/2010/TT-BGTVT": "Bộ Giao thông vận tải", "(Điều 1 Luật số 57/2020/QH14": "Quốc hội", "(Điều 1 Luật số 57/2020/QH14 ngày 16/6/2020 của Quốc hội": "Quốc hội",
        "(Điều 1 Thông tư liên tịch số 01/2016/TTLT-TANDTC-VKSNDTC-BTP": "Tòa án nhân dân tối cao; Viện kiểm sát nhân dân tối cao; Bộ Tư pháp",
        "(Điều 2 Quyết định số 01/2012/QĐ -TTg": "Thủ tướng Chính phủ", "(Điều 10 Pháp lệnh Về Hàm, cấp ngoại giao": "Ủy ban Thường vụ Quốc hội",
        "(Điều 1 Nghị quyết số 01/2016/NQ.HĐTP": "Hội đồng Thẩm phán Tòa án nhân dân tối cao", "(Điều 4 Thông tư số 5/2001 của Bộ Y tế ban hành": "Bộ Y tế",
        "(Điều 4 Nghị quyết số 7/2019 ngày 1 tháng 2 năm 2019 của Ban Thường trực": "Ban Thường trực", "(Điều 1 Công văn": "",
    }
    rows = spark.createDataFrame([(n + force, v) for n, v in notes.items()], "x string, v string")
    assert {r.x: r.i for r in rows.select("x", source_note("x")["issuer"].alias("i")).collect()} == {n + force: v for n, v in notes.items()}


def test_same_context_equals_its_definition(spark):
    words = "chủ kho vận phải nộp phí neo đậu theo quy định của bến trong mùa mưa lũ năm nay tại trụ sở".split()
    texts = ["", " ".join(words[:3]), " ".join(words[:8]), " ".join(words), " ".join(words) + " thêm một đoạn", "hoàn toàn khác hẳn nội dung kia", "phí 2020, 2021!"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    told = rows.select("a", "b", compared("a").alias("x"), compared("b").alias("y"), informative_tokens("a", STOP_WORDS).alias("p"), informative_tokens("b", STOP_WORDS).alias("q"))
    for r in told.select("*", same_context(F.col("x"), F.col("p"), F.col("y"), F.col("q")).alias("same")).collect():
        short, long = sorted((r.x, r.y), key=len)
        p, q = set(r.p), set(r.q)
        wanted = bool(r.x and r.y) and (len(short) >= 48 and short in long or bool(p and q) and (len(p & q) >= 12 or len(p & q) / min(len(p), len(q)) >= 0.55))
        assert r.same == wanted, (r.a, r.b)


def test_truth_matches_and_ranks(spark):
    hits = spark.createDataFrame([(1, "p1", 1, "m1", "", "L9", "x"), (1, "p2", 2, "m2", "c2", "L1", "x"), (2, "p3", 1, "", "", "", "một văn bản rất riêng về phí neo đậu ở bến tạm"), (3, "p4", 1, None, None, None, None)], "q int, point_id string, rank int, mapc string, article_code string, law_id string, content string")
    cases = spark.createDataFrame([(1, [], ["c2"], ["L1", ""], [""]), (2, [], [], [], ["Văn bản riêng: phí neo đậu, bến tạm."]), (3, [""], [], None, []), (4, ["m9"], [], [], [])], "q int, mapcs array<string>, article_codes array<string>, law_ids array<string>, contexts array<string>")
    found = {(r.q, r.point_id): r.by for r in truth_matches(hits, cases, "q", ["content"]).collect()}
    assert found == {(1, "p1"): [], (1, "p2"): ["article_code", "law_id"], (2, "p3"): ["context"], (3, "p4"): []}
    assert {r.q: r.first_rank for r in relevant_ranks(truth_matches(hits, cases, "q", ["content"]), cases, "q").collect()} == {1: 2, 2: 1, 4: None}
    assert truth_matches(hits.limit(0), cases, "q", ["content"]).count() == 0


def test_filters_in_both_modes(spark):
    rows = spark.createDataFrame([("a", "Luật  A", "1/2/2020"), ("b", "luật a", None), ("c", "khác", "1/2/2020")], "k string, title string, effective_date string")
    fields = {f: F.col(f) for f in ("title", "effective_date")}

    def passing(mode, **wanted):
        return "".join(sorted(r.k for r in rows.where(passes_filters(fields, {f: F.lit(x) for f, x in wanted.items()}, mode)).collect()))

    assert passing("folded", title="LUẬT A") == "ab" and passing("exact", title="Luật  A") == "a" and passing("folded", title=" ", issuer="") == "abc"
    assert passing("folded", effective_date_from="2020-01-01", effective_date_to="31/12/2020") == "abc" and passing("exact", effective_date_from="2020-01-01") == "ac" and passing("folded", effective_date_to="1/1/2020") == "b"
    assert passing("folded", issuer="X") == ""
    with pytest.raises(ValueError):
        passes_filters(fields, {}, "other")
    asked = spark.createDataFrame([(1, "luật a"), (2, ""), (3, "luật a")], "q int, w string")
    hits = spark.createDataFrame([(1, "Luật A"), (1, "x"), (2, "x")], "q int, title string")
    rates = filter_hit_rates(hits, asked, "q", passes_filters({"title": F.col("title")}, {"title": F.col("w")}), has_filters({"title": F.col("w")}))
    assert {tuple(r) for r in rates.collect()} == {(1, 2, 0.5), (2, 1, None), (3, 0, 0.0)}


def test_evidence_reasons_in_order(spark):
    hits = spark.createDataFrame(
        [("ok", "a", 1.0, "L", "c"), ("ok", "b", 0.5, "L", "d"), ("few", "a", 1.0, "L", "c"), ("one", "a", 1.0, "L", "c"), ("one", "a", 1.0, "L", "c"), ("bare", "a", 1.0, "", " "), ("bare", "b", 1.0, None, ""), ("half", "a", 1.0, "L", ""), ("half", "b", 1.0, "", "c"), ("weak", "a", 0.1, "L", "c"), ("weak", "b", 0.1, "L", "c")],
        "r string, key string, combined double, law_id string, article_code string",
    )
    requests = spark.createDataFrame([(x,) for x in ("ok", "few", "one", "bare", "half", "weak", "none", "none")], "r string")
    found = {r.r: r.status for r in evidence_status(hits, requests, "r", least_hits=2, least_sources=2, structured=True).collect()}
    assert found == {"ok": "ok", "few": "insufficient_results", "one": "low_source_diversity", "bare": "missing_structured_sources", "half": "missing_structured_citations", "weak": "weak_evidence", "none": "no_results"}


def test_citation_report(spark):
    rows = [
        (1, "Theo Điều 5 Luật số 1/2000, phải nộp.", ["Điều 5 - Tên - Luật số 1/2000"], []), (2, "Phải nộp.", ["Điều 5"], None), (3, "Theo Điều 9, phải nộp.", None, ["Điều 5 - Tên"]),
        (4, "Theo pháp luật hiện hành thì phải nộp.", [], []), (5, None, None, None), (6, "Theo Điều 9.", [], []),
    ]
    df = spark.createDataFrame(rows, "k int, a string, s array<string>, e array<string>")
    found = {r.k: (list(r.weak), r.missing, r.citation_ok) for r in citation_report(df, "k", "a", "s", "e").collect()}
    assert found == {1: ([], False, True), 2: ([], True, False), 3: (["Điều 9"], False, False), 4: ([], True, False), 5: ([], False, True), 6: ([], False, True)}


def test_split_join_equals_a_left_join(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), "id")
    facts = spark.createDataFrame([("hot", 1), ("k7", 2), ("k8", None)], "k string, v int")
    wanted = sorted(map(str, rows.join(facts, "k", "left").collect()))
    for share in (2, 100, 10_000):
        assert sorted(map(str, split_join(rows, facts, ["k"], share).collect())) == wanted
    assert split_join(rows.limit(0), facts, ["k"]).count() == 0 and split_join(rows, facts.limit(0), ["k"]).where("v is not null").count() == 0


def test_stores(spark):
    with pytest.raises(ValueError):
        collection_name("a", None, "d", "x", "both")
    states = spark.createDataFrame([("s", "t", 1), ("s", "u", 2)], "session_id string, thread_id string, n int")
    assert [r.n for r in forgotten(states, states.where("thread_id in ('t', 'zz')").select("session_id", "thread_id")).collect()] == [2]


def test_strong_hits(spark):
    names = spark.createDataFrame([(["article_code"],), (["article", "title"],), (["article"],), (["law_id", "title"],), ([],)], "n array<string>")
    assert [r[0] for r in names.select(is_strong_hit(F.col("n"))).collect()] == [True, True, False, False, False]


def test_levels_of_index_documents(spark):
    row = {"file_id": "f", "law_id": "L", "article_code": "c", "article_name": "n", "article": "", "title": "t", "issuer": None, "effective_date": "1/2/2020", "mapc": "m", "de_muc": "", "content": " Nội dung ", "related_articles": ["b", "a", "b"], "p": 1}
    rows = spark.createDataFrame([row, row, row | {"content": "khác", "p": 2, "related_articles": None}], "file_id string, law_id string, article_code string, article_name string, article string, title string, issuer string, effective_date string, mapc string, de_muc string, content string, related_articles array<string>, p int")
    made = index_documents("both", rows, "p", F.lit("k"))
    assert made["chunk"].count() == 2 and set(index_documents("chunk", rows, "p", F.lit("k"))) == {"chunk"}
    article = made["article"].first()
    assert article.content == "Nội dung\n\nkhác" and article.related_articles == ["b", "a"] and article.chunk_count == 3
    with pytest.raises(ValueError):
        index_documents("page", rows, "p", F.lit("k"))


def test_section_labels_and_snapshot_root(spark, tmp_path):
    pages = spark.createDataFrame([("a", "<h3>5.1<br>Thuế<br>x</h3>"), ("b", "<h3> Kho </h3>"), ("c", "<p class='pDieu'>x</p>"), ("d", "")], "k string, h string")
    lookup = spark.createDataFrame([("c", "Tên của c")], "value string, name string")
    assert {r.k: r.de_muc for r in section_labels(html_nodes(pages, "k", "h"), "k", lookup).collect()} == {"a": "5.1 - Thuế", "b": "Kho", "c": "Tên của c", "d": "d"}
    (tmp_path / "demuc").mkdir()
    (tmp_path / "jsonData.js").write_text("x")
    (tmp_path / "demuc" / "a.html").write_text("x")
    found = [snapshot_root(spark, f"file://{p}") for p in (tmp_path, tmp_path / "demuc", tmp_path / "demuc" / "a.html", tmp_path.parent)]
    assert [bool(x) for x in found] == [True, True, True, False] and found[0].rstrip("/").endswith(tmp_path.name)


def test_written_tables_are_released(spark):
    rows = written(spark.range(5), "x")
    path = rows.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert rows.count() == 5 and kept(rows.where("id > 2")).count() == 2 and os.path.isdir(path)
    assert release() >= 2 and not os.path.exists(path) and release() == 0
