"""The operators on training text: brute force, exact round trips and small cases."""

import json
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions.lookalike import consistent, pieces
from lexmill.llm.mixing import mixture
from lexmill.llm.pairs import copies, defective_pairs, ending, is_refusal, language
from lexmill.llm import sentences
from lexmill.llm.sentences import LONGEST, Chain, _last, _rows, _seed, sentence_ends, sentence_units
from lexmill.llm.splitting import oversized_pieces, piece_spans
from lexmill.llm.tokenizer import PATTERN, VOCABULARY, Encoder, encoded, read_ranks
from lexmill.llm.truncation import hidden_limits, text_facts, truncated, truncation_rates
from lexmill.llm.visual import consistent_texts, inconsistent_fields

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")

# --- 5: consistent form ---------------------------------------------------------------------

TEXTS = [
    None, "", "   ", "Quy định về đò", "Quу ðịnh về đò", "kiểm tra", "ｖｉệｃ１．\nx", "“правила перевозки”; а) о đò", "правила о перевозке",
    "规定所称，是指（含）。", "a​​b", "​", "x y\t z \r\n", "5 kΩ α‐amylase Ⅳ", "đ́ d̵o", "Ρhạt" + " từ" * 500, "́bắt đầu", "ﬁ ＡＢ－Ｃ",
    "сао", "со правила", "한국어", "ภาษา พ.ศ.", "×" * 3000 + "о",
]


def test_visual_operator_equals_brute_force(spark):
    rows = spark.createDataFrame([(i, x, "f", 1) for i, x in enumerate(TEXTS)] + [(1, TEXTS[4], "f", 1), (1, TEXTS[4], "f", 1)], "k int, t string, token string, near int")
    got = sorted((r.k, r.value, r.consistent) for r in consistent_texts(rows.select("k", "t"), ["k"], ["t"]).collect() if r.value is not None)
    assert got == sorted([(i, x, consistent(x)) for i, x in enumerate(TEXTS) if x is not None] + [(1, TEXTS[4], consistent(TEXTS[4]))] * 2)
    found = {r.k for r in inconsistent_fields(rows, ["k"], ["t"]).collect()}
    assert found == {i for i, x in enumerate(TEXTS) if x is not None and consistent(x) != x} | {1}
    assert inconsistent_fields(rows.limit(0), ["k"], ["t"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeo ợđðДаоΡ​ ̣́ｖ，中\n1-‐", max_size=40))
def test_consistent_is_idempotent(text):
    assert consistent(consistent(text)) == consistent(text)


def test_both_forms_agree_on_all_planes(spark):
    """Random code points of all planes, joined to letters, symbols and marks: the operator and the per-value form give the same."""
    rnd = random.Random(11)
    planes = [(0x20, 0x24F), (0x300, 0x36F), (0x370, 0x5FF), (0x600, 0xDFF), (0x1780, 0x18AF), (0x1E00, 0x206F), (0x2100, 0x33FF), (0xF900, 0xFFFD), (0x10000, 0x1FAFF), (0x2F800, 0x2FA1D), (0xE0000, 0xE01EF)]
    some = lambda: chr(rnd.randint(*rnd.choice(planes)))
    known = list("aeđдоΡο中，क❤👨\u200d\u200c\ufe0f\u20e31\U0001f3f4\U000e0067 ")
    texts = ["".join(some() if rnd.random() < 0.5 else rnd.choice(known) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    texts += ["x\U000e0061y", "u\U0001d173b", "a\ufe0fb", "❤\ufe0f", "1\ufe0f\u20e3", "न\u200dम", "a\u200db", "\U0001f468\u200d\U0001f469", "\x07a"]
    texts += ["中" * 700 + "，о" + "文" * 500 + "ａ", "a" * 3_000 + "о", "AbC+/0" * 400 + "\u200b", "ก" * 900 + "\u00a0" + "о" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r.k: r.consistent for r in consistent_texts(rows, ["k"], ["t"]).collect()}
    assert {k: v for k, v in found.items() if v != consistent(texts[k])} == {}
    odd = {i for i, x in enumerate(texts) if consistent(x) != x}
    assert {r.k for r in inconsistent_fields(rows, ["k"], ["t"]).collect()} == odd
    assert [consistent(x) for x in ("x\U000e0061y", "u\U0001d173b", "a\ufe0fb", "❤\ufe0f")] == ["xy", "ub", "ab", "❤\ufe0f"]
    assert max(len(p) for x in texts for p, _, _ in pieces(x)) <= 256


# --- 3: truncation --------------------------------------------------------------------------


def point(i, source, content, inner=..., mapc="", raw=None):
    payload = raw if raw is not None else json.dumps({"content": content if inner is ... else inner, "content_truncated": True}, ensure_ascii=False)
    return (f"p{i}", 1, source, mapc, content, payload, "x")


def test_truncation(spark):
    sentence = "Chủ kho vận phải lưu giữ biên bản giao nhận."
    long = (sentence + " ") * 40
    rows = [
        point(0, "a", sentence), point(1, "a", None, None), point(2, "a", ""), point(3, "a", "Nơi nhận:\n- Lưu: VT, PC"), point(4, "a", "Mức 1: 5.000 đồng/tháng"),
        point(5, "a", "Chủ kho vận phải lưu giữ biên b"), point(6, "a", "Chủ kho vận phải lưu giữ biên b�"), point(7, "a", "Gồm biên bản, sổ, phiếu…"),
        point(8, "a", sentence, raw='{"content": "Chủ kho'), point(9, "a", "Chủ kho vận phải…", sentence), point(10, "a", "Chủ kho v�n phải nộp."),
        point(11, "a", "không dấu chấm", mapc="m1"), point(12, "a", "Phạt tiền từ 13.000."), point(13, "a", sentence + " " + sentence, sentence + " Chủ kho"),
    ]
    rows += [point(100 + i, "b", long[:1000] if i % 2 else long[: 1000 - 1] + "x", long) for i in range(8)] + [point(200, "b", sentence)]
    rows += rows[:9]
    points = spark.createDataFrame(rows, "point_id string, snapshot_no int, source string, mapc string, content string, payload string, field string")
    articles = spark.createDataFrame([("m1", "đầu\nkhông  dấu chấm "), ("m1", None), (None, "x")], "mapc string, raw_content string")
    found = {tuple(r) for r in truncated(points, articles).collect()}
    small = {x for x in found if int(x[0][1:]) < 100}
    assert small == {("p5", "content"), ("p5", "payload"), ("p6", "content"), ("p6", "payload"), ("p8", "payload"), ("p9", "content"), ("p12", "content"), ("p12", "payload"), ("p13", "payload")}
    assert {x for x in found if int(x[0][1:]) >= 100} == {(f"p{100 + i}", "content") for i in range(8)}
    limits = {(r.source, r.field): (r.measure, r.limit) for r in hidden_limits(text_facts(points)).collect()}
    assert limits[("b", "content")] == ("characters", 1000) and ("a", "content") not in limits
    rates = {(r.source, r.field): (r.n_texts, r.n_truncated) for r in truncation_rates(points, truncated(points, articles)).collect()}
    assert rates[("b", "content")] == (9, 8)
    # A longer exempt value hides no limit, and a second limit below the first is found.
    more = [point(300 + i, "c", long[:1000], long) for i in range(4)] + [point(320, "c", long)] + [point(400 + i, "d", "x" * (900 + 3 * i)) for i in range(5)]
    more += [point(500 + i, "d", ("abc " * 900)[: 2_000 if i % 2 else 1_200] + "x") for i in range(60)]
    more = spark.createDataFrame(more, points.schema)
    found_limits = {(r.source, r.limit) for r in hidden_limits(text_facts(more)).where("field = 'content'").collect()}
    assert found_limits == {("c", 1000), ("d", 1201), ("d", 2001)}
    # A line longer than any window of characters is judged whole; JSON that only looks whole in part is not.
    lines = [point(600, "e", "- Lưu: " + "phòng ban " * 60 + "VT"), point(601, "e", "Mức 1: 5.000 đồng/tháng"), point(602, "e", sentence, raw='{"content": "a", "x": [1, 2}'), point(603, "e", sentence, raw='{"content": "' + sentence + '", "x": 1')]
    assert {tuple(r) for r in truncated(spark.createDataFrame(lines, points.schema), articles).collect()} == {("p603", "payload")}
    assert truncated(points.limit(0), articles.limit(0)).count() == 0


# --- 4: pairs -------------------------------------------------------------------------------


def test_pairs(spark):
    q, full = "Thời hạn gia hạn giấy phép bến tạm là bao lâu?", "Theo khoản 1 Điều 3, chủ kho vận phải gia hạn trong vòng 5 ngày."
    rows = [
        (1, "ok", q, full, ["Điều 1 - Tên - Luật - Quốc hội, 01/01/2020"], None), (2, "ok", q, None, None, "empty"), (3, "ok", q, "1. Kết luận\n\n2. Cơ sở pháp lý\n", None, "empty"),
        (4, "need_clarify", q, "", None, None), (5, "ok", q, "THOI HAN GIA HAN GIAY PHEP BEN TAM LA BAO LAU", None, "copied_question"), (6, "ok", q, f"Bạn hỏi: “{q}” {full}", None, None),
        (7, "ok", q, "Rất tiếc, tôi không thể giải đáp câu hỏi này. Mong bạn thông cảm.", None, "refusal"), (8, "ok", q, "Xin lỗi vì phản hồi chậm. " + full, None, None),
        (9, "ok", q, full + " Chủ kho vận phải gia h", None, "truncated"), (10, "ok", q, "The salt works must publish the service price before the day.", None, "other_language"),
        (11, "ok", "Dịch sang tiếng Anh: Chủ kho phải nộp.", "The owner must pay the fee.", None, None), (12, "ok", q, "Có.", None, None), (13, "ok", q, "59.500.000 đồng", None, None),
        (14, "ok", q, full + "\n\n2. Cơ sở pháp lý\n- Điều 1 - Tên - Luật - Quốc hội, 01/01/2020", ["Điều 1 - Tên - Luật - Quốc hội, 01/01/2020"], None),
        (15, "ok", q, full + "\n\n2. Cơ sở pháp lý\n- Điều 1 - Tên - Lu", ["Điều 1 - Tên - Luật - Quốc hội, 01/01/2020"], "truncated"), (16, None, None, full, None, None),
        (17, "ok", q, "Theo khoan 1 Dieu 3, chu kho van phai gia han trong vong 5 ngay.", None, None), (None, "ok", q, "", None, None), (18, "ok", q, full * 3_000, None, None),
    ]
    data = [r[:5] + ("x",) for r in rows] + [rows[1][:5] + ("x",)]
    found = {r.chat_id: r.defect_type for r in defective_pairs(spark.createDataFrame(data, "chat_id long, status string, question string, final_answer string, sources array<string>, type string")).collect()}
    assert found == {r[0]: r[5] for r in rows if r[5]}


def test_pair_helpers():
    assert copies("What is the fine for mooring?", "Question: what is the fine for mooring") and not copies("What is the fine?", "It is 5 dong.")
    assert is_refusal("I would rather not comment on that point.") and not is_refusal("Tôi không thể khẳng định cho mọi trường hợp, nhưng theo khoản 1.")
    assert [language(x) for x in ("Who may renew the permit?", "Muc phat doi voi hanh vi", "Кто подписывает?", "谁签字？", "誰がする", "Der Prüfer und die Gebühr ist", "Le tarif est de la vanne", "12")] == ["en", "vi", "ru", "zh", "ja", "de", "fr", ""]
    assert [ending(x, []) for x in ("Xong.", "Điều 59.", "Điều 41.8.", "dở dang ở giữa chừng của một câu rất dài mà không ai viết cho hết", "A, B, C…")] == ["whole", "whole", "cut", "bare", "list"]


def test_pairs_know_no_length_limits():
    """Short questions, long refusals and long unmarked answers are judged as any other; several Latin languages are told apart."""
    assert copies("Phí?", "Phí?") and not copies("Phí?", "Có.") and not copies("?", "?")
    assert is_refusal("Rất tiếc, tôi không thể giải đáp câu hỏi này. " * 40) and not is_refusal("Rất tiếc, tôi không thể giải đáp câu hỏi này. " * 40 + "Phí là 5 đồng.")
    texts = ["El plazo es de cinco días según la ley", "Il termine è di cinque giorni secondo la legge", "O prazo é de cinco dias segundo a lei", "Siapa yang harus membayar biaya ini", "Le délai est de cinq jours selon la loi", "Chủ kho phải nộp phí trong 5 ngày"]
    assert [language(x) for x in texts] == ["es", "it", "pt", "id", "fr", "vi"]


def test_unmarked_answers_are_told_by_the_context_model(spark):
    """The same unmarked ending is complete where the corpus ends sentences so, and cut where it goes on, at any length."""
    long = "Theo khoản 1 Điều 3, chủ kho vận phải gia hạn giấy phép và nộp phí trong vòng năm ngày kể từ khi có kết quả, "
    rows = [(1, "ok", "Ai nộp?", long + "do cấp tỉnh"), (2, "ok", "Ai nộp?", long + "do chủ kho"), (3, "ok", "Ai nộp?", long + "do cấp tỉ"), (4, "ok", "Ai nộp?", "Do cấp tỉnh")]
    rows += [(100 + i, "ok", "Ai nộp?", f"Việc thứ {i} do cấp tỉnh. Phí do chủ kho vận trả.") for i in range(20)]
    df = spark.createDataFrame(rows, "chat_id long, status string, question string, final_answer string").withColumn("sources", F.array().cast("array<string>"))
    assert {tuple(r) for r in defective_pairs(df).collect()} == {(2, "truncated"), (3, "truncated")}


# --- 6: splitting ---------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab đ.;\ń", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_cover_and_stay_under_the_limit(text, size, overlap):
    spans = piece_spans(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= min(overlap, size - 1)
    assert len(spans) <= 1 if len(text) <= size else len(spans) > 1


def test_pieces_end_at_natural_boundaries(spark):
    text = "Một câu ngắn. Câu thứ hai dài hơn. " * 20
    for a, b in piece_spans(text, 100, 20)[:-1]:
        assert text[:b].endswith(". ")
        assert a == 0 or text[a - 1] == " "
    # An overlap above half the size is honoured, sentences that fit a piece stay whole, and pieces begin with sentences.
    assert {b - c for (_, b), (c, _) in zip(piece_spans("x" * 100, 10, 9), piece_spans("x" * 100, 10, 9)[1:])} == {9}
    spans = piece_spans(text, 60, 45)
    assert all(text[:b].endswith(". ") and (a == 0 or text[:a].endswith(". ")) for a, b in spans) and any(c < b for (_, b), (c, _) in zip(spans, spans[1:]))
    rows = spark.createDataFrame([("a", text, 1), ("a", text, 1), ("b", "", 1), ("c", None, 1), ("d", "x" * 250_000, 1)], "mapc string, raw string, piece_no int")
    found = oversized_pieces(rows, ["mapc"], "raw", [(1, 100, 20), (2, 300_000, 0)])
    assert {r.mapc for r in found.select("mapc").distinct().collect()} == {"a", "d"}
    assert {r.config_id for r in found.collect()} == {1}
    assert all(r.piece == ("x" * 250_000)[r.start_pos : r.end_pos] for r in found.where("mapc = 'd'").collect())
    assert found.where("mapc = 'a' and piece_no = 1").count() == 1
    assert oversized_pieces(rows, ["mapc"], "raw", []).count() == 0


# --- 7: encoding ----------------------------------------------------------------------------


@needs_vocabulary
def test_encoding_equals_the_public_library():
    import tiktoken

    ranks = read_ranks(VOCABULARY)
    ours, theirs = Encoder(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    alphabet = "abcdehinors  '.,01\n\tÀđợ中国のแ한😀<|>"
    texts = ["", " ", "<|endoftext|>", "a" * 300, "the " * 40, "ợ" * 500] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0xA0, 0x2FFF), rnd.randint(0x4E00, 0x9FFF)])) for _ in range(40)) for _ in range(300)]
    for text in texts:
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text), text
        assert "".join(ours.decode(ids)) == text


@needs_vocabulary
def test_decoding_of_broken_bytes():
    encoder = Encoder(read_ranks(VOCABULARY))
    byte = {bytes([b]): i for b in range(256) for i in [encoder.transducer.ranks[bytes([b])]]}
    assert "".join(encoder.decode([byte[b"\xe1"], byte[b"\xbb"], byte[b"a"]])) == "�a"
    assert "".join(encoder.decode([byte[b"\xff"], byte[b"b"], byte[b"\xc3"]])) == "�b�"


@needs_vocabulary
def test_encoded_rows(spark):
    docs = spark.createDataFrame([(1, "một hai", 9), (1, "một hai", 9), (2, None, 9), (3, "", 9), (4, "  ", 9), (5, "đò " * 60_000, 9)], "doc_id long, text string, ids int")
    rows = encoded(docs, check="same").orderBy("doc_id").collect()
    assert [len(r.ids) > 0 for r in rows] == [True, True, False, False, True, True] and all(r.same for r in rows)
    assert encoded(docs.limit(0)).count() == 0


# --- 8: mixing ------------------------------------------------------------------------------


def test_mixture_reaches_its_shares(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").when(F.col("id") % 20 == 9, "small").otherwise(None).alias("source"), (F.col("id") % 97 + 1).alias("n"), F.lit(1).alias("copies"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    taken, shares = mixture(docs, targets, key="doc_id", size="n")
    found = {r.source: r for r in shares.collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(found[s].actual_share - share) < 0.001
    assert found["none"].actual_share == 0
    most = {r.source: r.m for r in taken.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["small"] <= 3 and most["big"] == most["mid"] == 1 and None not in most
    # Longer records are likelier: drawn in proportion to their size, the certain ones all.
    mean = {r.source: r.n for r in taken.join(docs.select("doc_id", "n"), "doc_id").groupBy("source").agg(F.avg("n").alias("n")).collect()}
    assert mean["big"] > 55 > 50 > docs.where("source = 'big'").agg(F.avg("n")).first()[0] - 1
    assert all(abs(r.mixed_size - r.target_share / 1.0 * sum(x.mixed_size for x in found.values())) <= 2 * 97 for r in found.values())
    again = mixture(docs.repartition(7), targets, key="doc_id", size="n")[0]
    assert again.exceptAll(taken).count() == 0
    assert mixture(docs.limit(0), targets, key="doc_id", size="n")[0].count() == 0
    uneven = spark.createDataFrame([(1, "big", None), (2, "big", 5), (2, "big", 5), (3, "mid", 0)], "doc_id long, source string, n long")
    assert {r.source: r.mixed_size for r in mixture(uneven, targets, key="doc_id", size="n")[1].collect()}["big"] == 10


# --- 9: sentences ---------------------------------------------------------------------------

TRAINING = ["Hội đồng đến TP. Hà Lũng. Theo ThS. H. thì đúng. Chủ kho nộp phí.", "Chủ kho nộp phí.\nHội đồng họp.\nTheo luật.\nBên thuê trả.", "Bên thuê đến TP. Tân Khê. Hội đồng họp.", "Hội đồng đến TP. Hà Lũng.\nChủ kho đến TP. Tân Khê."] * 40
WRAPPED = "Hội đồng họp về việc nộp phí của các bên thuê bến và các\nchủ kho trong mùa mưa lũ năm nay tại trụ sở của ủy ban. Chủ\nkho nộp phí."
CASES = {
    "Hội đồng đến TP. Hà Lũng. Chủ kho nộp 5.000.000 đồng. Theo ThS. H. thì đúng.": ["Hội đồng đến TP. Hà Lũng.", "Chủ kho nộp 5.000.000 đồng.", "Theo ThS. H. thì đúng."],
    "Điều 7. Tên điều\n1. Hội đồng họp; chủ kho nộp.\na) Bên thuê trả:\n\n- Lưu: VT.": ["Điều 7. Tên điều", "1. Hội đồng họp; chủ kho nộp.", "a) Bên thuê trả:", "- Lưu: VT."],
    "Hỏi: “Ai nộp? Khi nào?” và được trả lời. Bên thuê trả.Chủ kho nộp.": ["Hỏi: “Ai nộp? Khi nào?” và được trả lời.", "Bên thuê trả.", "Chủ kho nộp."],
    "严禁擅自开闸！检查员问：“谁？何时？”。完。": ["严禁擅自开闸！", "检查员问：“谁？何时？”。", "完。"],
    "ห้ามเปิด ตามมาตรา 5 แห่ง พ.ศ. 2561 ให้ส่ง ถามว่า “ใคร เมื่อใด” แล้วจด": ["ห้ามเปิด", "ตามมาตรา 5 แห่ง พ.ศ. 2561 ให้ส่ง", "ถามว่า “ใคร เมื่อใด” แล้วจด"],
    WRAPPED: [WRAPPED[: WRAPPED.index("ban.") + 4], "Chủ\nkho nộp phí."],
    " \n\t": [], "": [],
}


def units_of(spark, texts, training):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: r.ends for r in sentence_ends(docs, "i", training=spark.createDataFrame([(x,) for x in training], "text string")).collect()}
    return [[x[a:b].strip() for a, b in zip([0, *found.get(i, [])], found.get(i, []))] for i, x in enumerate(texts)]


def test_sentence_cases(spark):
    assert dict(zip(CASES, units_of(spark, list(CASES), TRAINING))) == CASES


def local_ends(text):
    """Ends by the chain's first scores, without counts."""
    rows = sorted({(at, kind) for at, kind, *_ in _rows(text, defaultdict(Counter)) if at is not None})
    gains = [_seed(kind, 0.0, 0.0) for _, kind in rows]
    cells = [{"break": -1, "bare": -2}.get(kind, i) for i, (_, kind) in enumerate(rows)]
    return [at for (at, _), tag in zip(rows, Chain(gains, np.zeros(LONGEST + 1)).tags([at for at, _ in rows], cells, [-1.0] * len(rows))) if tag]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?…\n“”()。中文ก1:", max_size=60))
def test_units_cover_all_visible_text(text):
    ends = local_ends(text)
    assert ends == sorted(set(ends))
    assert bool(ends) == bool(text.strip())
    if ends:
        assert not text[ends[-1] :].strip()
        at = 0
        for end in ends:
            assert text[at:end].strip() and not text[end - 1].isspace()
            at = end


def test_sentence_rows(spark):
    docs = spark.createDataFrame([(1, TRAINING[0], 1), (1, TRAINING[0], 1), (2, None, 1), (3, "", 1), (4, "Chủ kho nộp phí. " * 20_000, 1), (None, "Chủ kho nộp phí.", 1)], "doc_id long, text string, ends int")
    found = {(r.doc_id, r.n) for r in sentence_units(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {x[0] for x in found} == {1, 4, None} and (4, 20_000) in found
    assert sentence_ends(docs, "doc_id").count() == 3
    assert sentence_units(docs.limit(0), "doc_id").count() == 0


def test_rare_contexts_count_as_much_as_frequent_ones(spark, monkeypatch):
    """Looked up by a shuffle instead of a broadcast, contexts say the same."""
    docs = spark.createDataFrame(list(enumerate([*TRAINING, *CASES])), "doc_id int, text string")
    one = set(map(tuple, sentence_units(docs, "doc_id").collect()))
    monkeypatch.setattr(sentences, "HEAVY_SHARE", 4)
    assert set(map(tuple, sentence_units(docs, "doc_id").collect())) == one


def test_long_words_have_keys_of_their_own():
    word = "x" * 40
    assert _last(f"một {word}a.", 0, 45) == word + "a" != _last(f"một {word}b.", 0, 45)
    assert _last("y" * 500 + ".", 0, 500) == "y" * 500


def accuracy(found, wanted):
    right = sum(len(f & w) for f, w in zip(found, wanted))
    return 2 * right / (sum(map(len, found)) + sum(map(len, wanted)))


def test_model_held_out_accuracy(spark):
    """Trained on one half of made sentences, the other half's boundaries come out."""
    rnd = random.Random(5)
    names = ["Hà Lũng", "Tân Khê", "Vĩnh Hạ"]
    make = lambda: rnd.choice(["Chủ kho đến TP. {} nộp phí", "Hội đồng gửi văn bản cho ThS. H. của viện", "Bên thuê trả 5.000 đồng, v.v. và ra về", "Kiểm định viên làm việc tại Q. {} từ 8h.30"]).format(rnd.choice(names)) + "."
    train = [rnd.choice([" ", "\n"]).join(make() for _ in range(4)) for _ in range(300)]
    held = [[make() for _ in range(5)] for _ in range(200)]
    got = units_of(spark, [" ".join(parts) for parts in held], train)
    assert sum(a == b for a, b in zip(got, held)) > 0.98 * len(held)


SCRIPTS = {
    "zh": (["渡船船主", "盐场", "仓储经营者", "发证机关", "泵站"], ["应当", "必须", "可以", "不得"], ["公布服务价格", "填写库存台账", "移交检验档案", "提交称重报告"], "。"),
    "ja": (["船主は", "製塩所は", "倉庫業者は", "許可機関は"], ["価格を", "台帳を", "書類を"], ["公表しなければならない", "提出することができる", "記入するものとする"], "。"),
    "km": (["ម្ចាស់សាឡាង", "អាជ្ញាធរ", "ម្ចាស់ឃ្លាំង"], ["ត្រូវ", "អាច", "មិនត្រូវ"], ["ប្រកាសតម្លៃសេវា", "បំពេញបញ្ជី", "ដាក់របាយការណ៍ថ្លឹង"], "។"),
    "th": (["เจ้าของเรือ", "โรงเกลือ", "ผู้ประกอบการ"], ["ต้อง", "อาจ", "ห้าม"], ["ประกาศราคา", "กรอกบัญชี", "ส่งรายงาน"], " "),
}


def test_unmarked_scripts_held_out_accuracy(spark):
    """Trained on punctuated text, text of the same script without a single mark is cut; the figures are in the README."""
    rnd = random.Random(7)
    train, held, wanted = [], [], []
    for subjects, verbs, objects, mark in SCRIPTS.values():
        make = lambda: "".join(map(rnd.choice, (subjects, verbs, objects)))  # noqa: B023, E731
        train += [mark.join(make() for _ in range(6)) + mark.strip() for _ in range(150)]
        for _ in range(25):
            parts = [make() for _ in range(4)]
            held.append("".join(parts))
            wanted.append({len("".join(parts[: i + 1])) for i in range(4)})
    docs = spark.createDataFrame(list(enumerate(held)), "i int, text string")
    found = {r.i: set(r.ends) for r in sentence_ends(docs, "i", training=spark.createDataFrame([(x,) for x in train], "text string")).collect()}
    for n, name in enumerate(SCRIPTS):
        of = range(25 * n, 25 * n + 25)
        score = accuracy([found[i] for i in of], [wanted[i] for i in of])
        print(name, round(score, 4))
        assert score > 0.95, name
