"""Metadata out of statute text, by pattern."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import clean_text, collapse, text, tidy

# Types of law, forms of dates, issuers and their codes.
LAW_TYPES = ["Bộ luật", "Luật", "Pháp lệnh", "Nghị quyết liên tịch", "Nghị quyết", "Nghị định", "Thông tư liên tịch", "Thông tư", "Quyết định", "Chỉ thị", "Lệnh"]
LAW_ID = "(?:" + "|".join(LAW_TYPES) + r") số\s+[^\s,()]+"
ARTICLE_TITLE = r"^(Điều\s+[0-9A-Za-zÀ-ỹ.\-]+\.)\s*(.*)$"
IN_FORCE = ["có hiệu lực thi hành kể từ ngày", "có hiệu lực kể từ ngày", "có hiệu lực từ ngày"]
ISSUER_NAMES = [
    "Chủ tịch nước", "Ủy ban Thường vụ Quốc hội", "Quốc hội", "Chính phủ", "Thủ tướng Chính phủ", "Bộ Công an", "Bộ Quốc phòng", "Bộ Nội vụ",
    "Bộ Tư pháp", "Bộ Tài chính", "Bộ Kế hoạch và Đầu tư", "Bộ Công Thương", "Bộ Nông nghiệp và Phát triển nông thôn", "Bộ Giao thông vận tải",
    "Bộ Xây dựng", "Bộ Tài nguyên và Môi trường", "Bộ Thông tin và Truyền thông", "Bộ Giáo dục và Đào tạo", "Bộ Y tế",
    "Bộ Lao động - Thương binh và Xã hội", "Bộ Văn hóa, Thể thao và Du lịch", "Bộ Khoa học và Công nghệ", "Bộ Ngoại giao",
    "Ngân hàng Nhà nước Việt Nam", "Tòa án nhân dân tối cao", "Viện kiểm sát nhân dân tối cao", "Ủy ban nhân dân", "Hội đồng nhân dân",
]
ISSUERS = {
    "QH": "Quốc hội", "UBTVQH": "Ủy ban Thường vụ Quốc hội", "CP": "Chính phủ", "TTG": "Thủ tướng Chính phủ",
    "HĐTP": "Hội đồng Thẩm phán Tòa án nhân dân tối cao", "CTN": "Chủ tịch nước", "BCA": "Bộ Công an", "BQP": "Bộ Quốc phòng",
    "BNV": "Bộ Nội vụ", "BTP": "Bộ Tư pháp", "TC": "Bộ Tài chính", "TCT": "Tổng cục Thuế", "BTC": "Bộ Tài chính",
    "BKHĐT": "Bộ Kế hoạch và Đầu tư", "BCT": "Bộ Công Thương", "BNN": "Bộ Nông nghiệp và Phát triển nông thôn",
    "BNNPTTN": "Bộ Nông nghiệp và Phát triển nông thôn", "BNNPTNT": "Bộ Nông nghiệp và Phát triển nông thôn", "BGTVT": "Bộ Giao thông vận tải",
    "BXD": "Bộ Xây dựng", "BTNMT": "Bộ Tài nguyên và Môi trường", "BTTTT": "Bộ Thông tin và Truyền thông", "BGDĐT": "Bộ Giáo dục và Đào tạo",
    "BYT": "Bộ Y tế", "BLĐTBXH": "Bộ Lao động - Thương binh và Xã hội", "BVHTTDL": "Bộ Văn hóa, Thể thao và Du lịch",
    "BKHCN": "Bộ Khoa học và Công nghệ", "BNG": "Bộ Ngoại giao", "NHNN": "Ngân hàng Nhà nước Việt Nam", "UBTDTT": "Ủy ban Thể dục thể thao",
    "TANDTC": "Tòa án nhân dân tối cao", "VKSNDTC": "Viện kiểm sát nhân dân tối cao", "UBND": "Ủy ban nhân dân", "HĐND": "Hội đồng nhân dân",
}
#: How a note, without its article, begins, with a part it must have; and the same of a law's number in capitals.
NOTE_STARTS = [
    ("pháp lệnh", "", "Ủy ban Thường vụ Quốc hội"), ("lệnh", "", "Chủ tịch nước"), ("nghị định", "", "Chính phủ"), ("luật", "", "Quốc hội"), ("bộ luật", "", "Quốc hội"),
    ("quyết định", "-ttg", "Thủ tướng Chính phủ"), ("nghị quyết", "hđtp", "Hội đồng Thẩm phán Tòa án nhân dân tối cao"), ("nghị quyết", "hội đồng thẩm phán", "Hội đồng Thẩm phán Tòa án nhân dân tối cao"),
]
LAW_STARTS = [
    ("BỘ LUẬT SỐ", "", "Quốc hội"), ("LUẬT SỐ", "", "Quốc hội"), ("PHÁP LỆNH SỐ", "", "Ủy ban Thường vụ Quốc hội"), ("LỆNH SỐ", "", "Chủ tịch nước"), ("NGHỊ ĐỊNH SỐ", "", "Chính phủ"),
    ("NGHỊ QUYẾT SỐ", "HĐND", "Hội đồng nhân dân"), ("NGHỊ QUYẾT SỐ", "QH", "Quốc hội"), ("QUYẾT ĐỊNH SỐ", "TTG", "Thủ tướng Chính phủ"), ("CHỈ THỊ SỐ", "TTG", "Thủ tướng Chính phủ"),
]
NOTE_DATE = r"ngày\s+(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})"


def title_parts(col: Column | str) -> tuple[Column, Column]:
    """(code with its dot, name) of an article heading; a heading of another form is all code."""
    x = tidy(col)
    code = F.regexp_extract(x, f"(?iu){ARTICLE_TITLE}", 1)
    return F.when(code == "", x).otherwise(code), F.when(code == "", F.lit("")).otherwise(F.regexp_extract(x, f"(?iu){ARTICLE_TITLE}", 2))


def law_id(col: Column | str) -> Column:
    """First law named in a text, "" if none."""
    return F.regexp_extract(text(col), f"(?iu){LAW_ID}", 0)


def article_no(col: Column | str) -> Column:
    """First ``Điều n`` of a text."""
    return F.regexp_extract(text(col), r"(?iu)Điều\s+\d+[A-Za-zÀ-ỹ\-]*", 0)


def effective_date(col: Column | str) -> Column:
    """dd/mm/yyyy from which a note says that a law is in force: numeric forms first, then worded ones; "" if none."""
    x = text(col)
    numeric = [F.nullif(F.regexp_extract(x, rf"(?iu){p}\s+(\d{{1,2}}/\d{{1,2}}/\d{{4}})", 1), F.lit("")) for p in IN_FORCE]
    worded = []
    for p in IN_FORCE:
        form = rf"(?iu){p}\s+(\d{{1,2}})\s+tháng\s+(\d{{1,2}})\s+năm\s+(\d{{4}})"
        d, m, y = (F.regexp_extract(x, form, i) for i in (1, 2, 3))
        worded.append(F.when(y != "", F.concat_ws("/", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y)))
    return F.coalesce(*numeric, *worded, F.lit(""))


def title_of_law(note: Column) -> Column:
    """What a note says between the law and its date or force clause."""
    tail = F.regexp_extract(note, f"(?iu){LAW_ID}(.*)", 1)
    cut = F.regexp_replace(tail, r"(?iu)(ngày\s+(\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})|,\s*(có|hết) hiệu lực).*", "")
    return F.regexp_replace(cut, r"^[ ,;:\-]+|[ ,;:\-]+$", "")


def issuers_by_code(col: Column | str, codes: dict[str, str] = ISSUERS) -> Column:
    """Issuers whose codes occur in a law's number, each once, in the order of the codes, joined by "; "."""
    names = F.create_map(*[F.lit(x) for x in chain(*codes.items())])
    parts = F.split(F.upper(collapse(col)), r"[^0-9A-ZÀ-ỸĐ]+")
    named = F.transform(parts, lambda x: F.when(x.startswith("UBTVQH"), names[F.lit("UBTVQH")]).when(x.rlike(r"^QH\d*\z"), names[F.lit("QH")]).otherwise(F.try_element_at(names, x)))
    return F.array_join(F.array_distinct(F.filter(named, lambda x: x.isNotNull())), "; ")


def _by_start(x: Column, starts: list[tuple[str, str, str]], whole: Column) -> Column:
    return F.coalesce(*[F.when(x.startswith(start) & F.contains(whole, F.lit(part)), F.lit(name)) for start, part, name in starts])


def issuer_of_note(note: Column, law: Column, title: Column | None = None, codes: dict[str, str] = ISSUERS) -> Column:
    """Issuer of a law as its source note tells it, by the first way that tells:

    stated behind the last date before the force clause (``ngày … của X``); a known name in the note; codes in the
    law's number, else in its title; how the note begins; how the law's number begins.
    """
    before = F.split(note, r"(?iu),\s*(?:có hiệu lực|hết hiệu lực)", 2)[0]
    tail = F.trim(F.regexp_extract(before, rf"(?isu)^.*{NOTE_DATE}(.*)$", 1))
    stated = F.when(F.lower(tail).startswith("của "), tidy(F.substring(tail, 5, F.length(tail))))
    name = F.coalesce(*[F.when(F.contains(note, F.lit(x)), F.lit(x)) for x in ISSUER_NAMES])
    by_code = [F.nullif(issuers_by_code(x, codes), F.lit("")) for x in ([law] if title is None else [law, title])]
    lower = F.lower(note)
    structure = _by_start(F.trim(F.regexp_replace(lower, r"(?u)^điều\s+[0-9a-zà-ỹ.\-]+\s+", "")), NOTE_STARTS, lower)
    number = F.upper(collapse(law))
    return F.coalesce(F.nullif(stated, F.lit("")), name, *by_code, structure, _by_start(number, LAW_STARTS, number), F.lit(""))


def source_note(col: Column | str) -> dict[str, Column]:
    """law_id, title, article, issuer and effective_date of an article's source note."""
    note = F.regexp_replace(clean_text(col), r"^[() ]+|[() ]+$", "")
    law, title = law_id(note), title_of_law(note)
    return {"law_id": law, "title": title, "article": article_no(note), "issuer": issuer_of_note(note, law, title), "effective_date": effective_date(note)}


# How questions name a law by its title, what ends it, sections, and issuers.
TITLED = "Luật|Bộ luật|Nghị định|Thông tư"
AFTER_TITLE = "quy định|là gì|được quy định|nói gì|thế nào|ra sao"
TITLE = rf"(?:^|[^\p{{L}}\p{{N}}_])((?:{TITLED})\s+[A-ZÀ-Ỵ][A-Za-zÀ-ỹ0-9\s\-]*?)(?:\s+(?:{AFTER_TITLE})(?:[^\p{{L}}\p{{N}}_]|$)|[,.?;:]|$)"
SECTION = r"Đề mục\s+[0-9A-Za-z.\-]+(?:\s*-\s*[^,.;]+)?"
ASKED_ISSUERS = [
    "Quốc hội", "Chính phủ", "Ủy ban Thường vụ Quốc hội", "Thủ tướng Chính phủ", "Bộ Công an", "Bộ Tư pháp", "Bộ Tài chính", "Bộ Giáo dục và Đào tạo",
    "Bộ Lao động - Thương binh và Xã hội", "Bộ Y tế", "Tòa án nhân dân tối cao", "Viện kiểm sát nhân dân tối cao",
]


def query_filters(col: Column | str) -> dict[str, Column]:
    """Metadata a question names, each "" if it does not.

    law_id, article_code (``Điều a.b.XX.c.d``), article (``Điều n``), effective_date where the question is about force, title of
    a law (a question that begins with ``Luật`` and names no number is all title), de_muc, and the first known issuer.
    """
    x = collapse(col)
    law = law_id(x)
    code = F.upper(F.regexp_extract(x, r"(?iu)Điều (\d+\.\d+\.[A-ZĐ]+\.\d+\.\d+)", 1))
    plain = F.regexp_extract(x, r"(?iu)Điều (\d+)(?:[^.\dA-Za-z]|\.?$)", 1)
    date = F.when(F.lower(x).contains("hiệu lực"), F.regexp_extract(x, r"\d{1,2}/\d{1,2}/\d{4}", 0)).otherwise("")
    signs = F.lit(" ,.;:")
    titled = F.btrim(F.regexp_extract(x, f"(?iu){TITLE}", 1), signs)
    title = F.when(titled != "", titled).when((law == "") & F.lower(x).startswith("luật "), F.btrim(x, signs)).otherwise("")
    issuer = F.coalesce(*[F.when(F.contains(F.lower(x), F.lit(name.lower())), F.lit(name)) for name in ASKED_ISSUERS], F.lit(""))
    return {
        "law_id": law,
        "article_code": F.when(code != "", F.concat(F.lit("Điều "), code)).otherwise(""),
        "article": F.when((code == "") & (plain != ""), F.concat(F.lit("Điều "), plain)).otherwise(""),
        "effective_date": date,
        "title": title,
        "de_muc": F.trim(F.regexp_extract(x, f"(?iu){SECTION}", 0)),
        "issuer": issuer,
    }


def query_features(filters: dict[str, Column], question: Column) -> dict[str, Column]:
    """What a question refers to, as eight flags."""
    x = folded_question(question)
    has = {f"has_{name}": filters[field] != "" for name, field in (("article_ref", "article"), ("article_code", "article_code"), ("law_title", "title"), ("law_id", "law_id"), ("de_muc", "de_muc"))}
    structured = has["has_article_ref"] | has["has_article_code"] | has["has_law_title"] | has["has_law_id"]
    return has | {"is_structured": structured, "mentions_quy_dinh": F.contains(x, F.lit("quy định")), "mentions_la_gi": F.contains(x, F.lit("là gì"))}


def folded_question(question: Column) -> Column:
    return F.lower(collapse(question))


# Parts of citations in answers.
CITED_ARTICLE = r"Điều\s+[0-9A-Za-z.\-]+"
CITED_CLAUSE, CITED_POINT = r"Khoản\s+\d+", r"Điểm\s+[a-zđ]"
CITED_LAW = r"(?:Luật|Bộ luật|Nghị định|Thông tư) số\s+[^\s,.;)]+"
GENERIC = r"theo quy định pháp luật|theo pháp luật hiện hành|theo quy định hiện hành"
#: Characters behind an article in which its clause, point and law are looked for.
BEHIND = 80


def citations(col: Column | str) -> Column:
    """Distinct citations of a text in order: each article with the clause, point and law named in the 80 characters behind it, then laws."""
    x = collapse(col)
    pattern = F.lit(rf"(?iu)({CITED_ARTICLE})(?=(.{{0,{BEHIND}}}))")
    pairs = F.arrays_zip(F.regexp_extract_all(x, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(x, pattern, F.lit(2)).alias("t"))

    def part(t: Column, of: str) -> Column:
        return F.nullif(F.regexp_extract(t, f"(?iu){of}", 0), F.lit(""))

    articles = F.transform(pairs, lambda p: F.concat_ws(", ", p["a"], part(p["t"], CITED_CLAUSE), part(p["t"], CITED_POINT), part(p["t"], CITED_LAW)))
    return F.array_distinct(F.concat(articles, F.regexp_extract_all(x, F.lit(f"(?iu){CITED_LAW}"), F.lit(0))))


def citation_tokens(col: Column) -> Column:
    """Articles and laws that a citation names, in lower case."""
    x = F.lower(collapse(col))
    return F.concat(F.regexp_extract_all(x, F.lit(f"(?iu){CITED_ARTICLE}"), F.lit(0)), F.regexp_extract_all(x, F.lit(f"(?iu){CITED_LAW}"), F.lit(0)))
