"""Broken prompt and response pairs.

Copies are found by compressing the response with its prompt as a zstandard dictionary; refusals
and languages by dictionaries; cut answers by their endings and, where these leave it open, by a
model of terminal contexts counted over all responses.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.lookalike import consistent
from lexmill.functions.session import kept

#: Bytes that a copy's frame may need beyond that of the prompt itself: a label or quotes around it.
COPY_BYTES = 18
#: Least share of words that a copy and its question have in common.
COPY_WORDS = 0.8
#: Least share of a context's occurrences that end a sentence for an answer without a mark, or with an ellipsis, to be complete.
TERMINAL_SHARE = 0.5
#: Contexts with at least one such part of the unsure answers, so at most that many, are broadcast.
HOT_SHARE = 2_000
#: Marks that end a sentence, and signs and white space that part words, where contexts are counted.
MARKS = ".!?。！？"
SIGNS = "…,;:，；：、()[]{}<>（）「」『』\"'“”‘’«»„*_#|/\\–—-\n\r\t\x0b\x0c\u00a0\u200b\u3000"
# One type per pair: the first that holds.
TYPES = ["empty", "copied_question", "refusal", "truncated", "other_language"]

# Dictionaries of labels, refusals, courtesies and frequent words.
LABELS = (
    "kết luận|cơ sở pháp lý|căn cứ pháp lý|căn cứ|ghi chú|lưu ý|trả lời|câu trả lời|đáp án|nội dung|nguồn|nguồn tham khảo|chưa có nguồn|"
    "tóm tắt|answer|conclusion|legal basis|notes?|sources?|summary|no sources?"
)
PLACEHOLDERS = "none|null|nil|undefined|nan|n/a|na|trống|rỗng|không có nội dung|chưa có nội dung|chưa có câu trả lời|đang cập nhật|empty|blank|todo|tbd|no answer|no content"
QUESTION_LABELS = "câu hỏi của bạn|bạn hỏi|câu hỏi|hỏi|trả lời|câu trả lời|đáp|your question|question|you asked|answer|q|a"
REFUSALS = [
    r"\b(?:tôi|chúng tôi|hệ thống|trợ lý|mình|em|dữ liệu)\b.*\b(?:không thể|chưa thể|không có đủ|không đủ|chưa đủ|chưa có đủ|không tìm thấy|chưa tìm thấy|không tìm được|chưa sẵn sàng|từ chối|không được phép|chưa được phép|xin phép không|không tiện|không hỗ trợ|chưa hỗ trợ|không có khả năng|không dám)\b",
    r"\bngoài (?:phạm vi|khả năng|thẩm quyền|chức năng)\b",
    r"\bvượt (?:quá|ngoài) (?:khả năng|phạm vi|thẩm quyền)\b",
    r"\bi\b.*\b(?:decline|refuse|cannot|can't|can’t|unable|not able|rather not|prefer not|not in a position|do not have|don't have|don’t have|lack|could not|couldn't|did not find|found no|not permitted|not allowed|not ready|not authori[sz]ed|must refrain)\b",
    r"\b(?:outside|beyond|exceeds)\b.*\b(?:covers?|scope|service|assistant|ability|abilities|remit|competence|able)\b",
    r"\b(?:system|service|assistant|tool)\b.*\b(?:does not|doesn't|doesn’t|cannot|can't|not yet|no)\b",
    r"\b(?:data|information|documents?)\b.*\b(?:insufficient|not enough|not sufficient|found)\b",
    r"\bno (?:answer|reply|response|comment|opinion|information|advice)\b.*\b(?:can|could|may|will|is)\b",
    r"\b(?:not enough|too little|insufficient|no) (?:material|information|data|evidence|detail|documents?)\b",
    r"\b(?:không|chưa) (?:có|đủ) (?:đủ )?(?:tài liệu|thông tin|dữ liệu|căn cứ)\b.*\b(?:trả lời|giải đáp|tư vấn|kết luận)\b",
]
COURTESIES = r"^(?:bạn|mong|chúc|hãy|xin|rất tiếc|thật tiếc|tiếc|cảm ơn|vui lòng|mời|please|thank|thanks|sorry|we apologi[sz]e|i apologi[sz]e|you (?:may|can|could|should)|have a|try|kindly|feel free|unfortunately|my apologies)\b"
GIVES_LIMITS = r"khẳng định cho mọi|theo khoản|theo điều|theo quy định tại|under (?:art|item|sec)"
TRANSLATION = r"\b(?:dịch|viết lại|chuyển|diễn đạt|nói lại|translate|render|rewrite|rephrase|say)\b.*(?:\btiếng\b|\b(?:in|into|to) (?:english|french|german|russian|chinese|japanese|korean|vietnamese|thai|khmer|hindi|arabic)\b)"
WORDS = {
    "en": "the of and is are to in for must shall not who what which how when may on at under this that with before same day any do does or by from be has have was were it as an".split(),
    "fr": "le les de du des est il et un une que dans pour doit pas au aux sur ce cette qui ne par sont vanne ou son sa dit".split(),
    "de": "der die das und ist muss nicht soll den dem ein eine auf zu für mit von im wird darf oder ohne bzw beträgt fragte".split(),
    "vi": "khong cua trong theo duoc phai nguoi quy dinh dieu khoan ngay va cho quan so bo truoc sau khi nop tien phat hanh vi doi voi thi gi nhung tai thu tuc ai tham quyen bao nhieu lau gom buoc nao neu toi muon biet phi hoi ho thoi han muc ve viec duoc giu thang nam".split(),
    "es": "el los las de del y en que por para con una un es son no se su sus como más pero este esta estos debe deben puede ser está han hay cuando quien cuál cómo plazo días ley artículo según sobre entre desde hasta muy también ya si al lo le".split(),
    "it": "il lo gli di del della dei delle che è e per con una uno un non si sono come più ma questo questa deve devono può essere ha hanno quando chi quale entro giorni legge articolo secondo sulla nel nella dal dalla alla anche già se al".split(),
    "pt": "os as do da dos das e em que por para com uma um é são não se seu sua como mais mas este esta deve devem pode ser está foi há quando quem qual prazo dias lei artigo segundo sobre entre desde até muito também já se ao pela pelo no na".split(),
    "id": "yang dan di ke dari untuk dengan pada adalah tidak ini itu atau oleh dalam akan harus dapat telah sudah juga karena sebagai bahwa siapa berapa kapan bagaimana hari undang pasal menurut tentang antara sampai sangat jika para wajib orang".split(),
}
OPEN_ABBREVIATIONS = r"(?:^|[\s(“])(?:TP|Q|P|ThS|TS|PGS|GS|KS|BS|Dr|Mr|Mrs|Ms|Art|No|Vol|pp|sec|cf|App|Fig|tr|e\.g|i\.e|approx|para|St|Ltd|Đ|số|v/v|Hinh|Hình)\.$"

_context_signs = str.maketrans(MARKS + SIGNS, "\x01" * len(MARKS) + " " * len(SIGNS))
_scripts = {"CYRILLIC": "ru", "CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "THAI": "th", "KHMER": "km", "DEVANAGARI": "hi", "ARABIC": "ar"}
_refusals = [re.compile(p) for p in REFUSALS]
_labels = re.compile(rf"^\W*(?:\d+|[ivx]+|[a-z])?\W*(?:{LABELS})?\W*$")
_placeholder = re.compile(rf"^\W*(?:{PLACEHOLDERS})?\W*$")
_courtesy = re.compile(COURTESIES)
_limits = re.compile(GIVES_LIMITS)
_translation = re.compile(TRANSLATION)
_question_label = re.compile(rf"^\W*(?:{QUESTION_LABELS})\s*[:：]\s*")
_sentence_end = re.compile(r"[.!?…。！？؟।។]['\"”’»“›)\]）】」』*_]*$|[)\]）】」』”»]$|[”\"*]$")
_number_cut = re.compile(r"(?:từ|đến|là|phí|mức|tu|den|la|muc|phi|i\.e\.) \d[\d.,]*$")
_code_cut = re.compile(r"(?:Điều|Dieu|điều) \d+\.\d+(?:\.[A-ZĐ]+(?:\.\d+)?)?\.$")
_abbreviation = re.compile(OPEN_ABBREVIATIONS)
_ellipsis = re.compile(r"\s*(?:…|\.{3,}|\[…\])$")
_heading = re.compile(rf"^\s*\d+[.)]\s*(?:{LABELS})\s*:?\s*$", re.I)
_source_tail = re.compile(r" - .* - .*(?:, ?\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4})$")
_short_fact = re.compile(r"^(?:[\d.,]+ (?:đồng|ngày|giờ|tháng|năm|dong|%)\b.{0,20}|(?:điểm \w+ )?(?:khoản \d+ )?điều [\w.]+|art\. ?\d+.*|\d+(?:[./-]\d+)*|có|không|yes|no|đúng|sai)$", re.I)


#: White space of any script.
_SPACES = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
#: Built by rule: format characters, which may stand behind any text.
_FORMATS = "".join(ch for ch in map(chr, range(0x110000)) if unicodedata.category(ch) == "Cf")


# The few texts of a pair are asked for several times.
_consistent = lru_cache(maxsize=8)(consistent)


class _Remembered(dict):
    """What is found out about a token; that of short ones is remembered, up to a number that no memory minds."""

    def __init__(self, find: Callable[[str], tuple]):
        self.find = find

    def __missing__(self, token: str) -> tuple:
        found = self.find(token)
        if len(token) <= 40 and len(self) < 200_000:
            self[token] = found
        return found


def _bare_words(token: str) -> tuple[str, ...]:
    plain = "".join(ch for ch in unicodedata.normalize("NFD", token.replace("đ", "d")) if not unicodedata.combining(ch))
    return tuple(re.sub(r"[^\w\s]|_", " ", plain).split())


_words_of = _Remembered(_bare_words)


def _plain(text: str) -> list[str]:
    """Words of a text, lower case without diacritics and punctuation."""
    return list(chain.from_iterable(map(_words_of.__getitem__, (_consistent(text) or "").lower().split())))


def _frame(data: bytes, prompt: zstandard.ZstdCompressionDict) -> int:
    return len(zstandard.ZstdCompressor(level=9, dict_data=prompt, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))


def copies(question: str, answer: str) -> bool:
    """Whether the answer says no more than the question: what its frame takes beyond the question's own."""
    q, a = _plain(question), _plain(_question_label.sub("", answer.strip().lower()))
    if not q or not a:
        return False
    # Exact and needed besides the compressor's verdict: the words of either are those of the other.
    asked, said = set(q), set(a)
    if len(asked & said) < COPY_WORDS * max(len(asked), len(said)):
        return False
    q, a = " ".join(q).encode(), " ".join(a).encode()
    prompt = zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return _frame(a, prompt) - _frame(q, prompt) <= COPY_BYTES


def _word_languages(word: str) -> list[tuple[str, float]]:
    """(language, weight) pairs of a word in lower case: by its script, by its letters, or by the dictionaries that have it, each by its share."""
    name = "HIRAGANA" if any("぀" <= ch <= "ヿ" for ch in word) else unicodedata.name(word[0], "").split(" ")[0]
    if name in _scripts:
        return [(_scripts[name], float(len(word)))]
    if any(ch in "ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ" for ch in word):
        return [("vi", float(len(word)))]
    of = [k for k, words in _words.items() if word in words]
    return [(k, 2 * len(word) / len(of)) for k in of]


def _token_languages(token: str) -> tuple[tuple[str, float], ...]:
    return tuple(x for word in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", token)) for x in _word_languages(word))


_languages_of = _Remembered(_token_languages)


def language(text: str) -> str:
    """Language that most of a text's letters are in, by script and dictionaries; "" if undecided."""
    found: dict[str, float] = {}
    for of, weight in chain.from_iterable(map(_languages_of.__getitem__, text.lower().split())):
        found[of] = found.get(of, 0) + weight
    if "ja" in found:
        found["ja"] += found.pop("zh", 0)
    return max(found, key=lambda k: found[k], default="")


_words = {k: set(v) for k, v in WORDS.items()}


_sentence_gap = re.compile(r"(?<=[.!?…。！？])\s+|\n+")


def _sentences(text: str) -> Iterator[str]:
    """Sentences of a text, found as they are asked for."""
    at, text = 0, text.strip()
    for m in _sentence_gap.finditer(text):
        if text[at : m.start()].strip():
            yield text[at : m.start()]
        at = m.end()
    if text[at:].strip():
        yield text[at:]


def is_empty(answer: str) -> bool:
    """No content: blank, a placeholder, or labels and headings only."""
    for line in answer.splitlines():
        text = re.sub(r"<[^<>]{0,40}>|&nbsp;", " ", "".join(ch for ch in line if unicodedata.category(ch) != "Cf")).lower() if len(line) <= 100 else line.lower()
        if not (_labels.match(text) or _placeholder.match(text)):
            return False
    return True


def is_refusal(answer: str) -> bool:
    """Every sentence declines or is a courtesy, and at least one declines."""
    text = (_consistent(answer) or "").lower()
    declined = False
    for part in _sentences(text):
        if any(p.search(part) for p in _refusals):
            declined = True
        elif not _courtesy.search(part.strip()):
            return False
    return declined and not _limits.search(text)


def ending(answer: str, sources: list[str]) -> str:
    """``cut``, ``whole``, or ``list``/``bare`` where the terminal context has to tell: an ellipsis after a list, no mark at all."""
    text = answer.rstrip(_FORMATS + _SPACES)
    last = text.rsplit("\n", 1)[-1].strip()
    if text.endswith("�"):
        return "cut"
    if "\n" in text and last.startswith("- "):
        line = " ".join(last[2:].split())
        known = [" ".join(s.split()) for s in sources]
        if line in known or line.lower() == "chưa có nguồn":
            return "whole"
        if any(s.startswith(_ellipsis.sub("", line)) for s in known):
            return "cut"
        if _ellipsis.search(line):
            return "cut"
        return "whole" if _source_tail.search(last) or _sentence_end.search(line) else "cut"
    if _heading.match(last):
        return "whole"
    if _ellipsis.search(text):
        final = list(_sentences(text))[-1]
        return "list" if final.count(",") >= 2 else "cut"
    if _number_cut.search(last) or _code_cut.search(last) or _abbreviation.search(last):
        return "cut"
    if text.count("“") > text.count("”") and "„" not in text:
        return "cut"
    if _sentence_end.search(text):
        return "whole"
    if _short_fact.match(text):
        return "whole"
    # A comma ends nothing; any other text without a mark is told by its last words.
    return "cut" if text.endswith((",", ";", "、", "，")) else "bare"


def last_words(text: str) -> str:
    """The last two words, lower case: the context of the text's end. A mark within a word, as in 15.7, is part of it."""
    words = unicodedata.normalize("NFC", text.lower()).translate(_context_signs).split()
    return " ".join(x.rstrip("\x01") for x in words[-2:])


def _judge(question, answer, sources) -> tuple[str | None, bool, str | None]:
    question, answer = question or "", answer or ""
    if is_empty(answer):
        return "empty", True, None
    if copies(question, answer):
        return "copied_question", True, None
    if is_refusal(answer):
        return "refusal", True, None
    end = ending(answer, [s for s in (sources if sources is not None else []) if s])
    if end == "cut":
        return "truncated", True, None
    asked, given = language(question), language(answer)
    other = "other_language" if asked and given and asked != given and not _translation.search((_consistent(question) or "").lower()) else None
    return other, end == "whole", None if end == "whole" else last_words(answer)


def _contexts(answers: Iterable[str]) -> dict[str, list[int]]:
    """Of each two words that follow each other in the answers: how often they do, and how often a sentence ends after them."""
    raw: Counter = Counter()
    for answer in answers:
        words = unicodedata.normalize("NFC", answer.lower()).translate(_context_signs).split()
        raw.update(zip(words, words[1:]))
    folded: dict[str, list[int]] = {}
    for (a, b), n in raw.items():
        word = b.rstrip("\x01")
        counts = folded.setdefault(f"{a.rstrip('\x01')} {word}", [0, 0])
        counts[0] += n
        # One mark ends a sentence; a row of them is an ellipsis.
        counts[1] += n if len(b) == len(word) + 1 else 0
    return folded


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs' verdicts, and the contexts of each batch, folded, as rows without a chat_id."""
    for batch in batches:
        verdicts = [_judge(*x) for x in zip(batch["question"], batch["final_answer"], batch["sources"])]
        told = pd.DataFrame(verdicts, columns=["type", "sure", "context"])
        told.insert(0, "chat_id", batch["chat_id"].to_numpy())
        yield told.assign(n=None, ends=None)
        rows = [(None, None, None, c, n, ends) for c, (n, ends) in _contexts(x for x in batch["final_answer"] if x).items()]
        yield pd.DataFrame(rows, columns=["chat_id", "type", "sure", "context", "n", "ends"])


def defective_pairs(chats: DataFrame) -> DataFrame:
    """``chat_id, defect_type`` of each defective pair of ``chats (chat_id, status, question, final_answer, sources)``.

    One type per pair, the first that holds of empty, copied_question, refusal, truncated, other_language.

    - Rows of status ``need_clarify`` are no cases; any other or null status may be. A null chat_id takes no part.
    - A null answer is empty; a null question can be neither copied nor of another language; null sources are none.
    - Repeated rows come out once. Where rows of one chat_id differ, the first type in the order above counts.
    - An empty table gives no rows; other columns are ignored.
    """

    asked = chats.select("chat_id", "status", "question", "final_answer", "sources").where("chat_id is not null and not (status <=> 'need_clarify')")
    # Judged where they lie, repeated rows too: no text is shuffled. Read several times, but judged once.
    kind = chats.schema["chat_id"].dataType.simpleString()
    every = kept(asked.select("chat_id", "question", "final_answer", "sources").mapInPandas(_judged, f"chat_id {kind}, type string, sure boolean, context string, n long, ends long"))
    judged = every.where("n is null")
    sure = judged.where("sure and type is not null").select("chat_id", "type")
    unsure = judged.where("not sure").groupBy("chat_id", "context", "type").agg(F.count(F.lit(1)).alias("n"))
    # Terminal contexts: how often, in all answers, the last two words of the unsure ones are followed by the end of a sentence.
    seen = every.where("n is not null").groupBy("context").agg((F.sum("ends") / F.sum("n")).alias("share"))
    # Both sides of the join have each context once, whatever its frequency.
    met = unsure.groupBy("context").agg(F.sum("n").alias("n"))
    model = met.join(seen, "context", "left")
    model = kept(model.select("context", "n", (F.coalesce("share", F.lit(0.0)) >= TERMINAL_SHARE).alias("whole")))
    # Contexts of many answers go back to them by a broadcast, at most HOT_SHARE of them, the others by a shuffle.
    total = model.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE >= total
    hot, rare = F.broadcast(model.where(is_hot).drop("n")), model.where(~is_hot).drop("n")
    told = unsure.drop("n").join(hot, "context").unionByName(unsure.drop("n").join(hot.select("context"), "context", "left_anti").join(rare, "context"))
    found = told.select("chat_id", F.when(~F.col("whole"), "truncated").otherwise(F.col("type")).alias("type")).where("type is not null")
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    return sure.unionByName(found).groupBy("chat_id").agg(F.min(F.struct(rank.alias("rank"), "type"))["type"].alias("defect_type"))
