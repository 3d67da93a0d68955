"""One consistent form for text that looks the same.

The tables are built by rule from the Unicode character database; only the look-alike
letters, which no rule of the database gives, are stated as text. ``consistent`` is the
per-value form, for values a JVM-side test has found suspect; the distributed form over
exploded code points is ``llm/visual.py``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of one script that look like letters of another.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
ARMENIAN = dict(zip("օսոհ", "ounh"))
#: Letters of the Latin script that look like another letter of it, whatever the word.
LATIN_TWINS = {"Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ", "ɡ": "g", "ɑ": "a"}
HYPHENS = {"‐": "-", "‑": "-", "﹣": "-", "－": "-"}
#: Marks drawn through a letter; with d they are another way to write đ.
STROKES = "̵̶"

FOREIGN = CYRILLIC | GREEK | ARMENIAN
TO_CYRILLIC = {b: a for a, b in CYRILLIC.items()}

#: Java and Python class of characters that are in the consistent form in any context.
SAFE = (
    r"\t\n\r -~¡-¬®-ÏÑ-ïñ-ƈƊ-ɐḀ-ỹ"
    r"‒-‧‰-⁞₠-₿←-⌨⌫-⫛ぁ-ゖァ-ヺ一-鿿가-힣"
)
SUSPECT = f"[^{SAFE}]"
_suspect = re.compile(SUSPECT)


@lru_cache(maxsize=70_000)
def script(ch: str) -> str:
    """Script of a letter as far as the look-alikes need it: L, C, G, A, H (Han and kana) or '' for any other."""
    if ch in LATIN_TWINS:
        return "L"
    if not ch.isalpha():
        return "H" if "　" < ch < "぀" else ""
    name = unicodedata.name(ch, "")
    for start, code in (("LATIN", "L"), ("CYRILLIC", "C"), ("GREEK", "G"), ("ARMENIAN", "A"), ("CJK", "H"), ("HIRAGANA", "H"), ("KATAKANA", "H")):
        if start in name.split(" ")[:2]:
            return code
    return ""


#: Formats that are seen (number signs and the like), and fillers and selectors outside the format category that are not.
SEEN_FORMATS = re.compile("[\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd\U00013430-\U0001343f]")
UNSEEN = re.compile("[\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\ufe00-\ufe0f\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]")
_shaping = re.compile("[\u0600-\u074f\u0750-\u077f\u0840-\u08ff\u0900-\u0dff\u0f00-\u109f\u1780-\u17ff\u1a20-\u1aaf\ua8e0-\ua8ff\U00011000-\U000116cf]")


@lru_cache(maxsize=70_000)
def is_invisible(ch: str) -> bool:
    """Format characters, fillers, joiners, variation selectors, tags and control characters of any plane."""
    return bool(UNSEEN.match(ch)) or unicodedata.category(ch) == "Cf" and not SEEN_FORMATS.match(ch)


@lru_cache(maxsize=70_000)
def around(ch: str) -> str:
    """Class of a character as the neighbour of an invisible one: S symbol, J letter that joins its neighbours, M Mongolian, V selector, T tag or black flag."""
    if not ch:
        return ""
    if "\ufe00" <= ch <= "\ufe0f":
        return "V"
    if ch == "\U0001f3f4" or "\U000e0020" <= ch <= "\U000e007e":
        return "T"
    kind = unicodedata.category(ch)
    if kind[0] == "S":
        return "S"
    if "\u1820" <= ch <= "\u18aa":
        return "M"
    return "J" if kind[0] in "LM" and _shaping.match(ch) else ""


def stays(ch: str, before: str, after: str) -> bool:
    """Whether an invisible character changes how its neighbours look: an emoji's selector, a joiner in Arabic or Indic words, a flag's tag."""
    if "\ufe00" <= ch <= "\ufe0f":
        return around(before) == "S" or after == "\u20e3"
    if ch in "\u200c\u200d":
        return around(before) == around(after) == "J" or ch == "\u200d" and around(before) in ("S", "V", "T") and around(after) in ("S", "T")
    if "\u180b" <= ch <= "\u180f":
        return around(before) == "M"
    return "\U000e0020" <= ch <= "\U000e007f" and around(before) == "T"


def is_wide_mark(ch: str) -> bool:
    """Full-width punctuation and symbols: ordinary in Chinese and Japanese text, not elsewhere."""
    return "！" <= ch <= "～" and not ch.isalnum() and ch != "－"


@lru_cache(maxsize=70_000)
def expand(ch: str) -> str:
    """A character's full decomposition: canonical, and compatibility where both sides look the same."""
    if is_invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in HYPHENS:
        return HYPHENS[ch]
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    roman, ligature, radical = "Ⅰ" <= ch <= "ⅿ", "ﬀ" <= ch <= "ﬆ", "⼀" <= ch <= "⿕"
    if kind in ("<wide>", "<narrow>") or kind == "<compat>" and (roman or ligature or radical):
        return "".join(expand(chr(int(x, 16))) for x in rest.split(" "))
    return LATIN_TWINS.get(ch, unicodedata.normalize("NFD", ch))


def sure(ch: str, of: str) -> bool:
    """Whether a letter of script ``of`` has no twin in Latin (for L: none in Cyrillic)."""
    return script(ch) == of and (ch not in TO_CYRILLIC if of == "L" else ch not in FOREIGN)


def word_script(word: str) -> str:
    """Script that a word's twins belong to; '' = by the neighbours, '-' = leave them."""
    found = {of for ch in word if (of := script(ch)) in ("L", "C", "G", "A") and sure(ch, of)}
    if len(found) == 1:
        return found.pop()
    if found:
        return "-"
    here = {of for ch in word if (of := script(ch))}
    return "L" if "L" in here else ""


def settle(word: str, of: str) -> str:
    """A word with its twins in script ``of``."""
    if of == "L":
        return "".join(FOREIGN.get(ch, ch) for ch in word)
    if of == "C":
        return "".join(TO_CYRILLIC.get(ch, ch) for ch in word)
    return word


#: White space that separates chunks, the unit that is brought to the consistent form.
_chunk = re.compile(r"([ \t\r\n]+)")
_twin = re.compile(f"[{''.join(FOREIGN)}]")
_han = re.compile("[、-〿ぁ-ゟァ-ヿ㐀-䶿一-鿿豈-\ufaff]")
#: Characters of a chunk at most: text without white space is cut further, so that nothing unbounded is one piece.
PIECE = 256
_long = re.compile(f"[^ \\t\\r\\n]{{{PIECE + 1}}}")
_suspect_chunk = re.compile(f"(?<![^ \\t\\r\\n])[^ \\t\\r\\n]*?{SUSPECT}[^ \\t\\r\\n]*")


def near_scripts(chunk: str) -> str:
    """Scripts other than Latin of which a chunk has a letter without a twin."""
    return "".join(of for of in "CGA" if any(sure(ch, of) for ch in chunk))


def _in_word(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M" or script(ch) in ("L", "C", "G", "A")


def _starts(ch: str) -> bool:
    """Whether nothing before a character composes with it."""
    return unicodedata.category(ch)[0] != "M" and not is_invisible(ch) and not "\u1100" <= ch <= "\u11ff"


def cut_chunk(chunk: str) -> list[str]:
    """A chunk in pieces of at most ``PIECE`` characters: cut between words or characters of a script without them, else before a character that starts anew."""
    out = []
    while len(chunk) > PIECE:
        span = range(PIECE, PIECE // 2, -1)
        loose = (i for i in span if _starts(chunk[i]) and not is_invisible(chunk[i - 1]) and not (_in_word(chunk[i]) and _in_word(chunk[i - 1])))
        cut = next(loose, None) or next((i for i in span if _starts(chunk[i])), PIECE)
        out.append(chunk[:cut])
        chunk = chunk[cut:]
    return [*out, chunk]


def pieces(text: str) -> list[tuple[str, str, bool]]:
    """(piece, near, suspect) of a text in order, with the white space between them.

    near: scripts of the pieces beside it, where twins could need them; H if a piece of a cut chunk belongs to text with Han.
    """
    parts = _chunk.split(text)
    if not _long.search(text):
        out = []
        for k, x in enumerate(parts):
            odd = not k % 2 and bool(_suspect.search(x))
            near = "".join(near_scripts(parts[j]) for j in (k - 2, k + 2) if 0 <= j < len(parts)) if odd and _twin.search(x) else ""
            if x:
                out.append((x, near, odd))
        return out
    flat = []
    for i, part in enumerate(parts):
        whole = i % 2 or len(part) <= PIECE
        flat += [(part, "")] if whole else [(x, "H" if _han.search(part) else "") for x in cut_chunk(part)]
    solid = [i for i, (x, _) in enumerate(flat) if x and not x[0] in " \t\r\n"]
    place = {i: n for n, i in enumerate(solid)}
    out = []
    for i, (x, han) in enumerate(flat):
        if not x:
            continue
        odd = i in place and bool(_suspect.search(x))
        beside = [flat[solid[n]][0] for n in (place[i] - 1, place[i] + 1) if 0 <= n < len(solid)] if odd and _twin.search(x) else []
        out.append((x, ("".join(map(near_scripts, beside)) + han) if odd else "", odd))
    return out


def suspect_chunks(text: str) -> list[tuple[str, str, bool]]:
    """The distinct suspect pieces of a text: where no twin needs its neighbours and nothing is to be cut, found by one pattern."""
    if _twin.search(text) or _long.search(text):
        return list(dict.fromkeys(p for p in pieces(text) if p[2]))
    return [(x, "", True) for x in dict.fromkeys(m[0] for m in _suspect_chunk.finditer(text))]


def consistent_chunk(chunk: str, near: str = "") -> str:
    """Consistent form of text without plain white space; ``near``: scripts of the pieces beside it."""
    return _short_chunk(chunk, near) if len(chunk) <= 48 else _any_chunk(chunk, near)


@lru_cache(maxsize=100_000)
def _short_chunk(chunk: str, near: str) -> str:
    return _any_chunk(chunk, near)


def _any_chunk(chunk: str, near: str) -> str:
    if any(map(is_invisible, chunk)):
        beside = zip(chunk, ["", *chunk], [*chunk[1:], ""])
        seen = [(ch, is_invisible(ch)) for ch, before, after in beside if not is_invisible(ch) or stays(ch, before, after)]
    else:
        seen = [(ch, False) for ch in chunk]
    han = "H" in near or bool(_han.search(chunk))
    plain = unicodedata.normalize("NFD", "".join(ch if kept or han and is_wide_mark(ch) else expand(ch) for ch, kept in seen))
    near += near_scripts(plain)
    out, word = [], ""
    for ch in plain + " ":
        if script(ch) in ("L", "C", "G", "A") or unicodedata.combining(ch):
            word += ch
            continue
        of = word_script(word) or ("-" if any(script(x) in near for x in word if x in FOREIGN) else "L")
        out += [settle(word, of), ch]
        word = ""
    text = "".join(out)[:-1]
    for mark in STROKES:
        text = text.replace("d" + mark, "đ").replace("D" + mark, "Đ")
    return unicodedata.normalize("NFC", text)


def consistent(text: str | None) -> str | None:
    """The consistent form of one value: NFC, half width, plain spaces, nothing invisible, each letter from its word's script."""
    if text is None or not _suspect.search(text):
        return text
    if _twin.search(text) or _long.search(text):
        return "".join(consistent_chunk(x, near) if odd else x for x, near, odd in pieces(text))
    return _suspect_chunk.sub(lambda m: consistent_chunk(m[0]), text)
