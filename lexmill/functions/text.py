"""Text normalisation and string scalars as column expressions; Python only where no expression exists."""

from __future__ import annotations

import html
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of any script, for engines whose \s is ASCII.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Token classes and the question words that carry no information.
TOKEN = "[0-9A-Za-zÀ-ỹ]+"
UUID_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def text(col: Column | str) -> Column:
    """Missing strings as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def collapse(col: Column | str) -> Column:
    """Any run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(col), f"{WS}+", " "))


def folded(col: Column | str) -> Column:
    """Collapsed and in lower case, the form in which values are matched."""
    return F.lower(collapse(col))


def tidy(col: Column | str) -> Column:
    """Lines kept, runs of blanks within them and of empty lines collapsed, none at the ends."""
    x = F.regexp_replace(F.replace(text(col), F.lit(" "), F.lit(" ")), "\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t\f\x0b]+", " "), " *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+\z", "")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_text(col: Column | str) -> Column:
    """``tidy`` text without entities; only texts that hold one go to Python."""
    x = text(col)
    return tidy(F.coalesce(_unescape(F.when(x.rlike("&#?[0-9A-Za-z]{1,31};"), x)), x))


def tokens(col: Column | str) -> Column:
    """Array of the lower-case tokens of a text, repeated ones too."""
    return F.regexp_extract_all(F.lower(text(col)), F.lit(TOKEN), F.lit(0))


#: By a byte of UTF-8: whether it is (1), or begins with 1 or 2 bytes to follow (2, 3), a character of tokens; of those with E1 only up to ỹ.
_WORD = bytes(2 if 0xC3 <= b < 0xE0 else 3 if b in (0xE0, 0xE1) else int(b < 0x80 and chr(b).isalnum()) for b in range(256))


def _lower(texts: pa.Array) -> pa.Array:
    """Texts without nulls in lower case; those with a letter whose lower case hangs on its neighbours, or is two letters, by Python."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    # Looked for in all bytes at once, as few texts have them.
    data = texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b""
    if not any(x.encode() in data for x in "Σİ"):
        return low
    odd = pc.or_(pc.match_substring(texts, "Σ"), pc.match_substring(texts, "İ"))
    # Capital letters of Unicode 16, which not every Python has; a final sigma beside U+1C89 is still told otherwise.
    other = [x.replace("\u1c89", "\u1c8a").replace("\ua7cb", "\u0264").replace("\ua7dc", "\u019b").lower() for x in texts.filter(odd).to_pylist()]
    return pc.replace_with_mask(low, odd, pa.array(other, pa.large_string()))


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts without nulls one after the other, as ``tokens`` has them, and how many each text has; made from the bytes of all texts at once."""
    low = _lower(texts)
    ends = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    kind = np.frombuffer(data.tobytes().translate(_WORD), dtype=np.uint8)
    word = kind > 0
    word[1:] |= kind[:-1] >= 2
    word[2:] |= kind[:-2] == 3
    at = np.flatnonzero(data == 0xE1)
    beyond = at[(data[at + 1] > 0xBB) | ((data[at + 1] == 0xBB) & (data[at + 2] > 0xB9))]
    word[beyond[:, None] + np.arange(3)] = False
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = word[begins]
    last, said = word.copy(), data[word]
    last[:-1] &= ~word[1:] | first[1:]
    first = np.flatnonzero(first)
    starts = np.append(0, np.cumsum(np.flatnonzero(last) - first + 1))
    out = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(said)])
    return out.cast(pa.string()) if len(said) < 2**31 else out, np.diff(np.searchsorted(first, ends))


def token_set(col: Column | str, least: int = 2) -> Column:
    """Distinct tokens of at least ``least`` characters."""
    return F.array_distinct(F.filter(tokens(col), lambda x: F.length(x) >= least))


def compared(col: Column | str) -> Column:
    """Lower case, every sign that is neither letter, digit nor underscore a space, runs of space collapsed: the form in which texts are compared."""
    return collapse(F.regexp_replace(F.lower(collapse(col)), r"[^\p{L}\p{N}_ ]", " "))


def informative_tokens(col: Column | str, stop_words: list[str]) -> Column:
    """Distinct words of the compared form longer than two characters that are neither stop words nor numbers."""
    kept = F.filter(F.array_distinct(F.split(compared(col), " ")), lambda x: (F.length(x) > 2) & ~x.rlike(r"^\p{Nd}+\z"))
    return F.array_except(kept, F.array(*[F.lit(x) for x in stop_words])) if stop_words else kept


def distinct_parts(parts: list[Column]) -> Column:
    """Array of the collapsed non-empty parts without outer dots, the first of those equal but for letter case.

    One fold over the parts with their folded forms, so that each text is cleaned and lowered once.
    """
    plain = F.transform(F.array(*[F.regexp_replace(collapse(p), r"^[ .]+|[ .]+\z", "") for p in parts]), lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.aggregate(plain, none, lambda seen, x: F.when((x["v"] == "") | F.exists(seen, lambda y: y["k"] == x["k"]), seen).otherwise(F.array_append(seen, x)), lambda seen: F.transform(seen, lambda y: y["v"]))


def retrieval_text(*fields: str) -> Column:
    """Distinct parts of the fields in one line."""
    return F.array_join(distinct_parts([text(f) for f in fields]), ". ")


def clipped(col: Column | str, most: int) -> tuple[Column, Column]:
    """(text of at most ``most`` characters without trailing space, whether it was cut); 0 or less means no limit."""
    x = text(col)
    if most <= 0:
        return x, F.lit(False)
    return F.when(F.length(x) > most, F.regexp_replace(F.substring(x, 1, most), f"{WS}+\\z", "")).otherwise(x), F.length(x) > most


def iso_date(col: Column | str) -> Column:
    """ISO instant of a d/m/Y or Y-m-d date, "" for anything else."""
    x = F.trim(text(col))
    day = F.coalesce(F.try_to_date(F.when(x.rlike(r"^\d{1,2}/\d{1,2}/\d{4}\z"), x), "d/M/yyyy"), F.try_to_date(F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), x), "yyyy-M-d"))
    return F.coalesce(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")), F.lit(""))


def point_id(level: str, key: Column) -> Column:
    """Stable id of a point: version 5 UUID of its level and key."""
    x = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE)), F.encode(F.concat(F.lit(level + ":"), key), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(x, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.concat(F.lit("5"), F.substring(x, 14, 3)), F.concat(F.lpad(variant, 2, "0"), F.substring(x, 19, 2)), F.substring(x, 21, 12))


def present(col: Column | str) -> Column:
    """The trimmed value, null if missing: what joins of parts leave out."""
    return F.nullif(F.trim(text(col)), F.lit(""))


def format_source(code: str = "article_code", name: str = "article_name", law: str = "law_id", title: str = "title", issuer: str = "issuer", date: str = "effective_date") -> Column:
    """Citation line of an article: code - name - law or title - issuer, date."""
    tail = F.nullif(F.concat_ws(", ", present(issuer), present(date)), F.lit(""))
    return F.concat_ws(" - ", present(code), present(name), F.coalesce(present(law), present(title)), tail)


def legal_reference(article: str = "article", title: str = "title", law: str = "law_id") -> Column:
    """``article của title (law)`` of what is there."""
    of = F.concat(F.lit("của "), present(title))
    by = F.concat(F.lit("("), present(law), F.lit(")"))
    return F.concat_ws(" ", present(article), of, by)


def without_prefixes(content: Column, *prefixes: Column) -> Column:
    """Content without the given texts at its start, in any letter case, and the signs after each."""
    x = F.trim(content)
    for p in prefixes:
        q = F.trim(text(p))
        cut = (q != "") & (F.lower(F.left(x, F.length(q))) == F.lower(q))
        x = F.when(cut, F.regexp_replace(F.substring(x, F.length(q) + 1, F.length(x)), r"^[\s.:\-]+", "")).otherwise(x)
    return x


def _first_object(text: str) -> str:
    bare, decoder = re.sub(r"^\s*```\w*\s*|\s*```\s*\Z", "", text), json.JSONDecoder()
    at = bare.find("{")
    while at >= 0:
        try:
            return bare[at : decoder.raw_decode(bare, at)[1]]
        except ValueError:
            at = bare.find("{", at + 1)
    return bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare else ""


@F.pandas_udf(StringType())
def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(_first_object, na_action="ignore")


def first_json_object(col: Column | str) -> Column:
    """The first whole JSON object of a text, without a code fence around it; else from the first brace to the last; "" if there is none.

    Only texts with a brace go to Python, whose parser tells where an object ends: braces in strings don't mislead.
    """
    x = text(col)
    return F.coalesce(_objects(F.when(F.contains(x, F.lit("{")), x)), F.lit(""))


def as_flag(col: Column | str) -> Column:
    """Truth of the words that configurations use; null for any other."""
    x = folded(col)
    return F.when(x.isin("1", "true", "yes", "on"), True).when(x.isin("0", "false", "no", "off"), False)


def clamped(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))
