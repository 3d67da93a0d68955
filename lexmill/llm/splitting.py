"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Where a text may be cut, the strongest first: a match's end is a boundary. The last level is any character.
LEVELS = [
    re.compile(r"\n[ \t\r]*\n\s*|\n(?=(?:Phần|Chương|Mục|Điều|Phụ lục|PHẦN|CHƯƠNG|MỤC|PHỤ LỤC|[IVXLC]+\.)\s)"),  # section
    re.compile(r"\r\n?|\n"),  # paragraph
    re.compile(r"[.!?…](?:[\"”’»)\]]*)\s+|[。！？](?:[”’」』）]*)|;\s+"),  # sentence
    re.compile(r"\s+"),  # word
]


def _cuts(text: str, start: int, end: int, level: int, most: int, step: int) -> list[int]:
    """Ends of the parts of text[start:end], none longer than ``most``, split at the strongest level that serves; single runs are cut every ``step``."""
    if end - start <= most:
        return [end]
    if level == len(LEVELS):
        ends, at = [], start
        while end - at > step:
            cut = at + step
            while cut > at + 1 and (unicodedata.combining(text[cut]) or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
            ends.append(cut)
            at = cut
        return [*ends, end]
    bounds = [m.end() for m in LEVELS[level].finditer(text, start, end) if m.end() < end]
    out, at = [], start
    for bound in [*bounds, end]:
        out += _cuts(text, at, bound, level + 1, most, step)
        at = bound
    return out


def piece_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of a text's pieces in code points.

    Parts from the recursive split, each as large as a piece may be, are packed greedily up to ``size``. Each
    further piece starts within the last ``overlap`` characters of the one before it: at the first sentence
    start there, else at the first word start, else at the character. Where the next part would not fit beside
    that much, the overlap is shorter, so that no sentence that fits a piece is broken. The pieces cover the
    text; one piece if it fits, none if it is empty. An overlap counts up to ``size - 1``.
    """
    if not text:
        return []
    if len(text) <= size:
        return [(0, len(text))]
    overlap = max(0, min(overlap, size - 1))
    # A run without any boundary is cut so that the overlap asked for fits beside each part.
    ends = _cuts(text, 0, len(text), 0, size, size - overlap)
    starts = sorted({m.end() for level in LEVELS[:3] for m in level.finditer(text)})
    spans, start, k = [], 0, 0
    while True:
        while k < len(ends) and ends[k] - start <= size:
            k += 1
        end = ends[k - 1]
        spans.append((start, end))
        if k == len(ends):
            return spans
        start = _tail(text, starts, max(start + 1, end - overlap, ends[k] - size), end)


def _tail(text: str, starts: list[int], least: int, end: int) -> int:
    """Start of a piece between ``least`` and the end of the piece before it."""
    if least >= end:
        return end
    i = bisect_left(starts, least)
    if i < len(starts) and starts[i] < end:
        return starts[i]
    if text[least - 1].isspace() and not text[least].isspace():
        return least
    m = LEVELS[3].search(text, least, end)
    if m and m.end() < end:
        return m.end()
    while least < end and unicodedata.combining(text[least]):
        least += 1
    return least


_SPANS = ArrayType(StructType([StructField(x, IntegerType()) for x in ("config_id", "piece_no", "start_pos", "end_pos")]))


def oversized_pieces(rows: DataFrame, key: list[str], text: str, configs: list[tuple[int, int, int]]) -> DataFrame:
    """``config_id, *key, piece_no, start_pos, end_pos, piece`` of the texts that exceed a config's size.

    ``configs``: (config_id, chunk_size, chunk_overlap) in characters; the few rows are a parameter of the job.

    - Texts that fit a config, null and empty ones have no pieces under it.
    - Equal rows (key and text) are split once. Other columns are ignored.
    - A size below 1 is an error; a larger overlap counts as the size less one.
    - Texts and pieces are shuffled once each, by the text's 128-bit hash; a text that a third of the rows
      share is one row of the texts' side, and its rows are split by the adaptive skew join.
    """
    if any(size < 1 for _, size, _ in configs):
        raise ValueError("chunk_size must be positive")
    least = min((size for _, size, _ in configs), default=0)

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(c, n, a, b) for c, size, overlap in configs if len(t) > size for n, (a, b) in enumerate(piece_spans(t, size, overlap), 1)], na_action="ignore")

    large = rows.select(*key, F.col(text).alias("_text")).where(F.length("_text") > least if configs else F.lit(False))
    large = large.withColumns({"_h1": F.xxhash64("_text"), "_h2": F.xxhash64(F.lit(1), "_text")})
    # Most texts come again in every snapshot: each is split once, and its pieces go to all rows that have it.
    once = large.groupBy("_h1", "_h2").agg(F.first("_text").alias("_text"))
    cut = once.withColumn("_s", spans("_text")).select("_h1", "_h2", "_text", F.explode("_s").alias("_p"))
    start, end = F.col("_p.start_pos"), F.col("_p.end_pos")
    pieces = cut.select("_h1", "_h2", "_p.config_id", "_p.piece_no", start, end, F.substring(F.col("_text"), start + 1, end - start).alias("piece"))
    return large.select(*key, "_h1", "_h2").distinct().join(pieces, ["_h1", "_h2"]).select("config_id", *key, "piece_no", "start_pos", "end_pos", "piece")
