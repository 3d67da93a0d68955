"""Size-bound chunks of sections: windows that back off to the last good separator, each below its heading."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Separators in order of preference, and the least room that a heading leaves.
SEPARATORS = ("\n\n", "\n", "; ", ". ", " ")
LEAST_ROOM = 200


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters, each starting ``overlap`` before the last one's end.

    A window ends after the last separator in its second half, of the most preferred kind that it has there.
    The ends of all separators are found in one pass each and looked up by bisection.
    """
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    ends = [(len(s), [m.start() + len(s) for m in re.finditer(f"(?={re.escape(s)})", text)]) for s in SEPARATORS]

    def end_of(start: int) -> int:
        limit = start + size
        if limit >= len(text):
            return len(text)
        for width, of in ends:
            last = bisect_right(of, limit) - 1
            if last >= 0 and of[last] - width >= start + max(size // 2, 1):
                return of[last]
        return limit

    out, start, end = [], 0, 0
    while end < len(text):
        end = end_of(start)
        out.append(text[start:end].strip())
        start = max(start + 1, end - overlap)
    return [piece for piece in out if piece]


def chunks(sections: DataFrame, key: list[str], section: str, heading: str, size: int = 800, overlap: int = 150) -> DataFrame:
    """``*key, chunk_no, content``: chunks of each section, its heading on the first line of each; an empty section is one empty chunk.

    With a heading the text has ``size`` less the heading, but at least 200 characters.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for t, h in zip(texts, heads):
            room = max(LEAST_ROOM, size - len(h) - 1) if h else size
            pieces = windows(t or "", room, min(overlap, room - 1)) or [""]
            out.append([f"{h}\n{p}" if h and p else p for p in pieces])
        return pd.Series(out)

    return sections.select(*key, F.posexplode(split(F.coalesce(section, F.lit("")), F.coalesce(heading, F.lit("")))).alias("chunk_no", "content"))
