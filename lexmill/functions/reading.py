"""How a text reads: its form without what no reader sees."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions.lookalike import SUSPECT, consistent

#: A character outside the consistent form, or an entity: only such texts go to Python.
IRREGULAR = f"{SUSPECT}|&#?[0-9A-Za-z]{{1,31}};"


@F.pandas_udf(StringType())
def _as_read(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: consistent(html.unescape(x)), na_action="ignore")


def as_read(col: Column | str) -> Column:
    """Text without entities, look-alikes and white space; null reads as the empty text.

    White space is dropped whole, so moved or missing line ends make no difference.
    """
    col = F.col(col) if isinstance(col, str) else col
    odd = col.rlike(IRREGULAR)
    return F.coalesce(F.regexp_replace(F.coalesce(_as_read(F.when(odd, col)), col), r"(?U)\s+", ""), F.lit(""))
