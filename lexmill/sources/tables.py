"""Scans of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any script: what pads keys, and what a blank value has only.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``; pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trimmed(col: Column | str) -> Column:
    """A value without white space of any script at its ends; null for null."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE))


def blank(col: Column | str) -> Column:
    """Missing as the tables write it: null, empty or white space only."""
    return F.coalesce(trimmed(col), F.lit("")) == ""
