"""Joins that no key can overload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has at least one such part of all rows: so at most that many keys are.
SHARE = 2_000


def split_join(rows: DataFrame, facts: DataFrame, on: list[str], share: int = SHARE) -> DataFrame:
    """Rows with the facts of their key, nulls where there are none; ``facts`` has each key once.

    Heavy keys meet their facts by a broadcast of at most ``share`` rows and leave before the others are
    shuffled; rows without a key need neither. ``rows`` are read twice, so they should be kept or cheap to read.

    - Null keys match nothing. Repeated rows stay. Names of facts other than the key must not clash with those of rows.
    - Empty rows or facts give no rows, or nulls.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    counted = rows.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    heavy = F.broadcast(counted.where(F.col("_n") * share >= total).select(*on))
    told = [c for c in facts.columns if c not in on]
    columns = [*rows.columns, *told]
    keyed = rows.where(known)
    hot = keyed.join(heavy, on, "left_semi").join(F.broadcast(facts.join(heavy, on, "left_semi")), on, "left")
    rest = keyed.join(heavy, on, "left_anti").join(facts, on, "left")
    none = rows.where(~known).select("*", *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in told])
    return hot.select(columns).unionByName(rest.select(columns)).unionByName(none.select(columns))
