"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.session import kept
from lexmill.sources.tables import trimmed

KEY = ["ref_table", "period", "ref_key"]


def orphan_keys(refs: DataFrame, targets: DataFrame, heavy_share: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """Orphan keys of ``refs (ref_table, period, ref_key)`` against ``targets (ref_table, period, ref_key)``.

    Two tables ``ref_table, period, ref_key, n, reason``: keys that hold at least one
    ``heavy_share``-th of all references, so at most ``heavy_share`` of them, checked by
    broadcasting them to the targets; and all others, checked by a shuffle join of the
    pre-aggregated keys. Both also have the keys that do exist, with a null reason.

    reason: ``deleted`` if the key existed in an earlier period, else ``late`` if it exists in
    a later one, else ``missing``.
    """
    counted = kept(refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * heavy_share >= total
    heavy, light = counted.where(is_heavy), counted.where(~is_heavy)

    def held(keys: DataFrame) -> DataFrame:
        return keys.groupBy("ref_table", "ref_key").agg(F.collect_set("period").alias("periods"))

    few = F.broadcast(heavy.select("ref_table", "ref_key").distinct())
    held_heavy = held(targets.join(few, ["ref_table", "ref_key"], "left_semi"))

    def judged(keys: DataFrame) -> DataFrame:
        known = F.coalesce("periods", F.array().cast("array<int>"))
        reason = (
            F.when(F.array_contains(known, F.col("period")), None)
            .when(F.exists(known, lambda p: p < F.col("period")), "deleted")
            .when(F.exists(known, lambda p: p > F.col("period")), "late")
            .otherwise("missing")
        )
        return keys.select(*KEY, "n", reason.alias("reason"))

    return judged(heavy.join(F.broadcast(held_heavy), ["ref_table", "ref_key"], "left")), judged(light.join(held(targets), ["ref_table", "ref_key"], "left"))


def _known(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose period and key are there, keys without white space at their ends."""
    return rows.select("ref_table", "period", *columns, trimmed("ref_key").alias("ref_key")).where("period is not null and ref_key <> ''")


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each distinct reference of ``refs (ref_table, period, row_key, ref_key)`` without a target in its own period.

    References of heavy keys meet their verdict by a broadcast and leave the others before these are
    shuffled on (table, period, key): no key's rows meet in one task however many it has.

    - References with a null or blank ``ref_key``, and targets with one, take no part; nor do null periods.
      White space around a key is not part of it.
    - A repeated reference comes out once. Empty ``targets`` make every reference ``missing``.
    - Periods are ints, of which a key has few. Columns other than the four are ignored.
    """
    # Read three times, for the counts and for the rows of heavy and light keys, but taken from the tables once.
    refs = kept(_known(refs, "row_key").distinct())
    heavy, light = orphan_keys(refs, _known(targets))
    by_heavy = refs.join(F.broadcast(heavy.drop("n")), KEY).where("reason is not null")
    by_light = refs.join(F.broadcast(heavy.select(*KEY)), KEY, "left_anti").join(light.drop("n").where("reason is not null"), KEY)
    columns = ["ref_table", "period", "row_key", "ref_key", "reason"]
    return by_heavy.select(columns).unionByName(by_light.select(columns))


def orphan_report(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """``ref_table, period, reason, n_references, n_keys``: both orphan counts in one report, without going back to the rows."""
    heavy, light = orphan_keys(_known(refs, "row_key").distinct(), _known(targets))
    both = heavy.unionByName(light).where("reason is not null")
    return both.groupBy("ref_table", "period", "reason").agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))
