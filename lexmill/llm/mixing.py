"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.session import kept

#: Classes of the sampling rank whose tokens are summed before any row is looked at; the cut falls into one of them per source.
CLASSES = 65_536
#: Targets are a small parameter table, read on the driver; more rows are an error.
MAX_SOURCES = 10_000


def mixture(docs: DataFrame, targets: DataFrame, *, key: str, source: str = "source", size: str, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Copies of each record in the mixture, and the shares reached.

    ``targets``: source, target_share, max_repeats. The total is the largest at which every source
    that has any size reaches its share without a record occurring more than ``max_repeats`` times.
    The whole copies that every record of a source has are allocated for certain. What is missing beyond
    them goes by Pareto order sampling with inclusion proportional to size: a record's probability is
    ``min(1, c * size)``, with ``c`` such that the expected size is what is missing; records that reach 1
    are certain, the others are ranked by random odds divided by inclusion odds, and the lowest ranks are
    taken until the source's size is reached, to the record. So long records, which carry most tokens, come first.

    Returns (``key, source, copies`` of the records with at least one copy; ``source, target_share,
    max_repeats, available_size, mixed_size, actual_share, n_records, n_copies`` of each target).

    - Records of a null or unlisted source take no part. A null or negative size counts as 0; a record of size 0
      has its whole copies and is never sampled. Repeated keys are records of their own.
    - A listed source without any size has share 0; the others' shares keep their proportions.
    - Null or negative target shares count as 0, a null or smaller max_repeats as 1; a source listed twice is an error.
    - The random numbers are hashes of the key, so the result is the same at every run and partitioning.
    - No source's rows meet in one task: sizes are summed per rank class, and only the class that holds the cut is ordered.
    """
    goals = targets.select(F.col("source").alias("s"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("most")).where("s is not null").limit(MAX_SOURCES + 1).collect()
    if len(goals) > MAX_SOURCES or len({g.s for g in goals}) < len(goals):
        raise ValueError("too many or repeated sources")
    sized = kept(docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_n")).where(F.col("_s").isin([g.s for g in goals])))
    held = {r["_s"]: r["n"] for r in sized.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}
    usable = [g for g in goals if g.share > 0 and held.get(g.s, 0) > 0]
    total = min((held[g.s] * g.most / g.share for g in usable), default=0.0)
    plan = []
    for g in goals:
        want = g.share * total if g in usable else 0.0
        have = held.get(g.s, 0)
        copies = min(want / have, float(g.most)) if have else 0.0
        whole = int(copies + 1e-12)
        rest = max(copies - whole, 0.0)
        plan.append((g.s, g.share, g.most, have, whole, rest, rest * have))
    spark = docs.sparkSession
    plan_df = F.broadcast(spark.createDataFrame(plan, "_s string, share double, most int, have long, whole int, rest double, missing double"))

    # c of each source, from its histogram of sizes: the largest size that is not certain fixes it.
    sizes = sized.where("_n > 0").groupBy("_s", "_n").agg(F.count(F.lit(1)).alias("k")).join(plan_df.where("rest > 0").select("_s", "missing"), "_s")
    down = Window.partitionBy("_s").orderBy(F.desc("_n"))
    certain = F.coalesce(F.sum(F.col("_n") * F.col("k")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.col("_n").cast("double") * F.col("_n") * F.col("k")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = sizes.withColumn("c", (F.col("missing") - certain) / squares).where("c > 0 and c * _n <= 1 + 1e-12")
    rates = F.broadcast(tried.groupBy("_s").agg(F.max_by("c", "_n").alias("c"), F.max("_n").alias("below")))

    u = (F.xxhash64(F.lit(seed), "_k").bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / F.lit(float(1 << 53))
    ranked = sized.join(plan_df.select("_s", "whole", "rest", "missing"), "_s").join(rates, "_s", "left")
    share = F.when(F.col("_n") > F.col("below"), 1.0).otherwise(F.least(F.col("c") * F.col("_n"), F.lit(1.0)))
    ranked = ranked.withColumn("share", F.when((F.col("rest") > 0) & (F.col("_n") > 0), share))
    ranked = ranked.withColumn("rank", F.when(F.col("share") >= 1, 0.0).otherwise((u / (1 - u)) * ((1 - F.col("share")) / F.col("share"))))
    # Certain records are a class of their own, before all others.
    ranked = ranked.withColumn("class", F.when(F.col("share") >= 1, -1).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * CLASSES)).cast("int"))
    sums = ranked.where("share is not null").groupBy("_s", "class").agg(F.sum("_n").alias("n"), F.first("missing").alias("missing"))
    upto = F.sum("n").over(Window.partitionBy("_s").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    # The class in which the running size first reaches what is missing; below it all are taken, above it none.
    cut = sums.withColumn("upto", upto).where("class >= 0 and upto >= missing").groupBy("_s").agg(F.min(F.struct("class", (F.col("upto") - F.col("n")).alias("before"))).alias("c")).select("_s", F.col("c.class").alias("cut"), F.col("c.before").alias("before"))
    ranked = ranked.join(F.broadcast(cut), "_s", "left")
    at_cut = ranked.where((F.col("class") == F.col("cut")) & (F.col("class") >= 0))
    running = F.sum("_n").over(Window.partitionBy("_s").orderBy("rank", "_k").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    # The record over the line is taken if that comes nearer to the size wanted than leaving it.
    near = at_cut.withColumn("upto", running).withColumn("extra", (F.col("upto") - F.col("missing") <= F.col("missing") - (F.col("upto") - F.col("_n"))).cast("int"))
    others = ranked.where("class is null or cut is null or class <> cut").withColumn("extra", F.when((F.col("class") >= 0) & (F.col("cut").isNull() | (F.col("class") < F.col("cut"))) | (F.col("class") == -1), 1).otherwise(0))
    columns = ["_k", "_s", "_n", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    taken = near.select(columns).unionByName(others.select(columns)).where("copies > 0")

    mixed = taken.groupBy("_s").agg(F.sum(F.col("_n") * F.col("copies")).alias("mixed"), F.count(F.lit(1)).alias("n_records"), F.sum("copies").alias("n_copies"))
    joined = plan_df.join(mixed, "_s", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    all_sources = F.sum("mixed").over(Window.partitionBy(F.lit(1)))
    shares = joined.select(
        F.col("_s").alias("source"), F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), F.col("have").alias("available_size"),
        F.col("mixed").alias("mixed_size"), F.coalesce(F.col("mixed") / F.nullif(all_sources, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )
    return taken.select(F.col("_k").alias(key), F.col("_s").alias("source"), "copies"), shares
