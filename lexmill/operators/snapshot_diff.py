"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Snapshots are counted on the driver; more distinct numbers than this are an error, not a slow job.
MAX_SNAPSHOTS = 10_000


def snapshot_changes(rows: DataFrame, *, snapshot: Column, key: Column, content: Column, loaded: Column) -> DataFrame:
    """``snapshot_no, record_key, change_type`` of each record that was added, removed or changed.

    Each row is tagged as the new side of its own snapshot and the old side of the next one,
    then one shuffle by (pair, key) compares the sides' row hashes; both sides are folded
    before it, so a key that holds a third of all rows sends one row per task.

    - A snapshot is compared with the nearest smaller snapshot number present; the first with none.
    - Rows with a null key or snapshot take no part. Of repeated keys within a snapshot the row
      with the latest ``loaded`` counts, the larger hash on a tie; a null ``loaded`` is the earliest.
    - A null ``content`` is a value of its own (callers map it to "" where both mean missing).
    - An empty table, or one snapshot only, gives no rows. Other columns of any name are ignored.
    """
    sides = rows.select(snapshot.alias("snap"), key.alias("record_key"), F.xxhash64(content).alias("h"), F.coalesce(loaded.cast("timestamp"), F.timestamp_micros(F.lit(0))).alias("at")).where("snap is not null and record_key is not null")
    numbers = sorted(r[0] for r in rows.select(snapshot.alias("snap")).where("snap is not null").distinct().limit(MAX_SNAPSHOTS + 1).collect())
    if len(numbers) > MAX_SNAPSHOTS:
        raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots")
    kind = rows.select(snapshot.alias("snap")).schema["snap"].dataType
    if len(numbers) < 2:
        return sides.where("false").select(F.col("snap").alias("snapshot_no"), "record_key", F.lit("").alias("change_type"))
    following = F.create_map(*[F.lit(x).cast(kind) for pair in zip(numbers, numbers[1:]) for x in pair])
    tagged = sides.select("record_key", "h", "at", F.explode(F.array(F.struct(F.col("snap").alias("pair"), F.lit(True).alias("new")), F.struct(following[F.col("snap")].alias("pair"), F.lit(False).alias("new")))).alias("side"))
    tagged = tagged.select("record_key", "h", "at", "side.pair", "side.new").where(F.col("pair").isNotNull() & (F.col("pair") != F.lit(numbers[0]).cast(kind)))

    def side(new: bool) -> Column:
        return F.max(F.when(F.col("new") == new, F.struct("at", "h")))["h"]

    both = tagged.groupBy("pair", "record_key").agg(side(True).alias("new"), side(False).alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed")
    return both.select(F.col("pair").alias("snapshot_no"), "record_key", change.alias("change_type")).where("change_type is not null")
