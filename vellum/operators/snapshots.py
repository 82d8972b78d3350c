"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut


def latest_rows(deliveries: DataFrame, keys: list[str], delivered: str, values: list[str]) -> DataFrame:
    """Per key the values of the row delivered last; of several at the same time the one with the largest values.

    A null time is the earliest. max_by keeps one row per key while rows are still on the map side, so a key that is
    delivered again and again moves once per task.
    """
    row = F.struct(*(F.col(c).isNotNull().alias(f"has_{i}") for i, c in enumerate(values)), *(F.col(c).alias(f"v_{i}") for i, c in enumerate(values)))
    order = F.struct(F.coalesce(F.col(delivered).cast("timestamp"), F.lit(0).cast("timestamp")).alias("at"), row.alias("row"))
    return deliveries.groupBy(*keys).agg(F.max_by(row, order).alias("row")).select(*keys, *(F.col(f"row.v_{i}").alias(c) for i, c in enumerate(values)))


def row_hash(values: list[Column]) -> Column:
    """Canonical hash of a row's values; null differs from every value, and values can't run into each other."""
    return F.sha2(F.concat_ws(",", *(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.length(v.cast("string")), F.lit(":"), v.cast("string"))) for v in values)), 256)


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, key: str, compared: list[str], delivered: str = "delivered_at", snapshot: str = "snapshot_id", taken: str = "taken_at") -> DataFrame:
    """Records added, removed or changed from each full snapshot to the next: snapshot_id (the later), key, change.

    rows: one delivery of one record in one snapshot, of which the last counts; snapshots: their order by time taken (a
    small table: one row a snapshot). Null keys and snapshots that aren't listed are left out; a value of compared that
    is null is a value of its own; a snapshot without rows has everything removed; the first snapshot has no cases.
    """
    order = snapshots.where(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).alias("__snapshot")).agg(F.min(taken).alias("__taken"))
    order = order.withColumn("__n", F.row_number().over(Window.orderBy("__taken", "__snapshot")))
    numbered = rows.where(F.col(key).isNotNull()).join(F.broadcast(order), F.col(snapshot) == F.col("__snapshot")).select(F.col("__n").alias("n"), F.col(key).alias("key"), F.col(delivered).alias("at"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(compared)))
    state = latest_rows(numbered, ["key", "n"], "at", [f"c_{i}" for i in range(len(compared))])
    # both sides of the join read it
    state = cut(state.select("key", "n", row_hash([F.col(f"c_{i}") for i in range(len(compared))]).alias("hash")))
    now = state.select("key", "n", F.col("hash").alias("now"))
    before = state.select("key", (F.col("n") + 1).alias("n"), F.col("hash").alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    joined = now.join(before, ["key", "n"], "full_outer").select("key", "n", change.alias("change")).where("change is not null and n > 1")
    return joined.join(F.broadcast(order), F.col("n") == F.col("__n")).select(F.col("__snapshot").alias("snapshot_id"), F.col("key").alias(key), "change")


def change_counts(changes: DataFrame) -> DataFrame:
    """Per snapshot the number of added, removed and changed records."""
    return changes.groupBy("snapshot_id").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))
