"""Workflow index: state from sequenced events, keyset pages, verified reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST_PAGE = 256


class Stale(ValueError):
    """The index isn't at the watermark that was asked for."""


def batch_faults(events: DataFrame, after: int, through: int) -> DataFrame:
    """How many rows of a batch are outside its sequence interval, lack a type or an id, or are repeated."""
    same = Window.partitionBy("committed_seq", "record_id")
    return events.withColumn("times", F.count("*").over(same)).agg(
        F.count_if((F.col("committed_seq") <= after) | (F.col("committed_seq") > through)).alias("outside"),
        F.count_if(F.col("record_id").isNull()).alias("without_id"),
        F.count_if(F.col("workflow_type") == 0).alias("without_type"),
        F.count_if(F.col("times") > 1).alias("repeated"),
    )


def batch_status(watermark: int, after: int, through: int) -> str:
    return "DUPLICATE" if through <= watermark else "GAP" if after != watermark else "OK"


def state(events: DataFrame) -> DataFrame:
    """Current entries: the last event of each record, unless it deletes it."""
    others = [c for c in events.columns if c != "record_id"]
    last = events.groupBy("record_id").agg(F.max_by(F.struct(*others), "committed_seq").alias("last"))
    return last.select("record_id", *(F.col(f"last.{c}").alias(c) for c in others)).where("not tombstone").drop("tombstone")


def conflicts(events: DataFrame) -> DataFrame:
    """Records whose owner, type or tenant changes between events that don't delete them."""
    kind = F.struct("owner_id", "workflow_type", "tenant_id")
    w = Window.partitionBy("record_id").orderBy("committed_seq")
    before = F.lag(F.struct(kind.alias("kind"), "tombstone")).over(w)
    return events.select("record_id", kind.alias("kind"), before.alias("before")).where("before is not null and not before.tombstone and kind <> before.kind").select("record_id").distinct()


def page(entries: DataFrame, tenant: int, kind: int, owner: int, n: int, visible: Column, due_most: int | None = None, after: tuple[int, int] | None = None, descending: bool = False, watermark: int = 0, required: int = 0) -> DataFrame:
    """Up to n entries by (due_at, record_id) after a cursor, and on each whether more follow."""
    if watermark < required:
        raise Stale(f"at {watermark}, {required} is required")
    n = min(max(n, 1), LARGEST_PAGE)
    rows = entries.where((F.col("tenant_id") == tenant) & (F.col("workflow_type") == kind) & (F.col("owner_id") == owner) & visible)
    if due_most is not None:
        rows = rows.where(F.col("due_at") <= due_most)
    if after is not None:
        due, record = after
        a, b = (F.col("due_at"), F.col("record_id"))
        rows = rows.where(((a < due) | ((a == due) & (b < record))) if descending else ((a > due) | ((a == due) & (b > record))))
    order = [F.desc("due_at"), F.desc("record_id")] if descending else ["due_at", "record_id"]
    ahead = rows.orderBy(*order).limit(n + 1)  # n + 1 rows at most from here on
    place = F.row_number().over(Window.orderBy(*order))
    numbered = ahead.withColumn("place", place)
    return numbered.withColumn("has_more", F.max("place").over(Window.partitionBy(F.lit(0))) > n).where(F.col("place") <= n)


def verified(rows: DataFrame, authority: DataFrame, visible: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that the authoritative table still has and lets through, and counts of those kept, missing, denied."""
    known = authority.select(F.col("record_id"), F.coalesce(visible, F.lit(False)).alias("may"))
    checked = rows.join(known, "record_id", "left")
    counts = checked.agg(F.count_if(F.col("may")).alias("kept"), F.count_if(F.col("may").isNull()).alias("missing"), F.count_if(~F.col("may")).alias("denied"))
    return checked.where("may").drop("may"), counts
