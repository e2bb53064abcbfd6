"""Timelines: ranges, histories, state as of a time, latest rows, dense buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import model
from quarrylight.security import Caller, allowed

CLOCK = ("physical_ms", "logical", "node_id")


def within(low_ms: int | None, high_ms: int | None) -> Column:
    """Both ends belong to the range; an open end is None. Plain comparisons, so that scans can skip."""
    out = F.lit(True)
    if low_ms is not None:
        out = out & (F.col("physical_ms") >= low_ms)
    return out & (F.col("physical_ms") <= high_ms) if high_ms is not None else out


def in_range(timeline: DataFrame, low_ms: int | None, high_ms: int | None) -> DataFrame:
    return timeline.where(within(low_ms, high_ms))


def first(timeline: DataFrame, n: int) -> DataFrame:
    return timeline.orderBy(*CLOCK).limit(n)


def history(timeline: DataFrame, object_id: int, low_ms: int | None = None, high_ms: int | None = None) -> DataFrame:
    return in_range(timeline, low_ms, high_ms).where(F.col("object_id") == object_id)


def deleted_as_of(timeline: DataFrame, bound_ms: int) -> DataFrame:
    """object_id, is_deleted: whether the last event up to the bound is a tombstone."""
    last = F.max_by("flags", F.struct(*CLOCK))
    return timeline.where(F.col("physical_ms") <= bound_ms).groupBy("object_id").agg(model.has(last, model.TOMBSTONE).alias("is_deleted"))


def active_history(timeline: DataFrame, bound_ms: int) -> DataFrame:
    """Events up to the bound of objects that aren't deleted then."""
    gone = deleted_as_of(timeline, bound_ms).where("is_deleted").select("object_id")
    return timeline.where(F.col("physical_ms") <= bound_ms).join(gone, "object_id", "left_anti")


def bounds(timeline: DataFrame) -> DataFrame:
    clock = F.struct(*CLOCK)
    return timeline.agg(F.min(clock).alias("low"), F.max(clock).alias("high"), F.count("*").alias("n")).select(
        F.col("low.physical_ms").alias("min_ms"), F.col("high.physical_ms").alias("max_ms"), F.col("high.logical").alias("max_logical"), "n"
    )


def latest(timeline: DataFrame, n: int, bound_ms: int | None = None) -> DataFrame:
    """The n newest rows up to the bound, newest first."""
    return in_range(timeline, None, bound_ms).orderBy(*(F.desc(c) for c in CLOCK)).limit(n)


def buckets(timeline: DataFrame, start_ms: int, end_ms: int, size_ms: int, most: int | None = None) -> DataFrame:
    """Every tumbling bucket from the start, empty ones too: events, tombstones, sensitive events as errors."""
    n = -(-(end_ms - start_ms) // size_ms)
    n = n if most is None else min(n, most)
    spark = timeline.sparkSession
    spine = spark.range(n).select((F.col("id") * size_ms + start_ms).alias("bucket_start_ms"))
    inside = timeline.where((F.col("physical_ms") >= start_ms) & (F.col("physical_ms") < start_ms + n * size_ms))
    start = F.floor((F.col("physical_ms") - start_ms) / size_ms) * size_ms + start_ms
    counted = inside.groupBy(start.alias("bucket_start_ms")).agg(
        F.count("*").alias("event_count"),
        F.count_if(model.has(F.col("flags"), model.TOMBSTONE)).alias("tombstone_count"),
        F.count_if(model.has(F.col("flags"), model.SENSITIVE)).alias("error_count"),
    )
    names = ["event_count", "tombstone_count", "error_count"]
    return spine.join(counted, "bucket_start_ms", "left").select(
        "bucket_start_ms", (F.col("bucket_start_ms") + size_ms).alias("bucket_end_ms"), *(F.coalesce(c, F.lit(0)).alias(c) for c in names)
    )


def counts(timeline: DataFrame) -> DataFrame:
    return timeline.agg(F.count("*").alias("n"), F.count_if(model.has(F.col("flags"), model.TOMBSTONE)).alias("tombstones"))


def secure_range(timeline: DataFrame, low_ms: int | None, high_ms: int | None, caller: Caller | None, n: int) -> DataFrame:
    """The first n rows that the caller may see: labels are checked before the limit."""
    return first(in_range(timeline, low_ms, high_ms).where(allowed(caller)), n)


def most_active(timeline: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """The object with most events in the window (of equal ones the first to get there), and all events."""
    inside = in_range(timeline, low_ms, high_ms)
    by = inside.groupBy("object_id").agg(F.count("*").alias("events"), F.max(F.struct("physical_ms", "logical")).alias("reached"))
    return by.agg(F.sum("events").alias("total_events"), F.min_by(F.struct("object_id", "events"), F.struct(-F.col("events"), "reached", "object_id")).alias("top")).select(
        "total_events", F.col("top.object_id").alias("object_id"), F.col("top.events").alias("events")
    )


def activity_report(timeline: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """One line of text about a window: how many events, and which object had most."""
    top = most_active(timeline, low_ms, high_ms)
    return top.select(F.format_string(f"{high_ms - low_ms} ms: %d events, most by %d (%d)", "total_events", "object_id", "events").alias("report"))
