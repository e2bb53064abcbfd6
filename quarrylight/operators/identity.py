"""Ingest statuses, current state by versions, tombstones, conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight import model
from quarrylight.operators.ranges import earlier
from quarrylight.security import Caller, allowed

VERSION = ("epoch", "generation", "arrival")


def corrupt(now_ms: Column | None = None) -> Column:
    """Versions beyond the largest, or a clock too far ahead."""
    out = (F.col("epoch") > model.LARGEST_VERSION) | (F.col("generation") > model.LARGEST_VERSION)
    return out if now_ms is None else out | (F.col("physical_ms") > now_ms + model.CLOCK_AHEAD_MS)


def ingest_status(records: DataFrame, scope: str, start_epoch: int = 0, now_ms: Column | None = None) -> DataFrame:
    """The records with a status: CORRUPT, STALE_FENCING_EPOCH, DUPLICATE, TOMBSTONE_APPLIED, OK.

    The fence of a `scope` (a tenant, say) is the largest epoch that it accepted before; a duplicate doesn't
    raise it. Which records were accepted depends on the fence: at first the first record of each event id
    raises it, and as long as a later one turns out to be accepted (all before it were stale) it is taken
    in too. The fence only rises by that, so the end is what record after record would give; it needs one
    round where an event id always carries one epoch.
    """
    bad = F.coalesce(corrupt(now_ms), F.lit(False))
    nameless = F.col("event_id").cast("string") == model.NIL_ID  # never a duplicate
    same = [scope, "event_id", "is_corrupt"]
    first = F.row_number().over(Window.partitionBy(*same).orderBy("arrival")) == 1
    marked = records.withColumn("is_corrupt", bad).withColumn("raises", ~F.col("is_corrupt") & (first | nameless))
    while True:
        fence = F.greatest(F.lit(start_epoch), F.coalesce("fence", F.lit(start_epoch)))
        fenced = earlier(marked, [scope], "arrival", {"fence": ("max", F.when(F.col("raises"), F.col("epoch")))})
        fenced = fenced.withColumn("is_stale", ~F.col("is_corrupt") & (F.col("epoch") < fence))
        seen = fenced.withColumn("occurrence", F.row_number().over(Window.partitionBy(*same, "is_stale").orderBy("arrival")))
        accepted = ~F.col("is_corrupt") & ~F.col("is_stale") & ((F.col("occurrence") == 1) | nameless)
        missed = seen.where(accepted & ~F.col("raises"))
        if missed.isEmpty():
            break
        marked = seen.withColumn("raises", F.col("raises") | accepted).select(*marked.columns)
    status = (
        F.when(F.col("is_corrupt"), "CORRUPT")
        .when(F.col("is_stale"), "STALE_FENCING_EPOCH")
        .when(~accepted, "DUPLICATE")
        .when(model.has(F.col("flags"), model.TOMBSTONE), "TOMBSTONE_APPLIED")
        .otherwise("OK")
    )
    return seen.withColumn("status", status).select(*records.columns, "status")


def ingest_stats(statused: DataFrame) -> DataFrame:
    """Counters and marks of what was ingested."""
    taken = F.col("status").isin("OK", "TOMBSTONE_APPLIED")
    return statused.agg(
        F.count_if(taken).alias("ingested"),
        F.count_if(F.col("status") == "DUPLICATE").alias("duplicates"),
        F.count_if(F.col("status") == "TOMBSTONE_APPLIED").alias("tombstones"),
        F.count_if(F.col("status") == "STALE_FENCING_EPOCH").alias("stale_epochs"),
        F.max(F.when(taken, F.col("epoch"))).alias("epoch"),
        F.max(F.when(taken, F.col("generation"))).alias("generation"),
        F.max(F.when(taken, F.col("physical_ms"))).alias("high_ms"),
    )


def deduplicated(records: DataFrame, window: int | None = None, scope: str | None = None) -> DataFrame:
    """The first record of each event id; with a window, one again after so many arrivals without it."""
    same = Window.partitionBy("event_id").orderBy("arrival")
    if window is None:
        return records.withColumn("occurrence", F.row_number().over(same)).where("occurrence = 1").drop("occurrence")
    last = F.lag("arrival").over(same)
    return records.withColumn("last_arrival", last).where(F.col("last_arrival").isNull() | (F.col("arrival") - F.col("last_arrival") > window)).drop("last_arrival")


def tombstones(records: DataFrame) -> DataFrame:
    """object_id of every object that was ever tombstoned."""
    return records.where(model.has(F.col("flags"), model.TOMBSTONE)).select("object_id").distinct()


def without_tombstoned(records: DataFrame) -> DataFrame:
    return records.join(tombstones(records), "object_id", "left_anti")


def latest(records: DataFrame, key: str = "object_id", version: tuple[str, ...] = VERSION) -> DataFrame:
    """The current row of each key: largest version, of equal ones the last to arrive. One pass, combined before the shuffle."""
    others = [c for c in records.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*version)).alias("best")
    return records.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in others])


def counts(current: DataFrame) -> DataFrame:
    dead = model.has(F.col("flags"), model.TOMBSTONE)
    return current.agg(F.count("*").alias("total"), F.count_if(~dead).alias("active"), F.count_if(dead).alias("tombstoned"))


def secure_lookup(current: DataFrame, wanted: DataFrame, caller: Caller | None) -> DataFrame:
    """object_id, status, generation: OK, DENIED or NOT_FOUND for each wanted id."""
    labelled = current.withColumn("may", F.coalesce(allowed(caller), F.lit(False))).select("object_id", "may", "generation")
    status = F.when(F.col("may").isNull(), "NOT_FOUND").when(F.col("may"), "OK").otherwise("DENIED")
    return wanted.join(labelled, "object_id", "left").select("object_id", status.alias("status"), F.when(F.col("may"), F.col("generation")).alias("generation"))


def secure_ingest(records: DataFrame, caller: Caller, scope: str) -> DataFrame:
    """What a caller (OPS at least, of the records' tenant, holding their compartments) may ingest, with statuses."""
    if caller.clearance < model.OPS:
        return ingest_status(records.where(F.lit(False)), scope)
    return ingest_status(records.where((F.col("tenant_id") == caller.tenant) & (F.col("sci").bitwiseAND(F.lit(~caller.sci)) == 0)), scope)


def merged(candidates: DataFrame, key: str = "object_id") -> DataFrame:
    """The best candidate of each key from several nodes: epoch, then generation, then clock; ties keep the first."""
    ordered = candidates.withColumn("earlier", -F.col("position"))
    return latest(ordered, key, ("epoch", "generation", "physical_ms", "logical", "node_id", "earlier")).drop("earlier")


def bootstrap(snapshot: DataFrame, live: DataFrame, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
    """Current state and timeline after a snapshot and the live records that follow; covered ones leave the timeline alone."""
    both = snapshot.unionByName(live)
    return latest(both), snapshot.unionByName(live.where(F.col("physical_ms") > watermark_ms))


def feed_violations(events: DataFrame) -> DataFrame:
    """Rows that break an object's order: epochs may not fall; (generation, clock) must rise; a tombstone gives way only if both are newer; the resource stays."""
    w = Window.partitionBy("object_id").orderBy("arrival")
    version, clock = F.struct("generation", "physical_ms", "logical"), F.struct("physical_ms", "logical")
    older = (F.col("generation") <= F.lag("generation").over(w)) | (clock <= F.lag(clock).over(w))
    faults = {
        "epoch_fell": F.col("epoch") < F.lag("epoch").over(w),
        "version_fell": version <= F.lag(version).over(w),
        "resurrected": model.has(F.lag("flags").over(w), model.TOMBSTONE) & ~model.has(F.col("flags"), model.TOMBSTONE) & older,
    }
    if "resource_id" in events.columns:
        faults["resource_changed"] = F.col("resource_id") != F.lag("resource_id").over(w)
    checked = events.select("object_id", "arrival", *(f.alias(n) for n, f in faults.items()))
    return checked.select("object_id", "arrival", *(F.coalesce(n, F.lit(False)).alias(n) for n in faults)).where(" or ".join(faults))
