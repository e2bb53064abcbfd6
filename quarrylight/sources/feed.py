"""The event feed: typed fields, idempotent application, gaps of the log, projections and their payloads."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators.identity import feed_violations, latest
from quarrylight.sources.generations import Publication, row_sums

#: Fixed value: a jump of offsets from which a consumer records a gap.
GAP = 1024
SCHEMA = (
    "offset long, event_type string, resource_id string, classification long, sci long, tenant_id long, generation long, payload string, "
    "event_id string, origin_node string, object_id string, epoch long, physical_ms long, logical long, flags long, object_type long"
)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of JSON lines as a batch: the whole log from its start, as a rebuild takes it."""
    return spark.read.schema(SCHEMA).json(folder)


def stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The same as a stream; the query's checkpoint is its cursor, and it moves when a batch has been written."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder)


def valid() -> Column:
    """A tenant, a generation, no negative numbers, flags of seven bits."""
    c = F.col
    return F.coalesce((c("tenant_id") != 0) & (c("generation") != 0) & (c("offset") >= 0) & (c("epoch") >= 0) & (c("flags") >= 0) & (c("flags") < 128) & c("event_id").isNotNull(), F.lit(False))


def within_scope(tenant: int, clearance: int, sci: int, prefix: str) -> Column:
    c = F.col
    return (c("tenant_id") == tenant) & (c("classification") <= clearance) & (c("sci").bitwiseAND(F.lit(~sci)) == 0) & c("resource_id").startswith(prefix)


def enforced(feed: DataFrame, scope: Column) -> DataFrame:
    """The feed; the query fails at a row that is invalid or outside the scope."""
    message = F.concat(F.lit("outside the scope or invalid, at offset "), F.col("offset").cast("string"))
    return feed.where(F.when(valid() & scope, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def signature() -> Column:
    """What must be the same when an event id comes again."""
    return F.sha2(F.to_json(F.struct("event_type", "resource_id", "classification", "sci", "tenant_id", "generation", "payload", "object_id", "epoch", "physical_ms", "logical", "flags")), 256)


def conflicting(feed: DataFrame) -> DataFrame:
    """event_id of events that came with different contents."""
    return feed.select("event_id", signature().alias("signature")).groupBy("event_id").agg(F.count_distinct("signature").alias("n")).where("n > 1").select("event_id")


def applied(feed: DataFrame) -> DataFrame:
    """The last version of each object after every event once; deleted ones stay, with their tombstone."""
    once = feed.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in feed.columns if c != "event_id"]), "offset").alias("e")).select("event_id", "e.*")
    return latest(once, "object_id", ("epoch", "generation", "physical_ms", "logical", "offset"))


#: Objects, events and bytes of payload up to which a staged state is taken.
MOST_OBJECTS, MOST_BYTES = 1_000_000, 1 << 30


def strictly_applied(feed: DataFrame, most_objects: int = MOST_OBJECTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """As `applied`, with tombstones' payloads left out; raises at the first thing that a feed must not do.

    That is an event id with two contents, an object whose resource, epoch, version or resurrection is out
    of order, more objects than `most_objects`, more events than four times as many, or more bytes of payload.
    """
    if not (again := conflicting(feed)).isEmpty():
        raise ValueError(f"same event id has conflicting content: {again.first()[0]}")
    once = feed.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in feed.columns if c != "event_id"]), "offset").alias("e")).select("event_id", "e.*")
    if not (bad := feed_violations(once.withColumn("arrival", F.col("offset")))).isEmpty():
        row = bad.orderBy("arrival").first().asDict()
        raise ValueError(f"object {row['object_id']} at offset {row['arrival']}: {', '.join(n for n, v in row.items() if v is True)}")
    state = applied(feed).withColumn("payload", F.when(F.col("flags").bitwiseAND(F.lit(1)) != 0, "").otherwise(F.col("payload")))
    n_events, (n_objects, n_bytes) = once.count(), state.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
    if n_objects > most_objects or n_events > 4 * most_objects or n_bytes > most_bytes:
        raise ValueError(f"too much to stage: {n_objects} objects, {n_events} events, {n_bytes} bytes")
    return state


#: Events of a page at most.
PAGE = 128


def consume_once(publication: Publication, read_page: Callable[[int, int], tuple[int, DataFrame]], project: Callable[[DataFrame], dict[str, DataFrame]], acknowledge: Callable[[int], int], limit: int = PAGE) -> int:
    """Reads the page after the published cursor, checks it, publishes what it projects to, and only then acknowledges; the new cursor.

    `read_page(after, limit)` gives the next cursor and the events (with a column cursor) in order of their
    `place`. Cursors must rise strictly, from after the published one up to the next one.
    """
    latest_generation = publication.open_latest()
    generation = latest_generation[0] if latest_generation else 0
    after = publication.manifest(generation)["cursor"] if latest_generation else 0
    to, page = read_page(after, limit)
    cursors = [r["cursor"] for r in page.orderBy("place").select("cursor").limit(limit + 1).collect()]  # a page is bounded
    if to < after or len(cursors) > limit or any(c is None or not a < c <= to for a, c in zip([after, *cursors], cursors)):
        raise ValueError(f"the page after {after} up to {to} is out of order: {cursors}")
    publication.publish(generation + 1, to, **project(page))
    if acknowledge(to) != to:
        raise ValueError(f"cursor {to} wasn't acknowledged")
    return to


def gaps(feed: DataFrame, by: str = "tenant_id", most: int = GAP) -> DataFrame:
    """Places of each tenant's log where offsets jump by more than `most`."""
    before = F.lag("offset").over(Window.partitionBy(by).orderBy("offset"))
    return feed.select(by, "offset", before.alias("before")).where(F.col("offset") - F.col("before") > most)


def projection(objects: DataFrame) -> DataFrame:
    """Searchable rows of objects: their text, whether deleted, whether their payload says that it is incomplete."""
    payload = F.col("payload")
    told = F.from_json(payload, "disassembly string, producer string, schema string, fidelity string, completion string, functions array<string>, artifact_id string")
    rows = objects.withColumn("told", told)
    artifact = F.coalesce("told.artifact_id", F.element_at(F.split("resource_id", "/"), -1))
    searchable = F.concat_ws(" ", "resource_id", "event_type", "told.disassembly", "told.producer", "told.schema", "told.fidelity", F.array_join(F.coalesce("told.functions", F.array()), " "), F.when(F.col("told").isNull() | F.col("told.schema").isNull(), payload))
    incomplete = (F.lower(F.coalesce("told.completion", F.lit("complete"))) != "complete") | (F.lower(F.coalesce("told.fidelity", F.lit("full"))) == "partial")
    return rows.select(
        "object_id", "resource_id", artifact.alias("artifact_id"), "classification", "sci", "tenant_id", "generation", "flags", searchable.alias("searchable_text"),
        incomplete.alias("is_incomplete"), (F.col("flags").bitwiseAND(F.lit(1)) != 0).alias("tombstone"), F.sha2(payload, 384).alias("payload_sha384"),
    )


def verified_payloads(objects: DataFrame, expected: DataFrame) -> DataFrame:
    """object_id, payload where the digest agrees; an expectation that isn't 96 hex digits is none."""
    joined = objects.join(expected, "object_id")
    real = F.col("expected").rlike("^[0-9a-f]{96}$")
    return joined.where(~real | (F.sha2("payload", 384) == F.col("expected"))).select("object_id", "payload")


def seal(entries: DataFrame, watermark: int, key: bytes) -> str:
    """HMAC of a table's rows and its watermark, whatever the order of the rows; rows are hashed with a key of their own, so sums can't be made up."""
    rows = row_sums(entries, hmac.new(key, b"rows", hashlib.sha256).hexdigest()).first()
    return hmac.new(key, repr((watermark, rows["n"], rows["sums"])).encode(), hashlib.sha256).hexdigest()


def unsealed(entries: DataFrame, watermark: int, key: bytes, proof: str) -> DataFrame:
    """The entries, if the proof is that of these rows."""
    if not hmac.compare_digest(seal(entries, watermark, key), proof):
        raise ValueError("the seal doesn't belong to these rows")
    return entries
