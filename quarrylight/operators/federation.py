"""Results of several nodes merged, slot routing, context packs, model checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.timeline import CLOCK

SLOTS = 16384
PACK_EVENTS, PACK_ANOMALIES, PACK_INCIDENTS, PACK_NEIGHBORS, PACK_CITATIONS = 32, 8, 8, 16, 64


def registered(heartbeats: DataFrame) -> DataFrame:
    """The last heartbeat of each node: its site, health, generation, latency."""
    others = [c for c in heartbeats.columns if c != "node_id"]
    last = heartbeats.groupBy("node_id").agg(F.max_by(F.struct(*others), "heartbeat_ms").alias("last"))
    return last.select("node_id", *(F.col(f"last.{c}").alias(c) for c in others))


def merged_timeline(events: DataFrame) -> DataFrame:
    """Each event once, the copy with the earliest clock (then the smallest node): combined before the shuffle."""
    others = [c for c in events.columns if c != "event_id"]
    first = events.groupBy("event_id").agg(F.min_by(F.struct(*others), F.struct(*CLOCK, "source_node")).alias("first"))
    return first.select("event_id", *(F.col(f"first.{c}").alias(c) for c in others))


def partial_status(events: DataFrame, asked: DataFrame) -> DataFrame:
    """How many of the asked nodes (source_node) answered with rows, and the freshest generation."""
    found = events.groupBy("source_node").agg(F.max("generation").alias("freshest"))
    return asked.join(found, "source_node", "left").agg(
        F.count("*").alias("nodes_queried"), F.count("freshest").alias("nodes_responded"), F.max("freshest").alias("freshest_generation")
    ).withColumn("is_partial", F.col("nodes_responded") < F.col("nodes_queried"))


def slot(key: Column, start: int = 0xFFFF) -> Column:
    """CRC-16 (polynomial 0x1021, most significant bit first) of a key's bytes, below 16384."""
    raw = F.hex(F.encode(key, "UTF-8"))
    values = F.transform(F.sequence(F.lit(0), F.greatest((F.length(raw) / 2).cast("int") - 1, F.lit(0))), lambda i: F.conv(F.substring(raw, i * 2 + 1, 2), 16, 10).cast("int"))

    def byte(crc: Column, b: Column) -> Column:
        bits = F.sequence(F.lit(1), F.lit(8))
        first = crc.bitwiseXOR(F.shiftleft(b, 8))

        def bit(c: Column, _: Column) -> Column:
            moved = F.shiftleft(c, 1).bitwiseAND(F.lit(0xFFFF))
            return F.when(c.bitwiseAND(F.lit(0x8000)) != 0, moved.bitwiseXOR(F.lit(0x1021))).otherwise(moved)

        return F.aggregate(bits, first, bit)

    crc = F.when(F.length(raw) > 0, F.aggregate(values, F.lit(start), byte)).otherwise(F.lit(start))
    return crc.bitwiseAND(F.lit(SLOTS - 1))


def slot_node(slot: Column, nodes: int) -> Column:
    return F.floor(slot * nodes / SLOTS)


def slot_node_even(slot: Column, nodes: int) -> Column:
    """The other rule for nodes: equal runs of slots, the rest to the last node."""
    return F.least(F.floor(slot / (SLOTS // nodes)), F.lit(nodes - 1))


def fan_out(tables: dict[int, DataFrame]) -> DataFrame:
    """The rows of all nodes with their source_node."""
    return reduce(DataFrame.unionByName, [t.withColumn("source_node", F.lit(n)) for n, t in tables.items()])


def capped(column: Column, n: int) -> Column:
    return F.slice(F.array_sort(column), 1, n)


def context_packs(resources: DataFrame, events: DataFrame, anomalies: DataFrame, incidents: DataFrame, neighbors: DataFrame) -> DataFrame:
    """One row for each permitted resource with arrays of its newest events, anomalies, incidents, neighbours and citations.

    Each table has resource_id and item (a struct that sorts newest or best first) and is cut to its
    number by a ranking window before it is gathered, so arrays are bounded.
    """
    from pyspark.sql import Window

    def gathered(table: DataFrame, n: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("resource_id").orderBy("item"))
        return table.withColumn("place", place).where(F.col("place") <= n).groupBy("resource_id").agg(F.array_sort(F.collect_list("item")).alias(name))

    out = resources
    sizes = {"events": (events, PACK_EVENTS), "anomalies": (anomalies, PACK_ANOMALIES), "incidents": (incidents, PACK_INCIDENTS), "neighbors": (neighbors, PACK_NEIGHBORS)}
    for name, (table, n) in sizes.items():
        out = out.join(gathered(table, n, name), "resource_id", "left")
    cited = [F.transform(F.coalesce(name, F.array()), lambda i, name=name: F.struct(F.lit(name).alias("kind"), i["id"].cast("string").alias("id"))) for name in sizes]
    return out.withColumn("citations", F.slice(F.concat(*cited), 1, PACK_CITATIONS))


def model_status(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """requests (model_id, task_bit, weights_sha256) with status: 0, -4 unknown, -2 task unsupported, -3 other weights; the first manifest of an id counts."""
    first = manifests.groupBy("model_id").agg(F.min_by(F.struct("supported_tasks", F.col("weights_sha256").alias("known_sha256")), "seq").alias("m"))
    joined = requests.join(first, "model_id", "left")
    status = (
        F.when(F.col("m").isNull(), -4)
        .when(F.col("m.supported_tasks").bitwiseAND(F.col("task_bit")) == 0, -2)
        .when(F.col("m.known_sha256") != F.col("weights_sha256"), -3)
        .otherwise(0)
    )
    return joined.withColumn("status", status).drop("m")
