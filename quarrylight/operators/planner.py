"""Placement: hard constraints, weighted scores, explanations, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Placement:
    """What is asked for; weights of free memory, temperature, load, NUMA."""

    classification: int = 0
    compartments: int = 0
    isa: int = 0
    ram_mb: int = 1024
    cores: int = 1
    weights: tuple[float, float, float, float] = (0.35, 0.25, 0.25, 0.15)
    avoid_domain: int | None = None


def _one(name: str, satisfied: Column, text: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), satisfied.alias("satisfied"), text.alias("rationale"))


def constraints(q: Placement) -> list[Column]:
    c = F.col
    out = [
        _one("classification", c("classification") >= q.classification, F.format_string("node class %d", c("classification"))),
        _one("compartments", F.lit(q.compartments).bitwiseAND(F.bitwise_not(c("compartment_mask"))) == 0, F.format_string("node mask %d", c("compartment_mask"))),
        _one("isa", F.lit(q.isa).bitwiseAND(F.bitwise_not(c("isa_features"))) == 0, F.format_string("node features %d", c("isa_features"))),
        _one("ram", c("ram_available_mb") >= q.ram_mb, F.format_string("%d MB available", c("ram_available_mb"))),
        _one("cores", c("cpu_cores") >= q.cores, F.format_string("%d cores", c("cpu_cores"))),
    ]
    if q.avoid_domain is not None:
        out.append(_one("anti_affinity", c("domain_id") != q.avoid_domain, F.format_string("domain %d", c("domain_id"))))
    return out


def score(weights: tuple[float, float, float, float]) -> Column:
    """Weighted mean of free memory share, coolness between 30 and 90 degrees, idle share, NUMA."""
    c = F.col
    ram = F.when(c("ram_total_mb") == 0, 0.5).otherwise(c("ram_available_mb") / c("ram_total_mb"))
    cool = (90.0 - F.least(F.greatest(c("temperature_c"), F.lit(30.0)), F.lit(90.0))) / 60.0
    idle = (100.0 - F.least(F.greatest(c("cpu_usage_pct"), F.lit(0.0)), F.lit(100.0))) / 100.0
    numa = F.when(c("numa_nodes") <= 1, 1.0).when(c("numa_nodes") == 2, 0.85).otherwise(0.7)
    parts = zip(weights, (ram, cool, idle, numa))
    total = sum(weights)
    return sum((w * x for w, x in parts), F.lit(0.0)) / (total if total > 0 else 1.0)


def domain_of(resource: int, nodes: DataFrame, hosts: DataFrame) -> int | None:
    """The failure domain of a node, or of the first host (src, dst, seq) that a resource runs on; None if neither is known."""
    own = nodes.where(F.col("node_id") == resource).select(F.lit(-1).cast("long").alias("seq"), "domain_id")
    host = hosts.where(F.col("src") == resource).join(nodes, F.col("dst") == F.col("node_id")).select(F.col("seq").cast("long"), "domain_id")
    found = own.unionByName(host).agg(F.min_by("domain_id", "seq")).first()
    return found[0]


def evaluated(nodes: DataFrame, q: Placement) -> DataFrame:
    """All nodes with constraints, whether all hold, and a score (0 where not)."""
    rows = nodes.withColumn("constraints", F.array(*constraints(q)))
    ok = F.forall("constraints", lambda c: c["satisfied"])
    return rows.withColumn("satisfied", ok).withColumn("score", F.when(ok, score(q.weights)).otherwise(0.0))


def filtered(nodes: DataFrame, active: DataFrame | None = None, recent: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """Nodes that each given table (node_id) has: active identities, events in a window, matching documents."""
    for table in (active, recent, content):
        if table is not None:
            nodes = nodes.join(table.select("node_id"), "node_id", "left_semi")
    return nodes


def plan(nodes: DataFrame, q: Placement, k: int) -> DataFrame:
    """The k best nodes that satisfy everything; ties by node_id."""
    return evaluated(nodes, q).where("satisfied and score > 0").orderBy(F.desc("score"), "node_id").limit(k)
