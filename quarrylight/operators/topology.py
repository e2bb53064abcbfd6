"""Topology: typed edges between resources, neighbours, failure domains, dependency chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edge types, one bit each.
RUNS_ON, DEPENDS_ON, ATTACHED_TO, MEMBER_OF, CONNECTED_TO, REPLICATES_TO, OWNED_BY, SHARES_FAILURE_DOMAIN, MONITORS = (1 << i for i in range(9))


def edges(added: DataFrame) -> DataFrame:
    """Each (src, dst, type) once, with its first sequence number; a row without a type is no edge."""
    return added.where(F.col("edge_type") != 0).groupBy("src", "dst", "edge_type").agg(F.min("seq").alias("seq"))


def removed(active: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that `gone` names; type 0 there takes the first edge of any type."""
    typed = active.join(gone.where("edge_type <> 0").select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")
    first = typed.groupBy("src", "dst").agg(F.min("seq").alias("seq")).join(gone.where("edge_type = 0").select("src", "dst"), ["src", "dst"], "left_semi")
    return typed.join(first, ["src", "dst", "seq"], "left_anti")


def neighbors(active: DataFrame, sources: DataFrame, mask: int) -> DataFrame:
    """Outgoing edges of the sources (column src) whose type is in the mask."""
    return active.where(F.col("edge_type").bitwiseAND(F.lit(mask)) != 0).join(sources, "src", "left_semi")


def failure_domain(nodes: DataFrame, active: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, member: all nodes of a known node's domain, itself included; of an unknown one, what it shares a domain edge with."""
    known = wanted.join(nodes.select("node_id", "domain_id"), wanted["wanted"] == F.col("node_id")).select("wanted", "domain_id")
    peers = known.join(nodes.select(F.col("node_id").alias("member"), "domain_id"), "domain_id").select("wanted", "member")
    unknown = wanted.join(nodes.select("node_id"), wanted["wanted"] == F.col("node_id"), "left_anti")
    shared = active.where(F.col("edge_type") == SHARES_FAILURE_DOMAIN).select(F.col("src").alias("wanted"), F.col("dst").alias("member"))
    return peers.unionByName(shared.join(unknown, "wanted", "left_semi"))


def dependency_chains(active: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, hop, node: the first DEPENDS_ON edge of each node, followed `most` times at most (cycles repeat)."""
    first = active.where(F.col("edge_type") == DEPENDS_ON).groupBy("src").agg(F.min_by("dst", "seq").alias("dst"))
    # one chain of joins that carries the path, of at most `most` nodes
    at = starts.select("start", F.col("start").alias("node"), F.array().cast("array<string>").alias("path"))
    for _ in range(most):
        at = at.join(first, at["node"] == first["src"], "left").select("start", F.col("dst").alias("node"), F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("dst"))).alias("path"))
    return at.select("start", F.posexplode("path").alias("hop", "node")).select("start", (F.col("hop") + 1).alias("hop"), "node")


def dependencies(active: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, node, hop: everything that a start depends on, over all edges, with the fewest hops."""
    links = active.where(F.col("edge_type") == DEPENDS_ON).select("src", "dst").distinct()
    found = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).distinct()
    back = None
    for hop in range(1, most + 1):
        # only what the last hop reached for the first time goes on, so cycles come to an end
        at = found.where(F.col("hop") == hop - 1)
        ahead = at.join(links, at["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct()
        known = found.select(F.col("start").alias("s"), F.col("node").alias("n"))
        new = ahead.join(known, (F.col("start") == F.col("s")) & (F.col("node") == F.col("n")), "left_anti")
        again = ahead.where(F.col("start") == F.col("node")).withColumn("hop", F.lit(hop))  # the way back to a start
        back = again if back is None else back.unionByName(again)
        found = found.unionByName(new.withColumn("hop", F.lit(hop))).persist()
    return found.where("hop > 0").unionByName(back.groupBy("start", "node").agg(F.min("hop").alias("hop")))


def affected(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """What runs on the nodes (column dst), one hop."""
    return active.where(F.col("edge_type") == RUNS_ON).join(nodes, "dst", "left_semi")
