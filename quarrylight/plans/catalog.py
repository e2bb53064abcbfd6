"""The operators' queries over the driver's tables by name, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import model
from quarrylight.operators import classify, federation, identity, keys, planner, telemetry, text, timeline, topology, vectors, workflow
from quarrylight.security import Caller, allowed, glob, holds, valid_scope_id
from quarrylight.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOW_MS, HIGH_MS, HOUR = 1_704_070_800_000, 1_704_675_600_000, 3_600_000
CALLER = Caller(clearance=2, tenant=1, sci=5)
MAY = "classification <= 2 AND (tenant_id = 0 OR tenant_id = 1) AND (flags & 32) = 0 AND (sci & -6) = 0"

REC = """rec AS (SELECT user_id AS object_id, event_id, user_id % 3 AS node_id, event_id AS generation,
 CAST(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS epoch, epoch_us(ts) // 1000 AS physical_ms, event_id AS logical,
 user_id % 4 AS tenant_id, event_id % 5 AS classification, event_id % 8 AS sci,
 CAST(4 + CASE WHEN event_type = 'error' THEN 32 ELSE 0 END + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS flags,
 event_type, value, event_id AS arrival FROM events)"""
LATEST = f"""WITH {REC}, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY epoch DESC, generation DESC, arrival DESC) AS rn FROM rec) WHERE rn = 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.records(table(spark, sf_dir, "events"))


# ---- flagship, identity


@query(
    f"""{LATEST}, recent AS (SELECT object_id, CAST(count(*) AS BIGINT) AS recent_events FROM rec WHERE physical_ms BETWEEN {LOW_MS} AND {HIGH_MS} GROUP BY 1)
 SELECT l.object_id, l.generation, l.epoch, l.physical_ms, coalesce(recent_events, 0) AS recent_events FROM latest l LEFT JOIN recent USING (object_id) WHERE (flags & 1) = 0 AND {MAY}"""
)
def latest_active_state(spark, sf_dir):
    """Current state of active objects that a caller may see, with their events in a window."""
    records = rec(spark, sf_dir)
    current = identity.latest(records).where(~model.has(F.col("flags"), model.TOMBSTONE) & allowed(CALLER))
    recent = timeline.in_range(records, LOW_MS, HIGH_MS).groupBy("object_id").agg(F.count("*").alias("recent_events"))
    return current.join(recent, "object_id", "left").select("object_id", "generation", "epoch", "physical_ms", F.coalesce("recent_events", F.lit(0)).alias("recent_events"))


@query(f"{LATEST} SELECT object_id, event_id, generation, epoch, physical_ms, flags FROM latest")
def exact_latest(spark, sf_dir):
    return identity.latest(rec(spark, sf_dir)).select("object_id", "event_id", "generation", "epoch", "physical_ms", "flags")


@query(f"{LATEST} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER ((flags & 1) = 0) AS BIGINT) AS active, CAST(count(*) FILTER ((flags & 1) = 1) AS BIGINT) AS tombstoned FROM latest")
def exact_counts(spark, sf_dir):
    return identity.counts(identity.latest(rec(spark, sf_dir)))


_STATUS = f"""WITH {REC}, again AS (SELECT * FROM rec UNION ALL SELECT * REPLACE (arrival + 1000000000 AS arrival) FROM rec WHERE event_id % 10 = 3),
 f AS (SELECT *, coalesce(max(epoch) OVER (PARTITION BY tenant_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fence FROM again),
 s AS (SELECT *, epoch < fence AS stale, row_number() OVER (PARTITION BY event_id, epoch < fence ORDER BY arrival) AS rn FROM f),
 t AS (SELECT *, CASE WHEN stale THEN 'STALE_FENCING_EPOCH' WHEN rn > 1 THEN 'DUPLICATE' WHEN (flags & 1) = 1 THEN 'TOMBSTONE_APPLIED' ELSE 'OK' END AS status FROM s)"""


def _resent(spark, sf_dir):
    records = rec(spark, sf_dir)
    return records.unionByName(records.where("event_id % 10 = 3").withColumn("arrival", F.col("arrival") + 1_000_000_000))


@query(f"{_STATUS} SELECT event_id, arrival, tenant_id, status FROM t")
def ingest_status(spark, sf_dir):
    """Statuses with a fence for each tenant."""
    return identity.ingest_status(_resent(spark, sf_dir), "tenant_id").select("event_id", "arrival", "tenant_id", "status")


@query(
    f"""{_STATUS} SELECT CAST(count(*) FILTER (status IN ('OK', 'TOMBSTONE_APPLIED')) AS BIGINT) AS ingested, CAST(count(*) FILTER (status = 'DUPLICATE') AS BIGINT) AS duplicates,
 CAST(count(*) FILTER (status = 'TOMBSTONE_APPLIED') AS BIGINT) AS tombstones, CAST(count(*) FILTER (status = 'STALE_FENCING_EPOCH') AS BIGINT) AS stale_epochs,
 max(epoch) FILTER (status IN ('OK', 'TOMBSTONE_APPLIED')) AS epoch, max(generation) FILTER (status IN ('OK', 'TOMBSTONE_APPLIED')) AS generation, max(physical_ms) FILTER (status IN ('OK', 'TOMBSTONE_APPLIED')) AS high_ms FROM t"""
)
def ingest_stats(spark, sf_dir):
    return identity.ingest_stats(identity.ingest_status(_resent(spark, sf_dir), "tenant_id"))


@query(f"WITH {REC}, again AS (SELECT event_id, arrival FROM rec UNION ALL SELECT event_id, arrival + 1000000000 FROM rec WHERE event_id % 10 = 3) SELECT event_id, min(arrival) AS arrival FROM again GROUP BY 1")
def dedup_first(spark, sf_dir):
    return identity.deduplicated(_resent(spark, sf_dir)).select("event_id", "arrival")


@query(f"WITH {REC}, a AS (SELECT event_id, arrival FROM rec UNION ALL SELECT event_id, arrival + 1000000000 FROM rec WHERE event_id % 10 = 3), l AS (SELECT *, lag(arrival) OVER (PARTITION BY event_id ORDER BY arrival) AS p FROM a) SELECT event_id, arrival FROM l WHERE p IS NULL OR arrival - p > 131072")
def dedup_window(spark, sf_dir):
    return identity.deduplicated(_resent(spark, sf_dir), 131_072).select("event_id", "arrival")


@query(f"WITH {REC} SELECT event_id, object_id FROM rec WHERE object_id NOT IN (SELECT object_id FROM rec WHERE (flags & 1) = 1)")
def tombstone_mask(spark, sf_dir):
    return identity.without_tombstoned(rec(spark, sf_dir)).select("event_id", "object_id")


@query(
    f"""{LATEST}, w AS (SELECT range AS object_id FROM range(0, 400, 3)) SELECT CAST(w.object_id AS BIGINT) AS object_id,
 CASE WHEN l.object_id IS NULL THEN 'NOT_FOUND' WHEN {MAY} THEN 'OK' ELSE 'DENIED' END AS status, CASE WHEN {MAY} THEN generation END AS generation FROM w LEFT JOIN latest l ON l.object_id = w.object_id"""
)
def secure_lookup(spark, sf_dir):
    wanted = spark.range(0, 400, 3).select(F.col("id").alias("object_id"))
    return identity.secure_lookup(identity.latest(rec(spark, sf_dir)), wanted, CALLER)


@query(
    f"""WITH {REC}, m AS (SELECT * FROM rec WHERE tenant_id = 1 AND (sci & -6) = 0), f AS (SELECT *, coalesce(max(epoch) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fence FROM m)
 SELECT event_id, CASE WHEN epoch < fence THEN 'STALE_FENCING_EPOCH' WHEN (flags & 1) = 1 THEN 'TOMBSTONE_APPLIED' ELSE 'OK' END AS status FROM f"""
)
def secure_ingest(spark, sf_dir):
    return identity.secure_ingest(rec(spark, sf_dir), CALLER, "tenant_id").select("event_id", "status")


_PARTS = f"""WITH {REC}, c AS (SELECT *, event_id % 5 AS position FROM rec UNION ALL SELECT * REPLACE (epoch + 1 AS epoch), 7 AS position FROM rec WHERE event_id % 10 = 0)"""


@query(f"{_PARTS} SELECT object_id, epoch, generation FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY epoch DESC, generation DESC, physical_ms DESC, logical DESC, node_id DESC, position) AS rn FROM c) WHERE rn = 1")
def conflict_merge(spark, sf_dir):
    """The best replica of each object over several nodes."""
    r = rec(spark, sf_dir)
    parts = r.withColumn("position", F.col("event_id") % 5).unionByName(r.where("event_id % 10 = 0").withColumn("epoch", F.col("epoch") + 1).withColumn("position", F.lit(7).cast("long")))
    return identity.merged(parts).select("object_id", "epoch", "generation")


@query(f"{LATEST} SELECT object_id, generation, CAST((SELECT count(*) FROM rec r WHERE r.object_id = l.object_id AND (r.event_id % 2 = 0 OR r.physical_ms > {HIGH_MS})) AS BIGINT) AS events FROM latest l")
def bootstrap_apply(spark, sf_dir):
    """Even events as snapshot, odd ones live; the timeline takes only live events after the watermark."""
    r = rec(spark, sf_dir)
    exact, events = identity.bootstrap(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), HIGH_MS)
    counted = events.groupBy("object_id").agg(F.count("*").alias("events"))
    return exact.join(counted, "object_id", "left").select("object_id", "generation", F.coalesce("events", F.lit(0)).alias("events"))


@query(
    f"""WITH {REC}, l AS (SELECT object_id, arrival, coalesce(epoch < lag(epoch) OVER w, false) AS epoch_fell,
 coalesce(lag(arrival) OVER w IS NOT NULL AND row(generation, physical_ms, logical) <= row(lag(generation) OVER w, lag(physical_ms) OVER w, lag(logical) OVER w), false) AS version_fell,
 coalesce((lag(flags) OVER w & 1) = 1 AND (flags & 1) = 0 AND (generation <= lag(generation) OVER w OR row(physical_ms, logical) <= row(lag(physical_ms) OVER w, lag(logical) OVER w)), false) AS resurrected FROM rec WINDOW w AS (PARTITION BY object_id ORDER BY arrival)) SELECT * FROM l WHERE epoch_fell OR version_fell OR resurrected"""
)
def feed_violations(spark, sf_dir):
    return identity.feed_violations(rec(spark, sf_dir))


@query(f"WITH {REC} SELECT event_id, greatest(0, {HIGH_MS} - physical_ms) AS staleness_ms FROM rec")
def clock_staleness(spark, sf_dir):
    r = rec(spark, sf_dir)
    return r.select("event_id", model.staleness_ms(F.lit(HIGH_MS), model.hlc(F.col("physical_ms"), F.col("logical"), F.col("node_id"))).alias("staleness_ms"))


# ---- timeline


@query(f"WITH {REC} SELECT event_id, physical_ms FROM rec WHERE physical_ms BETWEEN {LOW_MS} AND {HIGH_MS}")
def timeline_range(spark, sf_dir):
    return timeline.in_range(rec(spark, sf_dir), LOW_MS, HIGH_MS).select("event_id", "physical_ms")


@query(f"WITH {REC} SELECT event_id, physical_ms FROM rec ORDER BY physical_ms DESC, logical DESC, node_id DESC LIMIT 100")
def timeline_reverse(spark, sf_dir):
    return timeline.latest(rec(spark, sf_dir), 100).select("event_id", "physical_ms")


@query(f"WITH {REC} SELECT event_id, physical_ms FROM rec WHERE object_id = 7 AND physical_ms BETWEEN {LOW_MS} AND {HIGH_MS}")
def object_history(spark, sf_dir):
    return timeline.history(rec(spark, sf_dir), 7, LOW_MS, HIGH_MS).select("event_id", "physical_ms")


@query(f"WITH {REC} SELECT object_id, (arg_max(flags, row(physical_ms, logical, node_id)) & 1) = 1 AS is_deleted FROM rec WHERE physical_ms <= {HIGH_MS} GROUP BY 1")
def asof_deleted(spark, sf_dir):
    return timeline.deleted_as_of(rec(spark, sf_dir), HIGH_MS)


@query(f"WITH {REC}, d AS (SELECT object_id FROM rec WHERE physical_ms <= {HIGH_MS} GROUP BY 1 HAVING (arg_max(flags, row(physical_ms, logical, node_id)) & 1) = 1) SELECT event_id, object_id FROM rec WHERE physical_ms <= {HIGH_MS} AND object_id NOT IN (SELECT object_id FROM d)")
def object_history_active(spark, sf_dir):
    return timeline.active_history(rec(spark, sf_dir), HIGH_MS).select("event_id", "object_id")


@query(f"WITH {REC} SELECT min(physical_ms) AS min_ms, max(physical_ms) AS max_ms, arg_max(logical, row(physical_ms, logical, node_id)) AS max_logical, CAST(count(*) AS BIGINT) AS n FROM rec")
def timeline_bounds(spark, sf_dir):
    return timeline.bounds(rec(spark, sf_dir))


@query(
    f"""WITH {REC}, s AS (SELECT {LOW_MS} + range * {HOUR} AS b FROM range(0, {(HIGH_MS - LOW_MS) // HOUR})),
 c AS (SELECT (physical_ms - {LOW_MS}) // {HOUR} * {HOUR} + {LOW_MS} AS b, count(*) AS n, count(*) FILTER ((flags & 1) = 1) AS t, count(*) FILTER ((flags & 32) = 32) AS e FROM rec WHERE physical_ms >= {LOW_MS} AND physical_ms < {HIGH_MS} GROUP BY 1)
 SELECT CAST(s.b AS BIGINT) AS bucket_start_ms, CAST(s.b + {HOUR} AS BIGINT) AS bucket_end_ms, CAST(coalesce(n, 0) AS BIGINT) AS event_count, CAST(coalesce(t, 0) AS BIGINT) AS tombstone_count, CAST(coalesce(e, 0) AS BIGINT) AS error_count FROM s LEFT JOIN c USING (b)"""
)
def bucket_agg(spark, sf_dir):
    return timeline.buckets(rec(spark, sf_dir), LOW_MS, HIGH_MS, HOUR)


@query(f"WITH {REC} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ((flags & 1) = 1) AS BIGINT) AS tombstones FROM rec")
def timeline_counts(spark, sf_dir):
    return timeline.counts(rec(spark, sf_dir))


@query(f"WITH {REC} SELECT event_id, physical_ms FROM rec WHERE physical_ms BETWEEN {LOW_MS} AND {HIGH_MS} AND {MAY} ORDER BY physical_ms, logical, node_id LIMIT 256")
def secure_timeline(spark, sf_dir):
    return timeline.secure_range(rec(spark, sf_dir), LOW_MS, HIGH_MS, CALLER, 256).select("event_id", "physical_ms")


@query(
    f"""WITH {REC}, b AS (SELECT object_id, count(*) AS n, max(row(physical_ms, logical)) AS r FROM rec WHERE physical_ms BETWEEN {LOW_MS} AND {HIGH_MS} GROUP BY 1)
 SELECT CAST((SELECT sum(n) FROM b) AS BIGINT) AS total_events, object_id, CAST(n AS BIGINT) AS events FROM b ORDER BY n DESC, r, object_id LIMIT 1"""
)
def device_activity(spark, sf_dir):
    return timeline.most_active(rec(spark, sf_dir), LOW_MS, HIGH_MS)


# ---- predicates


@query(f"WITH {REC} SELECT event_id, classification FROM rec WHERE classification BETWEEN 2 AND 3 AND physical_ms BETWEEN {LOW_MS} AND {HIGH_MS}")
def severity_range(spark, sf_dir):
    return timeline.in_range(rec(spark, sf_dir), LOW_MS, HIGH_MS).where(F.col("classification").between(2, 3)).select("event_id", "classification")


@query(f"WITH {REC} SELECT event_id, node_id FROM rec WHERE node_id = 2 AND physical_ms BETWEEN {LOW_MS} AND {HIGH_MS}")
def device_range(spark, sf_dir):
    return timeline.in_range(rec(spark, sf_dir), LOW_MS, HIGH_MS).where("node_id = 2").select("event_id", "node_id")


@query(f"WITH {REC} SELECT event_id, event_type FROM rec WHERE event_type = 'error' AND physical_ms BETWEEN {LOW_MS} AND {HIGH_MS}")
def facility_range(spark, sf_dir):
    return timeline.in_range(rec(spark, sf_dir), LOW_MS, HIGH_MS).where("event_type = 'error'").select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id IN (5, 77, 123456789)")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_id").isin(5, 77, 123_456_789)).select("event_id", "user_id")


@query("SELECT event_id, event_id IN (100, 200) AS is_exact FROM events WHERE event_id BETWEEN 100 AND 200")
def range_with_exact_ends(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_id").between(100, 200)).select("event_id", F.col("event_id").isin(100, 200).alias("is_exact"))


@query(f"WITH {REC} SELECT event_id FROM rec WHERE (sci & -6) = 0")
def compartment_test(spark, sf_dir):
    return rec(spark, sf_dir).where(holds(F.col("sci"), 5)).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '.*r.*i.g.*')")
def glob_match(spark, sf_dir):
    return table(spark, sf_dir, "part").where(glob(F.col("p_name"), "*r*i?g*")).select("p_partkey", "p_name")


@query("SELECT s_suppkey, regexp_matches(s_name, '^[A-Za-z0-9._-]{1,63}$') AS is_valid FROM supplier")
def scope_validation(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", valid_scope_id(F.col("s_name")).alias("is_valid"))


# ---- key search

_ORD = "k AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1), o AS (SELECT key, n, coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM k)"


@query(f"WITH {_ORD} SELECT o_orderkey, CAST(ordinal AS BIGINT) AS ordinal FROM orders LEFT JOIN o ON o.key = o_orderkey")
def key_batch_search(spark, sf_dir):
    return keys.batch_search(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "ordinal")


@query(f"WITH {_ORD} SELECT CAST(ordinal AS BIGINT) AS ordinal FROM o WHERE key = 500")
def key_point_search(spark, sf_dir):
    return keys.point_search(table(spark, sf_dir, "lineitem"), "l_orderkey", 500)


@query(f"WITH {_ORD} SELECT key, CAST(ordinal AS BIGINT) AS ordinal FROM o WHERE key IN (3, 7, 400, 999, -5)")
def key_multi_search(spark, sf_dir):
    return keys.multi_search(table(spark, sf_dir, "lineitem"), "l_orderkey", [3, 7, 400, 999, -5])


@query("SELECT CAST(count(*) FILTER (l_orderkey < 500) AS BIGINT) AS ordinal FROM lineitem")
def key_lower_bound(spark, sf_dir):
    return keys.lower_bound(table(spark, sf_dir, "lineitem"), "l_orderkey", 500)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200")
def key_range_search(spark, sf_dir):
    return keys.range_search(table(spark, sf_dir, "lineitem"), "l_orderkey", 100, 200).select("l_orderkey", "l_linenumber")


@query(
    """WITH p AS (SELECT o_custkey AS key, lead(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey AS gap FROM orders), f AS (SELECT CAST(count(*) AS BIGINT) AS n, coalesce(min(gap), 0) >= 0 AS is_sorted, coalesce(min(gap) = max(gap), false) AS is_strided,
 CAST(floor(avg(abs(gap))) AS BIGINT) AS average_gap, CAST(floor(100 * avg(CASE WHEN key >= 10 AND key <= 100 THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS percent_within FROM p)
 SELECT *, CASE WHEN is_strided THEN 'STRIDED' WHEN is_sorted AND average_gap <= 4 THEN 'DENSE_SORTED' WHEN is_sorted THEN 'SPARSE_SORTED' ELSE 'RANDOM' END AS shape FROM f"""
)
def key_profile(spark, sf_dir):
    return keys.query_profile(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", F.lit(10), F.lit(100))


@query("WITH s AS (SELECT l_orderkey AS key, row_number() OVER (ORDER BY l_orderkey) - 1 AS place FROM lineitem), n AS (SELECT count(*) AS n FROM lineitem) SELECT DISTINCT key FROM s, n WHERE place IN (SELECT range * n // 64 FROM range(0, 64))")
def key_anchors(spark, sf_dir):
    return keys.anchors(table(spark, sf_dir, "lineitem"), "l_orderkey", 64)


@query("SELECT s_suppkey, p_partkey AS offset FROM (SELECT s_suppkey, 'Brand#' || CAST(11 + s_suppkey % 5 AS VARCHAR) AS q FROM supplier) JOIN part ON p_brand = q")
def string_lookup_all(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 11).cast("string")).alias("q"))
    return keys.lookup_all(table(spark, sf_dir, "part"), "p_brand", "p_partkey", wanted, "q").select("s_suppkey", "offset")


@query("SELECT s_suppkey, m AS offset FROM (SELECT s_suppkey, 'Brand#' || CAST(11 + s_suppkey % 5 AS VARCHAR) AS q FROM supplier) LEFT JOIN (SELECT p_brand, min(p_partkey) AS m FROM part GROUP BY 1) ON p_brand = q")
def string_lookup_first(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 11).cast("string")).alias("q"))
    return keys.lookup_first(table(spark, sf_dir, "part"), "p_brand", "p_partkey", wanted, "q").select("s_suppkey", "offset")


@query("WITH m AS (SELECT o_custkey AS k, min(row(CAST(o_orderkey % 4 AS BIGINT), o_orderstatus)) AS hit FROM orders GROUP BY 1) SELECT c_custkey, hit[1] AS member_order, hit[2] AS member FROM customer LEFT JOIN m ON k = c_custkey")
def first_member(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("place"), "o_orderstatus", "o_custkey")
    return keys.first_member(members, "place", "o_orderstatus", "o_custkey", table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


# ---- telemetry

_SAMPLES = "s AS (SELECT user_id % 10 AS node_id, event_type AS metric, epoch_us(ts) // 1000 AS physical_ms, value, event_id AS arrival FROM events)"
_BASE = f"""WITH {_SAMPLES}, w AS (SELECT *, count(value) OVER b AS n, sum(value) OVER b AS sv, sum(value * value) OVER b AS sq FROM s WINDOW b AS (PARTITION BY node_id, metric ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT *, CASE WHEN n >= 5 THEN sv / n END AS mean, CASE WHEN n >= 5 THEN greatest((sq - sv * sv / n) / (n - 1), 0) END AS var FROM w),
 d AS (SELECT *, CASE WHEN n >= 5 THEN CASE WHEN var <= 1e-6 AND abs(value - mean) > 1e-6 THEN 0.001 ELSE sqrt(var) END END AS stddev FROM v),
 z AS (SELECT node_id, metric, arrival, value, n, mean, stddev, CASE WHEN stddev > 0 THEN (value - mean) / stddev WHEN n >= 5 THEN 0.0 END AS z FROM d)"""


@query(f"{_BASE} SELECT node_id, metric, arrival, CAST(n AS BIGINT) AS n, round(z, 5) AS z FROM z")
def telemetry_zscore(spark, sf_dir):
    return telemetry.baselines(telemetry.samples(table(spark, sf_dir, "events"))).select("node_id", "metric", "arrival", "n", F.round("z", 5).alias("z"))


THRESHOLDS = [("view", 300.0, 400.0, 2.5, False), ("click", 0.0, 0.0, 2.0, False), ("purchase", 400.0, 480.0, 3.0, False), ("error", 200.0, 450.0, 3.0, True), ("signup", 0.0, 490.0, 3.0, False)]
_LIMITS = "l(metric, warning, critical, z_limit, is_fatal) AS (VALUES " + ", ".join(f"('{m}', {w}, {c}, {z}, {str(f).lower()})" for m, w, c, z, f in THRESHOLDS) + ")"
_ANOMALY = f"""{_BASE}, {_LIMITS}, a AS (SELECT z.*, CASE WHEN critical > 0 AND value >= critical THEN CASE WHEN is_fatal THEN 'FATAL' ELSE 'CRITICAL' END WHEN warning > 0 AND value >= warning THEN 'WARNING'
 WHEN z_limit > 0 AND abs(z) >= 1.5 * z_limit THEN 'CRITICAL' WHEN z_limit > 0 AND abs(z) >= z_limit THEN 'WARNING' END AS severity, warning, critical, z_limit FROM z JOIN l USING (metric))"""


def _anomalies(spark, sf_dir):
    limits = spark.createDataFrame(THRESHOLDS, "metric string, warning double, critical double, z_limit double, is_fatal boolean")
    return telemetry.classified(telemetry.baselines(telemetry.samples(table(spark, sf_dir, "events"))), limits)


@query(f"{_ANOMALY} SELECT arrival, metric, severity FROM a WHERE severity IS NOT NULL")
def anomaly_classify(spark, sf_dir):
    return _anomalies(spark, sf_dir).select("arrival", "metric", "severity")


@query(f"{_ANOMALY} SELECT arrival, severity FROM a WHERE severity IN ('CRITICAL', 'FATAL') ORDER BY arrival DESC LIMIT 20")
def anomaly_newest(spark, sf_dir):
    return telemetry.newest(_anomalies(spark, sf_dir), 20, ["CRITICAL", "FATAL"]).select("arrival", "severity")


@query(f"{_ANOMALY} SELECT arrival, round(least(1.0, abs(coalesce(z, 0.0)) / 10), 5) AS score, CAST(3 AS BIGINT) AS constraints, CAST((CASE WHEN warning > 0 AND value >= warning THEN 0 ELSE 1 END) + (CASE WHEN critical > 0 AND value >= critical THEN 0 ELSE 1 END) + (CASE WHEN z IS NULL OR (z_limit > 0 AND abs(z) >= z_limit) THEN 0 ELSE 1 END) AS BIGINT) AS satisfied FROM a WHERE severity IS NOT NULL")
def anomaly_explain(spark, sf_dir):
    rows = telemetry.explained(_anomalies(spark, sf_dir))
    return rows.select("arrival", F.round("score", 5).alias("score"), F.size("constraints").cast("long").alias("constraints"), F.size(F.filter("constraints", lambda c: c["satisfied"])).cast("long").alias("satisfied"))


_WINDOW = 24 * HOUR
_FEATURES = f"""WITH {_SAMPLES}, e AS (SELECT node_id, metric, max(physical_ms) AS end_ms FROM s GROUP BY 1, 2), i AS (SELECT s.* FROM s JOIN e USING (node_id, metric) WHERE physical_ms >= end_ms - {_WINDOW}),
 g AS (SELECT node_id, metric, count(*) AS n, avg(value) AS mean, coalesce(var_samp(value), 0) AS variance, min(value) AS mn, max(value) AS mx, coalesce(regr_slope(value, physical_ms / 1000.0), 0) AS slope, sum(value) / {_WINDOW / 1000} AS error_rate FROM i GROUP BY 1, 2),
 b AS (SELECT node_id, metric, count(*) AS bursts FROM i JOIN g USING (node_id, metric) WHERE value > mean + 2 * sqrt(variance) GROUP BY 1, 2)"""


@query(f"{_FEATURES} SELECT node_id, metric, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(variance, 2) AS variance, mn AS min, mx AS max, round(error_rate, 6) AS error_rate, CAST(coalesce(bursts, 0) AS BIGINT) AS bursts FROM g LEFT JOIN b USING (node_id, metric)")
def window_features(spark, sf_dir):
    rows = telemetry.window_features(telemetry.samples(table(spark, sf_dir, "events")), _WINDOW)
    return rows.select("node_id", "metric", "n", F.round("mean", 6).alias("mean"), F.round("variance", 2).alias("variance"), "min", "max", F.round("error_rate", 6).alias("error_rate"), "bursts")


@query(f"WITH {_SAMPLES}, o AS (SELECT node_id, metric, value, row_number() OVER p AS i, count(*) OVER (PARTITION BY node_id, metric) AS n FROM s WINDOW p AS (PARTITION BY node_id, metric ORDER BY arrival)) SELECT node_id, metric, round(sum(value * CASE WHEN i = 1 THEN pow(0.8, n - 1) ELSE 0.2 * pow(0.8, n - i) END), 5) AS ewma FROM o GROUP BY 1, 2")
def ewma(spark, sf_dir):
    return telemetry.ewma(telemetry.samples(table(spark, sf_dir, "events"))).select("node_id", "metric", F.round("ewma", 5).alias("ewma"))


# ---- topology, planner

_EDGES = """e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 1 AS edge_type, min(l_orderkey * 8 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 8, s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_nationkey FROM nation
 UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey - 1), 2, n_nationkey - 100 FROM nation WHERE n_nationkey > 0)"""


def _edges(spark, sf_dir):
    def of(name, src, dst, kind, seq):
        return table(spark, sf_dir, name).select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), seq.cast("long").alias("seq"))

    def n(prefix, column):
        return F.concat(F.lit(prefix), column.cast("string"))

    c = F.col
    nation = table(spark, sf_dir, "nation")
    chain = nation.where("n_nationkey > 0").select(n("n", c("n_nationkey")).alias("src"), n("n", c("n_nationkey") - 1).alias("dst"), F.lit(topology.DEPENDS_ON).alias("edge_type"), (c("n_nationkey") - 100).cast("long").alias("seq"))
    return topology.edges(
        of("lineitem", n("p", c("l_partkey")), n("s", c("l_suppkey")), topology.RUNS_ON, c("l_orderkey") * 8 + c("l_linenumber"))
        .unionByName(of("supplier", n("s", c("s_suppkey")), n("n", c("s_nationkey")), topology.MEMBER_OF, c("s_suppkey")))
        .unionByName(of("nation", n("n", c("n_nationkey")), n("r", c("n_regionkey")), topology.DEPENDS_ON, c("n_nationkey")))
        .unionByName(chain)
    )


_NODES = """nd AS (SELECT s_suppkey AS node_id, n_regionkey AS domain_id, CAST(s_suppkey % 8 AS BIGINT) AS isa_features, CAST(65536 AS BIGINT) AS ram_total_mb, CAST(4096 + (s_suppkey * 977) % 60000 AS BIGINT) AS ram_available_mb,
 CAST(4 + s_suppkey % 61 AS BIGINT) AS cpu_cores, CAST((s_suppkey * 37) % 100 AS DOUBLE) AS cpu_usage_pct, CAST(25 + (s_suppkey * 13) % 70 AS DOUBLE) AS temperature_c, CAST(1 + s_suppkey % 4 AS BIGINT) AS numa_nodes,
 CAST(s_suppkey % 5 AS BIGINT) AS classification, CAST(s_suppkey % 16 AS BIGINT) AS compartment_mask FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _nodes(spark, sf_dir):
    s = F.col("s_suppkey")
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        s.alias("node_id"),
        F.col("n_regionkey").alias("domain_id"),
        (s % 8).alias("isa_features"),
        F.lit(65536).cast("long").alias("ram_total_mb"),
        (4096 + (s * 977) % 60000).alias("ram_available_mb"),
        (4 + s % 61).alias("cpu_cores"),
        ((s * 37) % 100).cast("double").alias("cpu_usage_pct"),
        (25 + (s * 13) % 70).cast("double").alias("temperature_c"),
        (1 + s % 4).alias("numa_nodes"),
        (s % 5).alias("classification"),
        (s % 16).alias("compartment_mask"),
    )


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE src IN ('p5', 's3', 'n7') AND (edge_type & 11) <> 0")
def neighbors(spark, sf_dir):
    wanted = spark.createDataFrame([("p5",), ("s3",), ("n7",)], "src string")
    return topology.neighbors(_edges(spark, sf_dir), wanted, topology.RUNS_ON | topology.DEPENDS_ON | topology.MEMBER_OF).select("src", "dst")


@query(f"WITH {_NODES} SELECT a.node_id AS wanted, b.node_id AS member FROM nd a JOIN nd b USING (domain_id) WHERE a.node_id IN (1, 4)")
def failure_domain(spark, sf_dir):
    wanted = spark.createDataFrame([(1,), (4,)], "wanted long")
    none = _edges(spark, sf_dir).where(F.lit(False)).select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), "edge_type", "seq")
    return topology.failure_domain(_nodes(spark, sf_dir), none, wanted)


@query(f"WITH RECURSIVE {_EDGES}, f AS (SELECT src, arg_min(dst, seq) AS dst FROM e WHERE edge_type = 2 GROUP BY 1), c(start, hop, node) AS (SELECT 'n' || n_nationkey, 0, 'n' || n_nationkey FROM nation UNION ALL SELECT start, hop + 1, dst FROM c JOIN f ON f.src = node WHERE hop < 8) SELECT start, hop, node FROM c WHERE hop > 0")
def dependency_chain(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start"))
    return topology.dependency_chains(_edges(spark, sf_dir), starts, 8)


@query(f"WITH RECURSIVE {_EDGES}, c(start, hop, node) AS (SELECT 'n' || n_nationkey, 0, 'n' || n_nationkey FROM nation UNION ALL SELECT start, hop + 1, dst FROM c JOIN e ON src = node AND edge_type = 2 WHERE hop < 5) SELECT start, node, min(hop) AS hop FROM c WHERE hop > 0 GROUP BY 1, 2")
def dependency_closure(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start"))
    return topology.dependencies(_edges(spark, sf_dir), starts, 5)


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE edge_type = 1 AND dst IN ('s2', 's5')")
def affected_resources(spark, sf_dir):
    return topology.affected(_edges(spark, sf_dir), spark.createDataFrame([("s2",), ("s5",)], "dst string")).select("src", "dst")


@query(f"WITH {_EDGES} SELECT edge_type, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1")
def edge_counts(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("edge_type").agg(F.count("*").alias("n"))


PLACEMENT = planner.Placement(classification=2, compartments=1, isa=2, ram_mb=8192, cores=8, avoid_domain=0)
_FITS = "classification >= 2 AND (1 & ~compartment_mask) = 0 AND (2 & ~isa_features) = 0 AND ram_available_mb >= 8192 AND cpu_cores >= 8 AND domain_id <> 0"
_SCORE = "(0.35 * (ram_available_mb / ram_total_mb) + 0.25 * ((90.0 - least(greatest(temperature_c, 30.0), 90.0)) / 60.0) + 0.25 * ((100.0 - least(greatest(cpu_usage_pct, 0.0), 100.0)) / 100.0) + 0.15 * (CASE WHEN numa_nodes <= 1 THEN 1.0 WHEN numa_nodes = 2 THEN 0.85 ELSE 0.7 END))"


@query(f"WITH {_NODES} SELECT node_id, round(CAST({_SCORE} AS DOUBLE), 6) AS score FROM nd WHERE {_FITS} ORDER BY {_SCORE} DESC, node_id LIMIT 10")
def placement_plan(spark, sf_dir):
    return planner.plan(_nodes(spark, sf_dir), PLACEMENT, 10).select("node_id", F.round("score", 6).alias("score"))


@query(f"WITH {_NODES} SELECT node_id, CAST((classification >= 2)::INT + ((1 & ~compartment_mask) = 0)::INT + ((2 & ~isa_features) = 0)::INT + (ram_available_mb >= 8192)::INT + (cpu_cores >= 8)::INT + (domain_id <> 0)::INT AS BIGINT) AS satisfied FROM nd")
def placement_explain(spark, sf_dir):
    rows = planner.evaluated(_nodes(spark, sf_dir), PLACEMENT)
    return rows.select("node_id", F.size(F.filter("constraints", lambda c: c["satisfied"])).cast("long").alias("satisfied"))


@query(f"{LATEST}, {_NODES} SELECT node_id FROM nd WHERE node_id IN (SELECT object_id FROM latest WHERE (flags & 1) = 0) AND node_id IN (SELECT object_id FROM rec WHERE physical_ms BETWEEN {LOW_MS} AND {HIGH_MS})")
def placement_filters(spark, sf_dir):
    r = rec(spark, sf_dir)
    active = identity.latest(r).where(~model.has(F.col("flags"), model.TOMBSTONE)).select(F.col("object_id").alias("node_id"))
    recent = timeline.in_range(r, LOW_MS, HIGH_MS).select(F.col("object_id").alias("node_id"))
    return planner.filtered(_nodes(spark, sf_dir), active, recent).select("node_id")


# ---- vectors

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT vec_id, label, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM v)"
_Q = "q AS (SELECT vec_id AS query_id, x AS y FROM u WHERE vec_id % 20 = 0)"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"WITH {_V}, {_Q}, d AS (SELECT query_id, vec_id, 1 - list_dot_product(x, y) AS distance FROM u, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, round(distance, 4) AS distance FROM r WHERE rank <= 5")
def knn_exact(spark, sf_dir):
    """Queries: every vector whose id is divisible by 20, against all vectors."""
    rows = vectors.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5)
    return rows.select("query_id", "vec_id", (F.round("distance", 4) + F.lit(0.0)).alias("distance"))


@query()
def lsh_nearest(spark, sf_dir):
    planes = vectors.hyperplanes(64, tables=24, bits=8)
    return vectors.lsh_nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5, planes, probes=8).select("query_id", "vec_id", "distance", "rank")


_ONE = "o AS (SELECT x AS y FROM u WHERE vec_id = 3)"


def _vector(spark, sf_dir, i=3):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == i).first()["embedding"]


@query(f"WITH {_V}, {_ONE} SELECT vec_id, round(list_dot_product(x, y), 5) AS score FROM u, o WHERE list_dot_product(x, y) >= 0.2 ORDER BY list_dot_product(x, y) DESC, vec_id LIMIT 10")
def incident_topk(spark, sf_dir):
    rows = vectors.scoped(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, F.lit(True), 1, 1)
    return rows.where("score >= 0.2").select("vec_id", F.round("score", 5).alias("score"))


@query(f"WITH {_V}, {_ONE} SELECT vec_id AS recommended_target_id, round(list_dot_product(x, y), 5) AS confidence, CAST(7 AS BIGINT) AS based_on_generation FROM u, o ORDER BY list_dot_product(x, y) DESC, vec_id LIMIT 6")
def incident_recommendations(spark, sf_dir):
    matches = vectors.scoped(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 6, F.lit(True), 1, 1)
    rows = vectors.recommendations(matches.select("vec_id", "score"), 7, F.lit(None).cast("struct<physical_ms:bigint,logical:bigint,node_id:bigint>"), 5)
    return rows.select("recommended_target_id", F.round("confidence", 5).alias("confidence"), "based_on_generation")


@query(f"WITH {_V}, {_ONE} SELECT vec_id, round(list_dot_product(x, y), 5) AS score FROM u, o WHERE vec_id % 4 = 1 AND (vec_id % 8 & -6) = 0 AND label <> 2 ORDER BY list_dot_product(x, y) DESC, vec_id LIMIT 8")
def scoped_knn(spark, sf_dir):
    mine = (F.col("vec_id") % 4 == 1) & holds(F.col("vec_id") % 8, 5) & (F.col("label") != 2)
    return vectors.scoped(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 8, mine, 9, 9).select("vec_id", F.round("score", 5).alias("score"))


@query(f"WITH {_V}, {_ONE}, n AS (SELECT vec_id, list_dot_product(x, y) AS score FROM u, o), a AS (SELECT vec_id, score FROM n UNION ALL SELECT vec_id, score - 0.1 FROM n WHERE vec_id % 10 = 0) SELECT vec_id, round(max(score), 5) AS score FROM a GROUP BY 1 ORDER BY max(score) DESC, vec_id LIMIT 10")
def federated_topk(spark, sf_dir):
    q = vectors.normalised(F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)]))
    scored = table(spark, sf_dir, "embeddings").select("vec_id", vectors.dot(vectors.normalised(F.col("embedding")), q).alias("score"))
    both = scored.unionByName(scored.where("vec_id % 10 = 0").withColumn("score", F.col("score") - 0.1))
    return vectors.merged_top(both, "vec_id", 10).select("vec_id", F.round("score", 5).alias("score"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), o AS (SELECT x AS y FROM v WHERE vec_id = 3) SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 5) AS l2, round(0 - list_dot_product(x, y), 5) AS negated_dot FROM v, o")
def distance_kernels(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.distance("l2", e, q), 5).alias("l2"), F.round(vectors.distance("dot", e, q), 5).alias("negated_dot"))


@query()
def telemetry_embedding(spark, sf_dir):
    features = telemetry.window_features(telemetry.samples(table(spark, sf_dir, "events")), _WINDOW)
    return vectors.telemetry_embedding(features, [m for m, *_ in THRESHOLDS], F.lit(3))


# ---- text

_GRAMS = "b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, length(h) // 2 - 2), lambda i: substr(h, CAST(2 * i + 1 AS BIGINT), 6))) AS gram FROM b)"


@query(f"WITH {_GRAMS} SELECT doc_id, gram FROM g")
def trigram_postings(spark, sf_dir):
    return text.postings(table(spark, sf_dir, "documents")).select("doc_id", text.gram_hex(F.col("gram")).alias("gram"))


@query(f"WITH {_GRAMS} SELECT gram, CAST(count(*) AS BIGINT) AS documents FROM g GROUP BY 1")
def gram_frequency(spark, sf_dir):
    return text.frequencies(text.postings(table(spark, sf_dir, "documents"))).select(text.gram_hex(F.col("gram")).alias("gram"), "documents")


@query(f"WITH {_GRAMS}, f AS (SELECT count(*) AS n FROM g GROUP BY gram) SELECT CAST(count(*) AS BIGINT) AS unique_grams, CAST(sum(n) AS BIGINT) AS postings, CAST(max(n) AS BIGINT) AS longest FROM f")
def index_stats(spark, sf_dir):
    return text.index_stats(text.postings(table(spark, sf_dir, "documents")))


PATTERN = "example.com"


@query(f"WITH {_GRAMS} SELECT doc_id FROM g WHERE gram IN ({', '.join(repr(x) for x in text.pattern_grams(PATTERN))}) GROUP BY 1 HAVING count(*) = {len(text.pattern_grams(PATTERN))}")
def trigram_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return text.candidates(text.postings(docs), docs, PATTERN)


@query(f"SELECT doc_id FROM documents WHERE contains(text, '{PATTERN}')")
def substring_search(spark, sf_dir):
    return text.search(table(spark, sf_dir, "documents"), PATTERN).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(text, '{PATTERN}')")
def indexed_substring_search(spark, sf_dir):
    """The same through postings."""
    docs = table(spark, sf_dir, "documents")
    return text.search(docs, PATTERN, posted=text.postings(docs)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the and')")
def substring_search_folded(spark, sf_dir):
    return text.search(table(spark, sf_dir, "documents"), "THE and", ignore_case=True).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(text, '{PATTERN}') AND doc_id > 100 ORDER BY doc_id LIMIT 10")
def search_page(spark, sf_dir):
    return text.page(text.search(table(spark, sf_dir, "documents"), PATTERN).select("doc_id"), 100, 10)


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, rtrim(line, chr(13)) AS line FROM l WHERE contains(line, '{PATTERN}')")
def grep_lines(spark, sf_dir):
    return text.grep(table(spark, sf_dir, "documents"), PATTERN)


@query(f"WITH {_LINES} SELECT doc_id, CAST(count(*) AS BIGINT) AS matches FROM l WHERE contains(line, '{PATTERN}') GROUP BY 1")
def grep_counts(spark, sf_dir):
    return text.grep_counts(table(spark, sf_dir, "documents"), PATTERN)


@query("WITH f AS (SELECT page_id, regexp_extract_all(url || ' ' || html, '(?i)(http[A-Za-z0-9./:_?-]*)', 1) AS u FROM pages), e AS (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) - 1 AS place FROM f) SELECT page_id, CAST(place AS BIGINT) AS place, lower(url) AS url FROM e WHERE length(url) BETWEEN 9 AND 254")
def url_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("both"))
    return text.urls(pages, "both", "page_id")


_MAILS = "m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9._+-]+')) AS v FROM documents)"


@query(f"WITH {_MAILS} SELECT doc_id, lower(v) AS value, CAST(count(*) AS BIGINT) AS n FROM m WHERE contains(split_part(v, '@', 2), '.') AND length(v) BETWEEN 6 AND 254 GROUP BY 1, 2")
def mail_extract(spark, sf_dir):
    """Addresses among the artifacts of all texts, how often each stands there."""
    found = text.artifacts(table(spark, sf_dir, "documents")).where("kind = 'email'")
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("SELECT doc_id, octet_length(encode(substr(text, 1, 40))) >= 30 AS is_inside, CASE WHEN octet_length(encode(text)) > 10 THEN translate(regexp_replace(substr(text, 11, 5), '[^\\x20-\\x7e]', ' ', 'g'), '', '') END AS artifact FROM documents WHERE regexp_full_match(substr(text, 1, 40), '[\\x00-\\x7f]*')")
def model_context(spark, sf_dir):
    """What a model is shown of five bytes at place 10, for texts that begin in ASCII."""
    raw = F.encode("text", "UTF-8")
    rows = table(spark, sf_dir, "documents").where(F.substring("text", 1, 40).rlike("^[\\x00-\\x7f]*$"))
    return rows.select("doc_id", (F.octet_length(F.encode(F.substring("text", 1, 40), "UTF-8")) >= 30).alias("is_inside"), text.model_context(raw, F.lit(10), F.lit(5))["artifact"].alias("artifact"))


@query("WITH i AS (SELECT c_custkey, unnest(regexp_extract_all(c_name || ' ' || c_custkey || ',-' || c_nationkey || ' 12345678901234567890', '([+-]?[0-9]+)', 1)) AS x FROM customer) SELECT c_custkey, CAST(x AS BIGINT) AS key FROM i WHERE length(regexp_replace(x, '^[+-]', '')) <= 19")
def text_integers(spark, sf_dir):
    """The integers of a text member."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit(",-"), F.col("c_nationkey").cast("string"), F.lit(" 12345678901234567890")).alias("t"))
    return rows.select("c_custkey", F.explode(files.integers(F.col("t"))).alias("key"))


@query("SELECT doc_id, regexp_replace(array_slice(string_split(substr(text, greatest(50 - 20, 1), 50 - greatest(50 - 20, 1)), chr(10)), -1, -1)[1] || string_split(substr(text, 50, 40), chr(10))[1], '[^\\x20-\\x7e]', ' ', 'g') AS context FROM documents")
def clean_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.context(F.col("text"), F.lit(50), 20, 40).alias("context"))


@query("SELECT p_partkey, p_partkey < 100 AS is_stale FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 5 <= 2 AND (p_partkey % 8 & -6) = 0 AND contains(lower(p_name || ' ' || p_type), 'e') AND p_partkey % 10 <> 9")
def authorised_search(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (k % 4).alias("tenant_id"), (k % 5).alias("classification"), (k % 8).alias("sci"), k.alias("generation"), (k % 10 == 9).alias("tombstone"), text.searchable(F.col("p_name"), F.col("p_type")).alias("searchable_text")
    )
    return text.authorised(rows, "E", allowed(Caller(2, 1, 5), shared_tenant=False), 100).select("p_partkey", "is_stale")


@query("SELECT doc_id, sha256(text) = sha256(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS is_verified FROM documents")
def payload_verify(spark, sf_dir):
    t = F.col("text")
    expected = F.sha2(F.concat(t, F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")), 384)
    return table(spark, sf_dir, "documents").select("doc_id", (F.sha2(t, 384) == expected).alias("is_verified"))


@query()
def text_classify(spark, sf_dir):
    """Languages told by a model trained on a bounded sample of the same documents."""
    docs = table(spark, sf_dir, "documents")
    found = classify.classified(classify.train(docs, "text", "lang"), F.col("text"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.label", F.round("found.probability", 4).alias("probability"))


# ---- workflow

_WORK = "w AS (SELECT o_orderkey AS committed_seq, o_orderkey // 2 AS record_id, o_custkey % 50 AS owner_id, 1 + o_custkey % 3 AS workflow_type, o_custkey % 4 AS tenant_id, o_orderkey % 5 AS classification, o_orderkey % 8 AS sci, CAST(4 AS BIGINT) AS flags, epoch_ms(o_orderdate) AS due_at, o_orderkey % 20 = 0 AS tombstone FROM orders)"
_STATE = f"WITH {_WORK}, st AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY committed_seq DESC) AS rn FROM w) WHERE rn = 1 AND NOT tombstone)"


def _work(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("committed_seq"), F.floor(k / 2).alias("record_id"), (c % 50).alias("owner_id"), (1 + c % 3).alias("workflow_type"), (c % 4).alias("tenant_id"), (k % 5).alias("classification"),
        (k % 8).alias("sci"), F.lit(4).cast("long").alias("flags"), model.millis(F.col("o_orderdate")).alias("due_at"), (k % 20 == 0).alias("tombstone"),
    )


@query(f"{_STATE} SELECT record_id, committed_seq, owner_id, due_at FROM st")
def workflow_state(spark, sf_dir):
    return workflow.state(_work(spark, sf_dir)).select("record_id", "committed_seq", "owner_id", "due_at")


@query(f"{_STATE} SELECT record_id, due_at FROM st WHERE tenant_id = 1 AND workflow_type = 2 AND owner_id % 50 = 13 AND {MAY} ORDER BY due_at, record_id LIMIT 20")
def workflow_page(spark, sf_dir):
    return workflow.page(workflow.state(_work(spark, sf_dir)), 1, 2, 13, 20, allowed(CALLER)).select("record_id", "due_at")


@query(f"{_STATE} SELECT record_id, due_at FROM st WHERE tenant_id = 1 AND workflow_type = 2 AND owner_id = 13 AND {MAY} AND row(due_at, record_id) < row(873676800000, 100) ORDER BY due_at DESC, record_id DESC LIMIT 20")
def workflow_page_descending(spark, sf_dir):
    return workflow.page(workflow.state(_work(spark, sf_dir)), 1, 2, 13, 20, allowed(CALLER), after=(873_676_800_000, 100), descending=True).select("record_id", "due_at")


@query(f"WITH {_WORK} SELECT CAST(count(*) FILTER (committed_seq <= 100 OR committed_seq > 1000) AS BIGINT) AS outside, CAST(count(*) FILTER (record_id IS NULL) AS BIGINT) AS without_id, CAST(count(*) FILTER (workflow_type = 0) AS BIGINT) AS without_type, CAST(0 AS BIGINT) AS repeated FROM w")
def workflow_batch_faults(spark, sf_dir):
    return workflow.batch_faults(_work(spark, sf_dir), 100, 1000)


@query(f"WITH {_WORK}, l AS (SELECT record_id, row(owner_id, workflow_type, tenant_id) AS k, lag(row(owner_id, workflow_type, tenant_id)) OVER p AS b, lag(tombstone) OVER p AS t FROM w WINDOW p AS (PARTITION BY record_id ORDER BY committed_seq)) SELECT DISTINCT record_id FROM l WHERE b IS NOT NULL AND NOT t AND k <> b")
def workflow_conflicts(spark, sf_dir):
    return workflow.conflicts(_work(spark, sf_dir))


@query(f"{_STATE}, a AS (SELECT * FROM st WHERE record_id % 3 <> 0) SELECT st.record_id FROM st JOIN a USING (record_id) WHERE st.tenant_id = 1 AND a.classification <= 2 AND (a.tenant_id = 0 OR a.tenant_id = 1) AND (a.sci & -6) = 0")
def workflow_verified(spark, sf_dir):
    rows = workflow.state(_work(spark, sf_dir))
    kept, _ = workflow.verified(rows.where("tenant_id = 1").select("record_id"), rows.where("record_id % 3 <> 0"), allowed(CALLER))
    return kept


# ---- federation


def _fan(spark, sf_dir):
    r = rec(spark, sf_dir)
    return r.withColumn("source_node", F.col("event_id") % 5).unionByName(r.where("event_id % 10 = 0").withColumn("physical_ms", F.col("physical_ms") - 1000).withColumn("source_node", (F.col("event_id") + 1) % 5))


_FAN = f"WITH {REC}, a AS (SELECT *, event_id % 5 AS source_node FROM rec UNION ALL SELECT * REPLACE (physical_ms - 1000 AS physical_ms), (event_id + 1) % 5 AS source_node FROM rec WHERE event_id % 10 = 0)"


@query(f"{_FAN} SELECT event_id, physical_ms, source_node FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY physical_ms, logical, node_id, source_node) AS rn FROM a) WHERE rn = 1")
def timeline_merge(spark, sf_dir):
    return federation.merged_timeline(_fan(spark, sf_dir)).select("event_id", "physical_ms", "source_node")


@query(f"{_FAN}, f AS (SELECT source_node, max(generation) AS g FROM a WHERE source_node <> 4 GROUP BY 1) SELECT CAST(5 AS BIGINT) AS nodes_queried, CAST(count(*) AS BIGINT) AS nodes_responded, max(g) AS freshest_generation, count(*) < 5 AS is_partial FROM f")
def partial_status(spark, sf_dir):
    asked = spark.range(5).select(F.col("id").alias("source_node"))
    return federation.partial_status(_fan(spark, sf_dir).where("source_node <> 4"), asked)


@query(f"{_FAN} SELECT event_id, min(physical_ms) AS physical_ms FROM a WHERE {MAY} AND physical_ms BETWEEN {LOW_MS} AND {HIGH_MS} GROUP BY 1")
def timeline_fanout(spark, sf_dir):
    """Each node's permitted rows of a range, merged."""
    rows = timeline.in_range(_fan(spark, sf_dir), LOW_MS, HIGH_MS).where(allowed(CALLER))
    return federation.merged_timeline(rows).select("event_id", "physical_ms")


@query(f"{_FAN} SELECT object_id, epoch, generation FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY epoch DESC, generation DESC, physical_ms DESC, source_node) AS rn FROM a WHERE {MAY}) WHERE rn = 1")
def exact_fanout(spark, sf_dir):
    rows = _fan(spark, sf_dir).where(allowed(CALLER)).withColumn("position", F.col("source_node"))
    return identity.merged(rows).select("object_id", "epoch", "generation")


def _crc(start: int) -> str:
    step = "CASE WHEN (r & 32768) <> 0 THEN xor((r << 1) & 65535, 4129) ELSE (r << 1) & 65535 END"
    return f"list_reduce(b, lambda c, x: list_reduce(range(0, 8), lambda r, i: {step}, xor(c, x << 8)), CAST({start} AS BIGINT)) & 16383"


@query(
    f"""WITH h AS (SELECT c_custkey, hex(encode(c_mktsegment)) AS h FROM customer), b AS (SELECT c_custkey, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM h),
 s AS (SELECT c_custkey, {_crc(65535)} AS slot, {_crc(0)} AS plain_slot FROM b) SELECT c_custkey, CAST(slot AS INTEGER) AS slot, slot * 5 // 16384 AS node, CAST(plain_slot AS INTEGER) AS plain_slot, least(plain_slot // 3276, 4) AS even_node FROM s"""
)
def slot_route(spark, sf_dir):
    """Slots and nodes by both rules."""
    s, plain = federation.slot(F.col("c_mktsegment")), federation.slot(F.col("c_mktsegment"), 0)
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("slot"), federation.slot_node(s, 5).alias("node"), plain.alias("plain_slot"), federation.slot_node_even(plain, 5).alias("even_node"))


@query(
    f"""{LATEST}, e AS (SELECT object_id, least(count(*), 32) AS n FROM rec WHERE {MAY} GROUP BY 1), c AS (SELECT object_id, least(count(*), 8) AS n FROM rec WHERE {MAY} AND value >= 250 GROUP BY 1)
 SELECT l.object_id AS resource_id, CAST(coalesce(e.n, 0) AS BIGINT) AS events, CAST(coalesce(c.n, 0) AS BIGINT) AS anomalies, CAST(least(64, coalesce(e.n, 0) + coalesce(c.n, 0)) AS BIGINT) AS citations FROM latest l LEFT JOIN e USING (object_id) LEFT JOIN c USING (object_id) WHERE {MAY}"""
)
def rag_pack_counts(spark, sf_dir):
    r = rec(spark, sf_dir)
    may = r.where(allowed(CALLER))
    item = F.struct((-F.col("physical_ms")).alias("order"), F.col("event_id").alias("id"))
    events = may.select(F.col("object_id").alias("resource_id"), item.alias("item"))
    odd = may.where("value >= 250").select(F.col("object_id").alias("resource_id"), item.alias("item"))
    none = events.where(F.lit(False))
    resources = identity.latest(r).where(allowed(CALLER)).select(F.col("object_id").alias("resource_id"))
    packs = federation.context_packs(resources, events, odd, none, none)
    sizes = [F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(c) for c in ("events", "anomalies", "citations")]
    return packs.select("resource_id", *sizes)


@query("WITH m AS (SELECT s_suppkey % 50 AS model_id, arg_min(s_suppkey % 8, s_suppkey) AS tasks, arg_min(s_name, s_suppkey) AS sha FROM supplier GROUP BY 1) SELECT c_custkey, CASE WHEN m.model_id IS NULL THEN -4 WHEN (tasks & 2) = 0 THEN -2 WHEN sha <> 'Supplier#00000000' || CAST(c_custkey % 10 AS VARCHAR) THEN -3 ELSE 0 END AS status FROM customer LEFT JOIN m ON m.model_id = c_custkey % 60")
def model_validate(spark, sf_dir):
    s = F.col("s_suppkey")
    manifests = table(spark, sf_dir, "supplier").select((s % 50).alias("model_id"), (s % 8).alias("supported_tasks"), F.col("s_name").alias("weights_sha256"), s.alias("seq"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60).alias("model_id"), F.lit(2).cast("long").alias("task_bit"), F.concat(F.lit("Supplier#00000000"), (F.col("c_custkey") % 10).cast("string")).alias("weights_sha256"))
    return federation.model_status(asked, manifests).select("c_custkey", "status")
