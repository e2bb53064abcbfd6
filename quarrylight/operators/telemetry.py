"""Telemetry: running baselines, anomalies, window features, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.ranges import earlier

MIN_SAMPLES = 5
ALPHA = 0.2
WINDOWS_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "24h": 86_400_000}


def samples(events: DataFrame) -> DataFrame:
    """The events table as samples: node, metric, time, value."""
    from quarrylight.model import millis

    return events.select((F.col("user_id") % 10).alias("node_id"), F.col("event_type").alias("metric"), millis(F.col("ts")).alias("physical_ms"), "value", F.col("event_id").alias("arrival"))


def baselines(samples: DataFrame) -> DataFrame:
    """Each sample with count, mean, deviation of all earlier ones of its node and metric, and its z-score (null before five)."""
    v = F.col("value")
    counted = earlier(samples, ["node_id", "metric"], "arrival", {"n": ("sum", v.isNotNull().cast("long")), "s": ("sum", v), "q": ("sum", v * v)})
    counted = counted.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    mean = F.col("s") / F.col("n")
    variance = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    enough = F.col("n") >= MIN_SAMPLES
    measured = counted.withColumn("mean", F.when(enough, mean)).withColumn("variance", F.when(enough, variance))
    flat = (F.col("variance") <= 1e-6) & (F.abs(v - F.col("mean")) > 1e-6)
    deviation = F.when(flat, F.lit(0.001)).otherwise(F.sqrt("variance"))
    return (
        measured.withColumn("stddev", F.when(enough, deviation))
        .withColumn("z", F.when(F.col("stddev") > 0, (v - F.col("mean")) / F.col("stddev")).otherwise(F.when(enough, F.lit(0.0))))
        .drop("s", "q", "variance")
    )


def classified(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Severity by the metric's thresholds (metric, warning, critical, z_limit, is_fatal; 0 or less: off), then by z-score.

    The thresholds are one row for each metric of a fixed list, so they are broadcast.
    """
    t = measured.join(F.broadcast(thresholds), "metric")
    v, z = F.col("value"), F.abs("z")
    severity = (
        F.when((F.col("critical") > 0) & (v >= F.col("critical")), F.when(F.col("is_fatal"), "FATAL").otherwise("CRITICAL"))
        .when((F.col("warning") > 0) & (v >= F.col("warning")), "WARNING")
        .when((F.col("z_limit") > 0) & (z >= 1.5 * F.col("z_limit")), "CRITICAL")
        .when((F.col("z_limit") > 0) & (z >= F.col("z_limit")), "WARNING")
    )
    rationale = (
        F.when((F.col("critical") > 0) & (v >= F.col("critical")), F.lit("value reaches the critical threshold"))
        .when((F.col("warning") > 0) & (v >= F.col("warning")), F.lit("value reaches the warning threshold"))
        .otherwise(F.lit("z-score reaches its limit"))
    )
    return t.withColumn("severity", severity).where("severity is not null").withColumn("rationale", rationale)


def anomaly_id(node: Column, metric: Column, ms: Column, arrival: Column) -> Column:
    """A UUID-shaped id that the sample decides."""
    h = F.sha2(F.concat_ws("|", node.cast("string"), metric, ms.cast("string"), arrival.cast("string")), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def explained(anomalies: DataFrame) -> DataFrame:
    """Each anomaly with a score and its constraints as rows of an array."""

    def one(name: str, satisfied: Column, text: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.coalesce(satisfied, F.lit(False)).alias("satisfied"), text.alias("rationale"))

    v = F.col("value")
    constraints = F.array(
        one("below_warning", ~((F.col("warning") > 0) & (v >= F.col("warning"))), F.format_string("value %.3f", v)),
        one("below_critical", ~((F.col("critical") > 0) & (v >= F.col("critical"))), F.format_string("value %.3f", v)),
        one("z_within_limit", ~((F.col("z_limit") > 0) & (F.abs("z") >= F.col("z_limit"))), F.format_string("z %.3f", F.coalesce("z", F.lit(0.0)))),
    )
    return anomalies.withColumn("score", F.least(F.lit(1.0), F.abs(F.coalesce("z", F.lit(0.0))) / 10)).withColumn("constraints", constraints)


def newest(anomalies: DataFrame, n: int, severities: list[str]) -> DataFrame:
    return anomalies.where(F.col("severity").isin(severities)).orderBy(F.desc("arrival")).limit(n)


def window_features(samples: DataFrame, window_ms: int, by: tuple[str, ...] = ("node_id", "metric")) -> DataFrame:
    """Statistics of the window that ends at each series' newest sample, both ends included.

    slope is per second; bursts are samples above mean + 2 deviations; error_rate is the sum per second.
    """
    keys = list(by)
    last = samples.groupBy(*keys).agg(F.max("physical_ms").alias("end_ms"))
    inside = samples.join(last, keys).where(F.col("physical_ms") >= F.col("end_ms") - window_ms)
    v, t = F.col("value"), F.col("physical_ms") / 1000.0
    figures = inside.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.regr_slope(v, t), F.lit(0.0)).alias("slope"),
        (F.sum(v) / (window_ms / 1000.0)).alias("error_rate"),
    )
    bursts = inside.join(figures.select(*keys, "mean", "variance"), keys).where(v > F.col("mean") + 2 * F.sqrt("variance")).groupBy(*keys).agg(F.count("*").alias("bursts"))
    return figures.join(bursts, keys, "left").withColumn("bursts", F.coalesce("bursts", F.lit(0))).withColumn("stddev", F.sqrt("variance"))


def ewma(samples: DataFrame, alpha: float = ALPHA, window_ms: int | None = None) -> DataFrame:
    """node_id, metric, ewma: the exponentially weighted mean in order of arrival, seeded by the first value.

    A value's weight follows from how many come after it, so that the rest is one sum for each series.
    """
    if window_ms is not None:
        last = samples.groupBy("node_id", "metric").agg(F.max("physical_ms").alias("end_ms"))
        samples = samples.join(last, ["node_id", "metric"]).where(F.col("physical_ms") >= F.col("end_ms") - window_ms)
    placed = earlier(samples, ["node_id", "metric"], "arrival", {"place": ("sum", F.lit(1).cast("long"))}).withColumn("place", F.coalesce("place", F.lit(0).cast("long")))
    size = samples.groupBy(F.col("node_id").alias("size_node"), F.col("metric").alias("size_metric")).agg(F.count("*").alias("size"))
    sized = placed.join(size, F.col("node_id").eqNullSafe(F.col("size_node")) & F.col("metric").eqNullSafe(F.col("size_metric")))
    weight = F.pow(F.lit(1 - alpha), F.col("size") - 1 - F.col("place")) * F.when(F.col("place") == 0, 1.0).otherwise(alpha)
    return sized.groupBy("node_id", "metric").agg(F.sum(F.col("value") * weight).alias("ewma"))
