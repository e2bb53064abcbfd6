"""Streaming twins of the telemetry operators: baselines kept per series, windows by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.operators.telemetry import ALPHA, MIN_SAMPLES

_OUT = "node_id long, metric string, arrival long, value double, n long, z double, ewma double"
_STATE = "n long, s double, q double, ewma double"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, s, q, ewma = state.get if state.exists else (0, 0.0, 0.0, 0.0)
    rows = pd.concat(list(batches)).sort_values("arrival")  # order isn't kept through a shuffle
    out = []
    for arrival, v in zip(rows["arrival"].tolist(), rows["value"].tolist()):
        z = None
        if n >= MIN_SAMPLES:
            mean, variance = s / n, max((q - s * s / n) / (n - 1), 0.0)
            deviation = 0.001 if variance <= 1e-6 < abs(v - mean) else variance**0.5
            z = (v - mean) / deviation if deviation > 0 else 0.0
        ewma = v if n == 0 else ALPHA * v + (1 - ALPHA) * ewma
        out.append((*key, arrival, v, n, z, ewma))
        n, s, q = n + 1, s + v, q + v * v
    state.update((n, s, q, ewma))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])


def baselines(samples: DataFrame) -> DataFrame:
    """Each sample with its z-score and moving mean; four numbers of state for each series, in order within a batch."""
    return samples.groupBy("node_id", "metric").applyInPandasWithState(_fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windows(samples: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts, means and extremes of tumbling windows; rows later than the watermark are dropped by Spark's rule."""
    timed = samples.withColumn("time", F.timestamp_millis("physical_ms")).withWatermark("time", late)
    return timed.groupBy(F.window("time", size), "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")).select(F.unix_millis(F.col("window.start")).alias("start_ms"), "metric", "n", "mean", "min", "max")
