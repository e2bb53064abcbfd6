"""The record model: one envelope with hybrid-logical-clock time, versions, flags and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flag bits of a record.
TOMBSTONE, SNAPSHOT, EVENT, TELEMETRY, AUDIT, SENSITIVE, DERIVED, COMPACTED = (1 << i for i in range(8))
#: Classifications, lowest first.
UNCLASSIFIED, OPS, RESTRICTED, SECRET, TOP_SECRET = range(5)
NIL_ID = "00000000-0000-0000-0000-000000000000"
#: Largest epoch or generation that is accepted, and how far a clock may be ahead.
LARGEST_VERSION = 1 << 62
CLOCK_AHEAD_MS = 24 * 3600 * 1000


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp, floored."""
    return F.unix_millis(ts.cast("timestamp"))


def hlc(physical_ms: Column, logical: Column, node: Column) -> Column:
    """A clock value; structs compare field by field, which is the clock's order."""
    return F.struct(physical_ms.alias("physical_ms"), logical.alias("logical"), node.alias("node_id"))


def hlc_update(wall: Column, local: Column, remote: Column) -> Column:
    """The clock after a message: the latest of the three times; logical counts on where times are equal."""
    ms = F.greatest(wall, local["physical_ms"], remote["physical_ms"])
    logical = F.greatest(
        F.when(local["physical_ms"] == ms, local["logical"] + 1).otherwise(0),
        F.when(remote["physical_ms"] == ms, remote["logical"] + 1).otherwise(0),
    )
    return F.struct(ms.alias("physical_ms"), logical.alias("logical"), local["node_id"].alias("node_id"))


def staleness_ms(now_ms: Column, clock: Column) -> Column:
    return F.greatest(F.lit(0), now_ms - clock["physical_ms"])


def valid_id(value: Column) -> Column:
    """Canonical lower-case UUIDs that aren't nil."""
    return value.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & (value != NIL_ID)


#: Fixed values of the object id: starts of the two hashes, their prime, the domain.
_LANES, _PRIME, _DOMAIN = (14695981039346656037, 7809847782465536322), 1099511628211, b"DIRECTEYE-CANONICAL-v1"


def object_id(tenant: Column, record: Column) -> Column:
    """The id of a tenant's record: two FNV-1a hashes of domain, tenant (four bytes) and record, shaped as a UUID of version 5; null if one is null."""

    def run(tenants: pd.Series, names: pd.Series) -> pd.Series:
        raw = [None if pd.isna(t) or n is None else _DOMAIN + int(t).to_bytes(4, "big") + n.encode() for t, n in zip(tenants, names)]
        size = np.array([len(r or b"") for r in raw])
        data = np.zeros((len(raw), int(size.max(initial=0))), np.uint64)
        for i, r in enumerate(raw):
            data[i, : size[i]] = np.frombuffer(r or b"", np.uint8)
        lanes = []
        for start in _LANES:
            h = np.full(len(raw), start, np.uint64)
            for place in range(data.shape[1]):
                h = np.where(place < size, (h ^ data[:, place]) * np.uint64(_PRIME), h)
            lanes.append(h)
        version = lanes[0] & np.uint64(~0xF000 & (1 << 64) - 1) | np.uint64(0x5000)
        variant = lanes[1] & np.uint64((1 << 62) - 1) | np.uint64(1 << 63)
        text = [f"{int(a):016x}{int(b):016x}" for a, b in zip(version, variant)]
        return pd.Series([None if r is None else "-".join((t[:8], t[8:12], t[12:16], t[16:20], t[20:])) for r, t in zip(raw, text)])

    return F.pandas_udf(run, "string")(tenant, record)


def records(events: DataFrame) -> DataFrame:
    """The events table as labelled, versioned records."""
    e = F.col("event_id")
    flags = F.lit(EVENT) + F.when(F.col("event_type") == "error", SENSITIVE).otherwise(0) + F.when(e % 50 == 0, TOMBSTONE).otherwise(0)
    return events.select(
        F.col("user_id").alias("object_id"),
        e,
        (F.col("user_id") % 3).alias("node_id"),
        e.alias("generation"),
        F.when(e % 7 == 0, 2).otherwise(1).cast("long").alias("epoch"),
        millis(F.col("ts")).alias("physical_ms"),
        e.alias("logical"),
        (F.col("user_id") % 4).alias("tenant_id"),
        (e % 5).alias("classification"),
        (e % 8).alias("sci"),
        flags.cast("long").alias("flags"),
        "event_type",
        "value",
        e.alias("arrival"),
    )
