"""Binary record envelopes, capability frames, strict JSON events."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the wire formats: header layout, magic, version, largest payload.
_HEADER = struct.Struct("<7I3Q2I16s16s16sQ2I")
MAGIC, VERSION, LARGEST_PAYLOAD = 0x4B464452, 1, 64 << 20
RECORD = "flags long, object_type long, tenant_id long, classification long, payload_length long, generation long, epoch long, physical_ms long, logical long, object_id string, event_id string, node_id string, sci long, payload binary"


def pack(record: dict, payload: bytes = b"") -> bytes:
    """A header with checksums of itself (but for its end) and of the payload, and the payload."""
    ids = [uuid.UUID(record[k]).bytes for k in ("object_id", "event_id", "node_id")]
    body = _HEADER.pack(
        MAGIC, VERSION, record["flags"], record["object_type"], record["tenant_id"], record["classification"], len(payload),
        record["generation"], record["epoch"], record["physical_ms"], record["logical"], 0, *ids, record["sci"], 0, 0,
    )
    head = body[:-8]
    return head + struct.pack("<2I", zlib.crc32(head), zlib.crc32(payload) if payload else 0) + payload


def unpack(raw: bytes | None) -> dict | None:
    """The record, or None for anything that isn't whole."""
    if raw is None or len(raw) < _HEADER.size:
        return None
    f = _HEADER.unpack_from(raw)
    payload = raw[_HEADER.size : _HEADER.size + f[6]]
    sums = (zlib.crc32(raw[: _HEADER.size - 8]), zlib.crc32(payload) if payload else 0)
    if f[0] != MAGIC or f[1] != VERSION or f[6] > LARGEST_PAYLOAD or len(payload) < f[6] or f[16:18] != sums:
        return None
    ids = [str(uuid.UUID(bytes=x)) for x in f[12:15]]
    return dict(
        flags=f[2], object_type=f[3], tenant_id=f[4], classification=f[5], payload_length=f[6], generation=f[7], epoch=f[8], physical_ms=f[9], logical=f[10],
        object_id=ids[0], event_id=ids[1], node_id=ids[2], sci=f[15], payload=payload,
    )


def _decoded(raw: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pd.DataFrame([unpack(x) or dict.fromkeys(names) for x in raw], columns=names).convert_dtypes()


def decoded(frames: DataFrame, column: str = "frame") -> tuple[DataFrame, DataFrame]:
    """The records of whole frames, and the frames that aren't (for quarantine)."""
    rows = frames.withColumn("record", F.pandas_udf(_decoded, RECORD)(F.col(column)))
    return rows.where("record.event_id is not null").select("record.*"), rows.where("record.event_id is null").drop("record")


def little_endian(raw: Column, start: int, size: int) -> Column:
    """An unsigned number of a binary column, from place `start` (1 is first)."""
    digits = (F.conv(F.hex(F.substring(raw, start + i, 1)), 16, 10).cast("long") * (1 << (8 * i)) for i in range(size))
    return sum(digits, F.lit(0).cast("long"))


def node_capabilities(frames: DataFrame, column: str = "frame") -> DataFrame:
    """node_id, isa_tier, npu, gpu, free_ram_mb, load_pct of 50-byte capability payloads; others are left out."""
    raw = F.col(column)
    name = F.regexp_replace(F.decode(F.substring(raw, 1, 40), "UTF-8"), "\x00.*$", "")
    return frames.where(F.octet_length(raw) == 50).select(
        name.alias("node_id"),
        little_endian(raw, 41, 1).alias("isa_tier"),
        (little_endian(raw, 42, 1) != 0).alias("npu"),
        (little_endian(raw, 43, 1) != 0).alias("gpu"),
        little_endian(raw, 45, 4).alias("free_ram_mb"),
        (little_endian(raw, 49, 2) / 100.0).alias("load_pct"),
    )


EVENT = "schema long, tenant_id long, key string, mutation string, operation_id string, object_id string, classification long, sci long, cursor long, record string"


def _strict(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key occurs twice")
    return out


def event(text: str | None) -> dict | None:
    """A strict event: no key twice at any depth, schema 1, canonical ids, its key names its object, a record unless it deletes."""
    try:
        e = json.loads(text, object_pairs_hook=_strict)
        record, kind = e["record"], e["mutation"]
        fine = e["schema"] == 1 and isinstance(e["tenant_id"], int) and e["tenant_id"] > 0
        fine = fine and all(str(uuid.UUID(e[k])) == e[k] for k in ("operation_id", "object_id"))
        fine = fine and e["key"] == f"t:{e['tenant_id']}/canonical/v1/{e['object_id']}"
        fine = fine and (isinstance(record, dict) if kind == "upsert" else record is None and kind == "delete")
        return {**{k: e[k] for k in ("schema", "tenant_id", "key", "mutation", "operation_id", "object_id", "classification", "sci", "cursor")}, "record": json.dumps(record) if record is not None else None} if fine else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _events(text: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in EVENT.split(", ")]
    return pd.DataFrame([event(x) or dict.fromkeys(names) for x in text], columns=names).convert_dtypes()


def events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The valid events of lines of JSON, and the lines that aren't."""
    rows = lines.withColumn("event", F.pandas_udf(_events, EVENT)(F.col(column)))
    return rows.where("event.key is not null").select("event.*"), rows.where("event.key is null").drop("event")


def projected_page(page: DataFrame, cursor: int, most: int = 128) -> DataFrame:
    """The events after a cursor of one tenant, with logical times that rise within a millisecond; a broken order fails the query."""
    from pyspark.sql import Window

    ahead = page.where(F.col("cursor") > cursor).orderBy("cursor").limit(most)
    w = Window.partitionBy("tenant_id").orderBy("cursor")
    checked = ahead.withColumn("fell", F.col("physical_ms") < F.lag("physical_ms").over(w))
    safe = checked.where(F.when(F.col("fell"), F.raise_error(F.lit("the clock fell back"))).otherwise(F.lit(True)).cast("boolean"))
    return safe.drop("fell").withColumn("logical", F.row_number().over(Window.partitionBy("tenant_id", "physical_ms").orderBy("cursor")) - 1)
