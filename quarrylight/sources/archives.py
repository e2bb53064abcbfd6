"""A data source of compressed tar archives: one row for each member, one partition for each archive."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.security import glob
from quarrylight.sources.files import keys_of

#: Largest member whose content is read; of larger ones the row has none.
MEMBER_BYTES = 500 << 20
MEMBERS = "archive string, place long, member string, size long, content binary"


def _unpacked(path: str, content: bytes):
    """A tar stream of an archive, whatever it is compressed with."""
    if content[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return tarfile.open(fileobj=zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)), mode="r|")
    return tarfile.open(fileobj=io.BytesIO(content), mode="r|*")


def _members(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with _unpacked(path, content) as tar:
                for place, info in enumerate(x for x in tar):
                    if info.isfile():
                        content = tar.extractfile(info).read() if info.size <= MEMBER_BYTES else None
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]), pa.array([place], pa.int64()), pa.array([info.name]), pa.array([info.size], pa.int64()), pa.array([content], pa.binary())],
                            ["archive", "place", "member", "size", "content"],
                        )


def members(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """archive, place, member, size, content (null for a member over MEMBER_BYTES: see `left_out`). Archives are read by Spark's own reader, so any of its file systems will do."""
    archives = spark.read.format("binaryFile").load(paths).select("path", "content")
    return archives.mapInArrow(_members, MEMBERS).where(glob(F.col("member"), pattern))


def left_out(archived: DataFrame) -> DataFrame:
    """Members that are too large to be read."""
    return archived.where(F.col("content").isNull()).select("archive", "member", "size")


def member_keys(archived: DataFrame, skip_header: bool = False) -> DataFrame:
    """archive, member, key, ordinal: the integers of each member in ascending order."""
    text = F.decode("content", "UTF-8")
    found = archived.select("archive", "member", F.posexplode(F.array_sort(keys_of(F.col("member"), text, skip_header))).alias("ordinal", "key"))
    return found.select("archive", "member", "key", F.col("ordinal").cast("long").alias("ordinal"))


def sidecar(keys: DataFrame) -> DataFrame:
    """archive, member, n, first_key, last_key: what searches skip members by. Save it as Parquet or JSON."""
    return keys.groupBy("archive", "member").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def search_indexed(keys: DataFrame, index: DataFrame, value: int) -> DataFrame:
    """First ordinal of a key in each member whose range can hold it."""
    may = index.where((F.col("first_key") <= value) & (F.col("last_key") >= value)).select("archive", "member")
    return keys.where(F.col("key") == value).join(may, ["archive", "member"], "left_semi").groupBy("archive", "member").agg(F.min("ordinal").alias("ordinal"))


def documents(archived: DataFrame) -> DataFrame:
    """Members as documents for text search: doc_id in order of archive and place, name, text."""
    return archived.select(F.xxhash64("archive", "place").alias("doc_id"), F.col("member").alias("name"), F.decode("content", "UTF-8").alias("text"))


def telemetry_events(keys: DataFrame) -> DataFrame:
    """Keys as events that only have a time."""
    none = F.lit(0).cast("long")
    return keys.select(F.col("key").alias("timestamp"), none.alias("event_type"), none.alias("device_id"), none.alias("layer_id"))
