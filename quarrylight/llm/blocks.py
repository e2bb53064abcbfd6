"""Documents dealt to blocks of some megabytes, and questions that blocks put to counters.

Several operators need, for every n-gram of every document, a figure of the whole corpus. Sending
each n-gram as a row is many times the input. Here a block of documents sends, for each bucket of
the hash space, one row with the sorted keys of all its n-grams in that bucket as packed bytes; a
bucket combines what all blocks sent, and answers each block with packed figures in the same
order. The block, built again from the same shuffled documents, puts them beside its n-grams.

Blocks are dealt by a hash of the document (or by a column of the caller's), so none is hot;
equal keys in a block are sent once, so a hot key costs a bucket one entry for each block.
"""

from __future__ import annotations

import ctypes
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block. Buckets are as many as blocks, so a bucket's work stays of one size too.
BLOCK_BYTES = 8 << 20
#: Small tables have as many blocks as the session has partitions, but none of less than this.
LEAST_BYTES = 1 << 20
#: Ranges of ids whose edges are listed, and the bytes that count as one row where these are set.
MOST_EDGES = 10_000
WEIGHT_BYTES = 4096

ASK = "block int, bucket int, n int, keys binary, values binary"


def count_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the texts need."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / LEAST_BYTES))
    return max(1, math.ceil(total / block_bytes), spread)


def dealt(docs: DataFrame, blocks: int, by: Column) -> DataFrame:
    """The rows with a block number, a hash of `by`."""
    return docs.withColumn("block", F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int"))


def bucket_bits(blocks: int) -> int:
    """Buckets are a power of two, so that the first bits of a key name its bucket."""
    return max(0, blocks - 1).bit_length()


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def cuts(bucket: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """The buckets that ascending entries have, and where each one's begin and end."""
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[heads].tolist(), list(zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)]))


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned values as planes of their bytes, lowest first, without the empty ones at the top: these shrink well in a shuffle."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = np.flatnonzero(raw.any(0))
    return raw[:, : used[-1] + 1].T.tobytes() if len(used) else b""


def unpack_planes(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if packed:
        planes = np.frombuffer(packed, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def pack_rising(keys: np.ndarray) -> bytes:
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_rising(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_planes(packed, n), dtype=np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys as 3-byte steps; as 4-byte keys, after a mark, where a step is too long."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    if len(steps) and int(steps.max()) < 1 << 24:
        return steps.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return b"\xff" + keys.astype("<u4").tobytes()


def unpack_keys(packed: bytes, n: int) -> np.ndarray:
    if len(packed) == 3 * n:
        steps = np.zeros((n, 4), np.uint8)
        steps[:, :3] = np.frombuffer(packed, np.uint8).reshape(n, 3)
        return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint32)
    return np.frombuffer(packed, "<u4", n, 1)


def ask(block: int, keys: np.ndarray, values: np.ndarray | None, bits: int, exact: bool = False) -> pa.Table:
    """Rows of one block: its ascending distinct keys, cut by their first bits, and a value of each.

    Of each key 32 bits go beside those that name the bucket (all 64 with `exact`).
    """
    full, spans = cuts(bucket_of(keys, bits))
    low = keys if exact else (keys >> np.uint64(32 - bits)).astype(np.uint32)
    return pa.table(
        {
            "block": pa.array([block] * len(full), pa.int32()),
            "bucket": pa.array(full, pa.int32()),
            "n": pa.array([b - a for a, b in spans], pa.int32()),
            "keys": pa.array([low[a:b].tobytes() if exact else pack_keys(low[a:b]) for a, b in spans], pa.binary()),
            "values": pa.array([b"" if values is None else values[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def counter(answer: Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray], value_type: str | None = None, exact: bool = False) -> Callable[[pa.Table], pa.Table]:
    """A bucket's side: `answer(place, values, n, block)` gets, for all entries sent, the number of the
    distinct key of each, the values, how many distinct keys there are and the block of each entry, and
    returns an array with a figure for each entry."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["block"].to_numpy())
        table = table.take(pa.array(order))
        sizes = table["n"].to_numpy()
        parts = [np.frombuffer(x, "<u8") if exact else unpack_keys(x, n) for x, n in zip(table["keys"].to_pylist(), sizes.tolist())]
        keys = np.concatenate(parts)
        values = np.frombuffer(b"".join(table["values"].to_pylist()), value_type) if value_type else np.zeros(0)
        distinct, place = np.unique(keys, return_inverse=True)
        figures = answer(place, values, len(distinct), np.repeat(table["block"].to_numpy(), sizes))
        cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return pa.table(
            {
                "block": table["block"].cast(pa.int32()),
                "bucket": table["bucket"].cast(pa.int32()),
                "figures": pa.array([figures[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
            }
        )

    return run


def range_of(column: Column, edges: list) -> Column:
    """How many of the ascending edges are at most the column's value, found in two steps."""
    step = max(1, math.isqrt(len(edges)))
    rows = [edges[i : i + step] for i in range(0, len(edges), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows[1:]]) if len(rows) > 1 else F.array().cast("array<bigint>")
    row = F.size(F.filter(heads, lambda e: e <= column))
    tails = F.array(*[F.array(*[F.lit(e) for e in r]) for r in rows])
    return (row * F.lit(step) + F.size(F.filter(F.element_at(tails, row + 1), lambda e: e <= column))).cast("int")


def id_edges(docs: DataFrame, ranges: int) -> list[int]:
    """doc_ids that cut the rows into ranges of about equal bytes; as many as ranges, less one, at most."""
    if ranges < 2:
        return []
    at = [i / ranges for i in range(1, ranges)]
    weight = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / WEIGHT_BYTES).cast("int")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.explode(F.sequence(F.lit(1), weight)))
    found = ids.agg(F.percentile_approx("id", at, 100 * ranges)).first()[0]
    return sorted(set(found or []))


def released() -> None:
    """Gives memory that a block has used back to the system; a worker lives on and others run beside it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory is released after each, since idle workers keep what they have."""
    for batch in batches:
        yield batch
        del batch
        released()


def tidy(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A cogroup function that releases memory after each block."""

    def tidied(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        out = run(key, docs, aside)
        released()
        return out

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that releases memory after each group."""

    def tidied(table: pa.Table) -> pa.Table:
        out = run(table)
        released()
        return out

    return tidied


def id_ranges(docs: DataFrame, blocks: int) -> Callable[[Column], Column]:
    """A function from doc_ids to blocks that rise with them.

    Listed edges cut the ids into ranges of equal bytes, one a block up to MOST_EDGES of them; if more
    blocks are needed, each range is cut into blocks of equal widths of ids.
    """
    edges = id_edges(docs, min(blocks, MOST_EDGES))
    fine = math.ceil(blocks / (len(edges) + 1))
    if fine == 1:
        return lambda column: range_of(column.cast("long"), edges) if edges else F.lit(0)
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    starts = [low or 0, *edges]
    widths = [max(1, math.ceil((b - a) / fine)) for a, b in zip(starts, [*edges, (high or 0) + 1])]
    lists = [F.array(*[F.lit(x) for x in part]).cast("array<bigint>") for part in (starts, widths)]

    def block(column: Column) -> Column:
        at = range_of(column.cast("long"), edges) if edges else F.lit(0)
        above = column.cast("long") - F.element_at(lists[0], at + 1)
        width = F.element_at(lists[1], at + 1)
        return (at * fine + F.least((above - F.pmod(above, width)) / width, F.lit(fine - 1))).cast("int")

    return block


ANSWER = "block int, bucket int, figures binary"


def answers(asked: DataFrame, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(tidy_group(run), ANSWER)


def figures(table: pa.Table, kind: str) -> np.ndarray:
    """The figures that a block got, in the order of its keys."""
    order = np.argsort(table["bucket"].to_numpy())
    return np.frombuffer(b"".join(table["figures"].take(pa.array(order)).to_pylist()), kind)
