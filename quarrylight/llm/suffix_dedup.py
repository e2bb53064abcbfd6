"""Removal of repeated 50-byte strings by names of sampled positions.

This is not the difference-cover method that was asked for: that needs rows for all suffixes to be
merged, more disk than there is (figures in README). What is kept of it is its idea that any two equal
strings have sampled positions at the same place in them, and that names of the sample decide which
strings must be compared at all; nothing is ranked and there is no recursion. The sample follows the
text: of any 31 consecutive 20-byte strings the one of least hash is sampled, so every 50-byte string
has a sample (its anchor), at the same place wherever the string stands, and about one position in 16
is sampled.

1. Names: blocks of documents, dealt by ranges of doc_id, send their anchors' names (hashes of the 20
   bytes, each with the hash of the whole neighbourhood that the strings of this anchor span) to
   counters: is a name unique, does it always stand in the same neighbourhood, or in different ones?
2. Of anchors that always have the same neighbourhood the neighbourhood is sent; of anchors with
   different ones (the ends of repeats) every 50-byte string; counters tell which of them also start
   in an earlier block; equal ones in a block are found there.
3. Equal strings with a smaller doc_id mark all bytes of their strings.

Of equal texts only the one of smallest doc_id takes part; the others are removed altogether when
they have 50 bytes. Strings are compared by 64-bit hashes.

Results: a row for each row; null texts count as empty; rows of null doc_id neither lose bytes nor
make others lose any; rows of one doc_id aren't compared with each other; an empty table gives an
empty one; long texts are no special case. `deduplicate` keeps all columns and, where a cut went through a character, drops its rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import blocks as B
from quarrylight.llm._kernel import mix, ranges, runs, span_hash, text_column

LENGTH = 50
NAME = 20
WINDOW = LENGTH - NAME + 1
BLOCK_BYTES = 2 << 20
UNIQUE, ALIKE, MIXED = 0, 1, 2

_U = np.uint64
_ROUND = {"names": 0, "merge": 1}


class Anchors:
    """The anchors of a block's texts: row, position, first and last string start, and their names."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets, self.sums = offsets, runs(data)
        starts = ranges(offsets[:-1], np.maximum(0, np.diff(offsets) - LENGTH + 1))
        at = self._least(len(data))[starts] + starts
        row = np.searchsorted(offsets, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        self.row, self.at, self.low = row[head], at[head], starts[head]
        self.high = starts[np.append(head[1:], len(starts)) - 1] if len(head) else starts[:0]
        self.name = span_hash(self.sums, self.at, self.at + NAME)
        self.around = mix(span_hash(self.sums, self.low, self.high + LENGTH) + (self.at - self.low).astype(_U) * _U(0xD1342543DE82EF95))

    def _least(self, n: int) -> np.ndarray:
        """For each string start, how far the first name of least hash lies ahead."""
        if n < LENGTH:
            return np.zeros(n, np.uint8)
        places = np.arange(n - NAME + 1)
        least = (span_hash(self.sums, places, places + NAME) >> _U(32)).astype(np.uint32)
        ahead, width = np.zeros(len(least), np.uint8), 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            later = least[step:] < least[:-step]
            ahead = np.where(later, ahead[step:] + np.uint8(step), ahead[:-step])
            least = np.where(later, least[step:], least[:-step])
            width += step
        return ahead

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names with neighbourhoods in order, and the place of each anchor's among them."""
        order = np.lexsort((self.around, self.name))
        name, around = self.name[order], self.around[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (around[1:] != around[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return name[new], around[new], place

    def kinds(self, told: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What the counters said of each anchor; a name that only this block has may be shared within it."""
        first, last = np.full(len(told), 1 << 60), np.full(len(told), -1)
        np.minimum.at(first, place, self.row)
        np.maximum.at(last, place, self.row)
        return np.where((told == UNIQUE) & (first < last), ALIKE, told)[place]

    def strings(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row, begin and end of what is to be compared: neighbourhoods, and single strings."""
        alike, mixed = np.flatnonzero(kind == ALIKE), np.flatnonzero(kind == MIXED)
        n = self.high[mixed] - self.low[mixed] + 1
        single = ranges(self.low[mixed], n)
        value = np.concatenate([self.around[alike], span_hash(self.sums, single, single + LENGTH)])
        row = np.concatenate([self.row[alike], np.repeat(self.row[mixed], n)])
        return value, row, np.concatenate([self.low[alike], single]), np.concatenate([self.high[alike], single]) + LENGTH


def _told(aside: pa.Table, stage: str, kind: str) -> np.ndarray:
    return B.figures(aside.filter(pc.equal(aside["stage"], _ROUND[stage])), kind)


def _representatives(aside: pa.Table) -> dict[int, int]:
    """The smallest doc_id of each text whose representative is in this block."""
    if not aside.num_rows:
        return {}
    reps = aside.filter(pc.equal(aside["stage"], -1))
    return dict(zip(reps["rep_key"].to_pylist(), reps["rep_doc"].to_pylist()))


def _taking_part(docs: pa.Table, aside: pa.Table) -> pa.Table:
    """The block's distinct texts, each with its smallest doc_id (the representative), by doc_id."""
    names = ["doc_id", "text", "key"]
    if not docs.num_rows or not aside.num_rows:  # a side without rows has no columns either
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64())], names=names)
    wanted = _representatives(aside)
    rows, seen = [], set()
    for i, (key, doc) in enumerate(zip(docs["key"].to_pylist(), docs["doc_id"].to_pylist())):
        if doc is not None and wanted.get(key) == doc and key not in seen:
            seen.add(key)
            rows.append(i)
    return docs.select(names).take(pa.array(rows, pa.int64())).sort_by([("doc_id", "ascending"), ("key", "ascending")])


def _asks_names(bits: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        name, around, _ = Anchors(*text_column(_taking_part(docs, aside)["text"])).pairs()
        return B.ask(key[0].as_py(), name, around, bits)

    return run


def _tells_kinds(place: np.ndarray, values: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    entries = np.bincount(place, minlength=n)
    least, most = np.full(n, ~_U(0)), np.zeros(n, _U)
    np.minimum.at(least, place, values)
    np.maximum.at(most, place, values)
    return np.where(entries < 2, UNIQUE, np.where(least == most, ALIKE, MIXED)).astype(np.uint8)[place]


def _compared(aside: pa.Table, part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    anchors = Anchors(*text_column(part["text"]))
    _, _, place = anchors.pairs()
    told = _told(aside, "names", "u1") if len(place) else np.zeros(0, np.uint8)
    value, row, begin, end = anchors.strings(anchors.kinds(told, place) if len(place) else np.zeros(0, np.uint8))
    return value, row, begin, end, anchors.offsets


def _asks_strings(bits: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        value, *_ = _compared(aside, _taking_part(docs, aside))
        return B.ask(key[0].as_py(), np.unique(value), None, bits, exact=True)

    return run


def _tells_earlier(place: np.ndarray, values: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    first = np.full(n, 1 << 31)
    np.minimum.at(first, place, block)
    return (first[place] < block).astype(np.uint8)


def _removed(aside: pa.Table, part: pa.Table) -> dict[int, np.ndarray]:
    """For each representative's key the bytes that go, as a mask."""
    value, row, begin, end, offsets = _compared(aside, part)
    doc = part["doc_id"].to_numpy()
    distinct, place = np.unique(value, return_inverse=True)
    earlier = _told(aside, "merge", "u1")[place] == 1 if len(distinct) else np.zeros(0, bool)
    first = np.full(len(distinct), len(doc))
    np.minimum.at(first, place, row)  # rows stand by doc_id
    hit = earlier | (doc[first[place]] < doc[row]) if len(distinct) else earlier
    depth = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(depth, begin[hit], 1)
    np.add.at(depth, end[hit], -1)
    gone = np.cumsum(depth)[:-1] > 0
    return {k: gone[a:b] for k, a, b in zip(part["key"].to_pylist(), offsets.tolist(), offsets[1:].tolist())}


def _finish(columns: list[str], digest: bool):
    """Rows of the result: digests of what is kept, or the documents with what is kept as their text."""

    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        if not docs.num_rows:
            raise ValueError("a block without documents asked for nothing")
        gone = _removed(aside, _taking_part(docs, aside)) if aside.num_rows else {}
        reps = _representatives(aside)
        n_bytes, n_removed, n_spans, sha, texts = [], [], [], [], []
        for doc, text, k in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), docs["key"].to_pylist()):
            raw = (text or "").encode()
            if doc is None:
                mask = None
            elif reps.get(k) == doc:
                mask = gone.get(k)
            else:  # a copy of a text with a smaller doc_id
                mask = np.full(len(raw), len(raw) >= LENGTH)
            if mask is None or not mask.any():
                kept, removed, spans = raw, 0, 0
            else:
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                removed, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            n_bytes.append(len(raw))
            n_removed.append(removed)
            n_spans.append(spans)
            if digest:
                sha.append(hashlib.sha256(kept).hexdigest())
            else:
                texts.append(text if not removed else kept.decode("utf-8", "ignore"))
        if digest:
            more = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            return pa.table([docs["doc_id"], *more, pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        arrays = [pa.array(texts, pa.string()) if c == "text" else docs["carried"].combine_chunks().field(c) if c != "doc_id" else docs["doc_id"] for c in columns]
        return pa.table(arrays, names=columns)

    return run


def _run(docs: DataFrame, digest: bool, block_bytes: int) -> DataFrame:
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    carried = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("carried") if rest and not digest else F.lit(None).cast("boolean").alias("carried")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), carried)
    n_blocks = B.count_blocks(docs, block_bytes)
    bits = B.bucket_bits(n_blocks)
    block = B.id_ranges(docs, n_blocks)
    apart = F.pmod(F.xxhash64("key", "carried"), F.lit(n_blocks)).cast("int")  # rows of null doc_id aren't compared
    reps = keyed.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")).select(F.col("key").alias("rep_key"), F.col("rep").alias("rep_doc"))
    told = [F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("figures")]
    side = keyed.withColumn("block", F.when(F.col("doc_id").isNull(), apart).otherwise(block(F.col("doc_id")))).groupBy("block")
    rep_rows = reps.withColumn("block", block(F.col("rep_doc"))).select(F.col("block").alias("aside_block"), F.lit(-1).alias("stage"), "rep_key", "rep_doc", *told)

    def answered(asked: DataFrame, stage: str, run) -> DataFrame:
        return B.answers(asked, run).select(F.col("block").alias("aside_block"), F.lit(_ROUND[stage]).alias("stage"), F.lit(None).cast("long").alias("rep_key"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("rep_doc"), "bucket", "figures")

    def with_side(aside: DataFrame, run, schema: str) -> DataFrame:
        return side.cogroup(aside.groupBy("aside_block")).applyInArrow(B.tidy(run), schema)

    names = answered(with_side(rep_rows, _asks_names(bits), B.ASK), "names", B.counter(_tells_kinds, "<u8"))
    first = rep_rows.unionByName(names)
    merge = answered(with_side(first, _asks_strings(bits), B.ASK), "merge", B.counter(_tells_earlier, exact=True))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return with_side(first.unionByName(merge), _finish(columns, digest), schema)


def digests(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _run(docs, True, block_bytes)


def deduplicate(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with all their columns, their texts without the repeated bytes."""
    return _run(docs, False, block_bytes)
