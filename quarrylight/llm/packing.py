"""First-fit-decreasing packing with a tournament tree of bin capacities, in randomised groups.

Every document is encoded (and ended with a marker) once; a document longer than a sequence is
cut into full sequences and a rest. The pieces, which are small rows by now, are dealt to groups
by a hash of the document. In a group they are taken by falling length, and each goes to the
first sequence that still has room. The tree holds the largest room below each node, so that the
first such sequence is found in log n steps.

Results: a null or empty text is one piece that has only the end marker; repeated rows are packed
as often as they occur; a null doc_id stays null; an empty table gives an empty result; other
columns are not read. Ties of length are broken by doc_id, start, checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.blocks import frugal
from quarrylight.llm.word_bpe import encoder

SEQUENCE = 4096
END_ID = 2
#: Documents that a group has on average; groups stay of this size however large the table is.
GROUP_DOCUMENTS = 4096


class Rooms:
    """A tournament tree over the rooms left in sequences 0, 1, 2, ..."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 64
        self.tree = [capacity] * (2 * self.size)
        self.used = 0

    def place(self, length: int) -> tuple[int, int]:
        """Puts a piece into the first sequence with room; its number and the offset there."""
        if self.tree[1] < length:
            self._widen()
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        room = tree[node]
        tree[node] = room - length
        at = node - self.size
        self.used = max(self.used, at + 1)
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return at, self.capacity - room

    def _widen(self) -> None:
        leaves = self.tree[self.size :] + [self.capacity] * self.size
        self.size *= 2
        self.tree = [0] * self.size + leaves
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])


def first_fit_decreasing(lengths: list[int], capacity: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; the pieces come by falling length."""
    rooms = Rooms(capacity)
    placed = [rooms.place(n) for n in lengths]
    return [a for a, _ in placed], [b for _, b in placed]


def pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in frugal(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, start, length, check, tokens = [], [], [], [], []
                for i, ids in enumerate(coder.encode(part.column(1).to_pylist())):
                    raw = ids.tobytes() + end
                    for b in range(0, len(raw), 4 * capacity):
                        cut = raw[b : b + 4 * capacity]
                        row.append(i)
                        start.append(b // 4)
                        length.append(len(cut) // 4)
                        check.append(zlib.crc32(cut))
                        tokens.append(len(raw) // 4)
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, check, tokens))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, groups: int, capacity: int = SEQUENCE, seed: int = 7) -> DataFrame:
    """The pieces with sequence_id and offset. Each of the groups, dealt by a hash, is packed on its own."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "doc_tokens", F.lit(seed)), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = first_fit_decreasing(table["length"].to_pylist(), capacity)
        group = table["pack_group"][0].as_py()
        numbers = pa.array(np.array(sequence, np.int64) + (group << 32))
        return table.drop_columns(["pack_group"]).append_column("sequence_id", numbers).append_column("offset", pa.array(offset, pa.int64()))

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """All pieces of all documents, packed."""
    groups = max(1, round(docs.count() / GROUP_DOCUMENTS))
    return pack(pieces(docs, path, capacity, end_id), groups, capacity)
