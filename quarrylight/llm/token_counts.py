"""Edit-aware token counts: a segment tree for each document, of which edits re-encode a few leaves.

A text is cut before white space into leaves of some hundred characters. White space parts tokens, so
leaves are encoded on their own and their token counts add up. The tree keeps sums of characters and
of tokens; an edit finds its leaves by position, re-encodes them (and the leaf before, if the edit
begins where a leaf does, since what it writes may join the word that ends there) and updates the
sums above. `trees` makes a table with a tree column, to be stored; `edited` takes such a table and a
column of edits and returns it with the new trees, for the next edits: it has no other text than the
leaves, and encodes nothing but what an edit touches. Rows without edits pass by as Arrow columns.

Results: null and empty texts have one empty leaf and no tokens; edits beyond a text's end are cut to
it, and null ones leave the text as it is; they apply in order, each to the text that the one before
left; documents without edits keep their counts; repeated rows are edited alike, and null doc_ids like
others; a long text has more leaves; an empty table gives an empty one; other columns are kept by
`trees` and `edited`, which refuse a table that has one of the names that they add, and not read by `count`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.blocks import frugal
from quarrylight.llm.word_bpe import Encoder, encoder

LEAF = 256
_SPACE = re.compile(r"[\x20\x09-\x0D]")
EDITS = "array<struct<start:long,end:long,text:string>>"
#: Leaves' texts, and the sums of characters and tokens of all nodes from the root (1) on; the leaves' are the second half.
TREE = "struct<parts:array<string>,chars:array<bigint>,tokens:array<bigint>>"
ROWS_AT_ONCE = 512


def leaves(text: str) -> list[str]:
    """The text in parts of at least LEAF characters, each cut before white space."""
    out, at = [], 0
    while at < len(text):
        found = _SPACE.search(text, at + LEAF)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class SegmentTree:
    """Sums of characters and tokens over the leaves of a document."""

    def __init__(self, parts: list[str], tokens: list[int]):
        self.parts = parts
        self.size = 1 << max(0, len(parts) - 1).bit_length()
        pad = [0] * (self.size - len(parts))
        self.chars = [0] * self.size + [len(p) for p in parts] + pad
        self.tokens = [0] * self.size + list(tokens) + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def stored(cls, tree: dict) -> SegmentTree:
        """The tree that a row has, without adding anything up again."""
        out = object.__new__(cls)
        out.parts, out.chars, out.tokens = list(tree["parts"]), list(tree["chars"]), list(tree["tokens"])
        out.size = len(out.chars) // 2
        return out

    def row(self) -> dict:
        return {"parts": self.parts, "chars": self.chars, "tokens": self.tokens}

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that has a character position (the last leaf for the end of the text), and where it begins."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, leaf: int, part: str, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = len(part) - self.chars[node], tokens - self.tokens[node]
        self.parts[leaf] = part
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def region(self, start: int, end: int) -> tuple[int, int, int]:
        """First and last leaf that an edit touches or may join, and where the first begins."""
        first, at = self.find(start)
        if start == at and first:
            first, at = self.find(at - 1)
        return first, max(first, self.find(max(start, end - 1))[0] if end > start else self.find(start)[0]), at


def edit(trees: list[SegmentTree], edits: list[list[tuple[int, int, str]]], coder: Encoder) -> list[int]:
    """Applies each document's edits in order; the documents' first edits are encoded together, then their second, ...

    Returns how many characters were encoded again for each document.
    """
    again = [0] * len(trees)
    for turn in range(max(map(len, edits), default=0)):
        work = []
        for d, (tree, own) in enumerate(zip(trees, edits)):
            if turn >= len(own):
                continue
            start, end, text = own[turn]
            start = min(max(start, 0), tree.chars[1])
            end = min(max(end, start), tree.chars[1])
            first, last, at = tree.region(start, end)
            old = "".join(tree.parts[first : last + 1])
            work.append((d, first, last, old[: start - at] + text + old[end - at :]))
        for (d, first, last, part), ids in zip(work, coder.encode([w[3] for w in work])):
            tree = trees[d]
            again[d] += len(part)
            for leaf in range(first + 1, last + 1):
                tree.put(leaf, "", 0)
            tree.put(first, part, len(ids))
            if len(part) > 64 * LEAF:  # a leaf that has grown far is cut anew
                parts = [q for p in tree.parts for q in (leaves(p) if len(p) > 2 * LEAF else [p])]
                trees[d] = SegmentTree(parts, list(map(len, coder.encode(parts))))
    return again


_ROW = pa.struct([("parts", pa.list_(pa.string())), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frugal(batches):
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _with_columns(rows: DataFrame, run, added: dict[str, str], gone: str) -> DataFrame:
    """The rows with more columns in place of one; `run` gets a part of that one and returns arrays."""
    kept = [c for c in rows.columns if c != gone]
    if set(kept) & set(added):
        raise ValueError(f"the table has {sorted(set(kept) & set(added))} already")
    at = rows.columns.index(gone)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(part.columns)) if i != at), *run(part)], [*kept, *added])

    return rows.mapInArrow(over, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != gone), *(f"{c} {t}" for c, t in added.items())]))


def trees(docs: DataFrame, path: str) -> DataFrame:
    """All columns but the text, and tree, n_tokens: every text is cut and encoded once."""
    at = docs.columns.index("text")

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        cut = [leaves(t or "") for t in part.column(at).to_pylist()]
        sizes = iter(map(len, encoder(path).encode([p for parts in cut for p in parts])))
        made = [SegmentTree(parts, [next(sizes) for _ in parts]) for parts in cut]
        return [pa.array([t.row() for t in made], _ROW), pa.array([t.tokens[1] for t in made], pa.int64())]

    return _with_columns(docs, run, {"tree": TREE, "n_tokens": "bigint"}, "text")


def edited(rows: DataFrame, edits: str, path: str) -> DataFrame:
    """The rows of `trees` after the edits in a column of theirs, which goes: tree, n_tokens, and n_chars_encoded, what was encoded again."""
    names = [c for c in rows.columns if c not in (edits, "n_chars_encoded")]
    rows = rows.select(*(F.col(f"`{c}`") for c in names if c not in ("tree", "n_tokens")), F.struct("tree", F.col(f"`{edits}`").cast(EDITS).alias("edits")).alias("work"))
    at = rows.columns.index("work")

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        tree, own = part.column(at).field("tree"), part.column(at).field("edits")
        touched = pc.fill_null(pc.greater(pc.list_value_length(own), 0), False)
        some = pc.indices_nonzero(touched)
        made = [SegmentTree.stored(t) for t in tree.take(some).to_pylist()]
        wanted = [[(e["start"], e["end"], e["text"] or "") for e in edits if e and e["start"] is not None and e["end"] is not None] for edits in own.take(some).to_pylist()]
        again = edit(made, wanted, encoder(path))
        # new trees stand behind the old ones, and each row takes its own
        place = np.arange(len(tree))
        place[some.to_numpy()] = len(tree) + np.arange(len(made))
        encoded = np.zeros(len(tree), np.int64)
        encoded[some.to_numpy()] = again
        out = pa.concat_arrays([tree.cast(_ROW), pa.array([t.row() for t in made], _ROW)]).take(pa.array(place))
        return [out, pc.list_element(out.field("tokens"), 1), pa.array(encoded)]

    return _with_columns(rows, run, {"tree": TREE, "n_tokens": "bigint", "n_chars_encoded": "bigint"}, "work")


def count(docs: DataFrame, edits: Column, path: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_leaves, n_chars_encoded: counts before and after the edits."""
    made = trees(docs.select("doc_id", "text", edits.cast(EDITS).alias("edits")), path).withColumn("n_before", F.col("n_tokens"))
    after = edited(made, "edits", path)
    n_leaves = F.size("tree.parts").cast("long")
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.element_at("tree.chars", 2).alias("n_chars_edited"), n_leaves.alias("n_leaves"), "n_chars_encoded")


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits of every document at places that its id decides: an insertion, a deletion, a replacement."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def place(seed: int) -> Column:
        return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), n + 1)

    def one(start: Column, end: Column, new: str) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("text"))

    return F.array(
        one(place(1), place(1), " and, so it's said, 42 "),
        one(place(2), place(2) + 17, ""),
        one(place(3), place(3) + 5, "Übungen"),
    )
