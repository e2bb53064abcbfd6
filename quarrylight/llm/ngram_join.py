"""N-gram Jaccard join: near duplicates by a prefix-tree join over globally ordered n-gram sets.

1. Texts are dealt to blocks; of equal texts one, the representative, goes on.
2. Blocks ask for the document frequency of their shingles (see `blocks`). Rarest first is the
   global order. A pair of similarity 0.8 must share a shingle of both sets' prefixes (the first
   n - ceil(0.8 n) + 1); shingles of frequency 1 are shared by nobody, so most sets drop out, and
   of the others only the shingles of higher frequency travel.
3. Sets that share a prefix shingle and have fitting sizes are chained, within the block first; a
   block sends the ends of its chains. The components of all chains hold all candidate pairs.
4. The sets of a component stand in a trie by the global order. A set enters it at the nodes that
   hold a shingle of its prefix and goes down from there: the overlap with an edge is counted once
   for all sets below, and a subtree is left when the overlap and what remains of either side can't
   reach the bound, or when all below is known to be connected with the set.
5. A component larger than a task is first joined in parts, dealt twice at random, which connects
   large groups of near copies. What is left are pairs of different groups: parts of the component's
   largest group are joined with the sets of other groups that share a prefix shingle with it, and
   these among themselves by the prefix shingles that they share.
6. The links' components, and the smallest doc_id in each, are the result.

Results: one row for each row of the input. Null and empty texts, and texts without words, have
n_shingles 0 and are their own component, as is their doc_id. A null doc_id is linked like others
but never names a component (null if a component has no other). Repeated rows give a row each.
An empty table gives an empty one. Other columns are not read. Shingles are compared by 64-bit
hashes within blocks and by 56 bits of these within pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import blocks as B
from quarrylight.llm._kernel import shingles, text_column
from quarrylight.llm._shared import checkpointed
from quarrylight.llm.components import Forest, components, local_stars

WORDS = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Bytes of sets that one task compares; what is above this is cut into parts of half of it.
TASK_BYTES = 1 << 20
#: Bytes of text in a block, of which a worker holds all shingles.
BLOCK_BYTES = 4 << 20

_MADE = "kind int, bucket int, node long, n int, data binary, more binary, sizes binary"


def _kept(docs: pa.Table, aside: pa.Table) -> pa.Table:
    """The block's representatives: one row of each text that is the representative's."""
    if not docs.num_rows or not aside.num_rows:  # a side without rows has no columns either
        return pa.table({"text": pa.array([], pa.string()), "key": pa.array([], pa.int64())})
    reps = aside.filter(pc.is_valid(aside["rep_key"]))
    wanted = dict(zip(reps["rep_key"].to_pylist(), reps["rep_doc"].to_pylist()))
    rows, seen = [], set()
    for i, (key, doc) in enumerate(zip(docs["key"].to_pylist(), docs["doc_id"].to_pylist())):
        if key in wanted and key not in seen and wanted[key] == doc:
            seen.add(key)
            rows.append(i)
    return docs.take(pa.array(rows, pa.int64())).sort_by("key")


def _sets(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, shingles and offsets of the kept texts, and the distinct shingles."""
    nodes = docs["key"].to_numpy()
    values, offsets = shingles(*text_column(docs["text"]), WORDS)
    return nodes, values, offsets, np.unique(values)


def _block(key: tuple) -> int:
    return key[0].as_py()


def _asking(bits: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        _, values, _, distinct = _sets(_kept(docs, aside))
        counts = np.bincount(np.searchsorted(distinct, values), minlength=len(distinct))
        return B.ask(_block(key), distinct, np.minimum(counts, 255).astype(np.uint8), bits)

    return run


def _frequency(place: np.ndarray, values: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount(place, values, n), 255).astype(np.uint8)[place]


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def _packed(columns: dict[str, list]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _MADE.split(", ")]
    return pa.table([pa.array(columns[n], k) for n, k in zip(names, kinds)], names=names)


def _prefixes(bits: int):
    """The ends of a block's chains by bucket, the chains' links, the ordered sets that have a prefix entry, and all sizes."""

    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        nodes, values, offsets, distinct = _sets(_kept(docs, aside))
        if not len(distinct):
            aside = pa.table({"bucket": pa.array([], pa.int32()), "figures": pa.array([], pa.binary())})
        size = np.diff(offsets)
        often = B.figures(aside.filter(pc.is_valid(aside["bucket"])), "u1")[np.searchsorted(distinct, values)]
        rank = (often.astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
        row = np.repeat(np.arange(len(nodes)), size)
        order = np.lexsort((rank, row))
        rank, often, values = rank[order], often[order], values[order]
        early = np.arange(len(row)) - np.repeat(offsets[:-1], size) < np.repeat(prefix_size(size), size)
        entry = np.flatnonzero(early & (often > 1))
        open_rows = np.unique(row[entry])
        entry = entry[np.lexsort((size[row[entry]], values[entry]))]
        v, n, node = values[entry], size[row[entry]], nodes[row[entry]]
        chained = (v[1:] == v[:-1]) & (DENOMINATOR * n[:-1] >= NUMERATOR * n[1:])
        a, b = local_stars(node[:-1][chained], node[1:][chained])
        head = np.flatnonzero(np.concatenate([[True], ~chained])) if len(v) else np.zeros(0, np.int64)
        last = np.append(head[1:], len(v))[: len(head)] - 1
        ends = np.stack([n[head], n[last]], 1).astype("<i4")
        buckets, spans = B.cuts(B.bucket_of(v[head], bits))
        out = [(0, u, None, None, v[head[i:j]].tobytes(), node[head[i:j]].tobytes(), ends[i:j].tobytes()) for u, (i, j) in zip(buckets, spans)]
        for r in open_rows:
            own = slice(offsets[r], offsets[r + 1])
            out.append((1, None, int(nodes[r]), int(size[r]), rank[own][often[own] > 1].tobytes(), None, None))
        out.append((2, None, None, None, nodes.tobytes(), None, size.astype("<i4").tobytes()))
        out.append((3, None, None, None, a.tobytes(), b.tobytes(), None))
        return _packed(dict(zip([x.split()[0] for x in _MADE.split(", ")], zip(*out))))

    return run


def _chains(table: pa.Table) -> pa.Table:
    """Links between the blocks' chains of one prefix shingle: by their smallest sizes, each that the largest before it reaches."""
    value = np.frombuffer(b"".join(table["data"].to_pylist()), "<u8")
    node = np.frombuffer(b"".join(table["more"].to_pylist()), "<i8")
    ends = np.frombuffer(b"".join(table["sizes"].to_pylist()), "<i4").reshape(-1, 2).astype(np.int64)
    order = np.lexsort((node, ends[:, 0], value))
    value, node, ends = value[order], node[order], ends[order]
    group = np.cumsum(np.append(False, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate((group << 32) + ends[:, 1]) & 0xFFFFFFFF
    fits = (value[1:] == value[:-1]) & (node[1:] != node[:-1]) & (DENOMINATOR * reach[:-1] >= NUMERATOR * ends[1:, 0])
    a, b = local_stars(node[:-1][fits], node[1:][fits])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links_of_blocks(batches):
    for batch in B.frugal(batches):
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<i8") for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


class Node:
    """A run of shingles that all sets below have next, and what bounds those sets."""

    __slots__ = ("edge", "depth", "ends", "children", "least", "most", "longest", "member")

    def __init__(self, edge: np.ndarray, depth: int, least: int, most: int, longest: int):
        self.edge, self.depth, self.least, self.most, self.longest = edge, depth, least, most, longest
        self.ends: list[int] = []
        self.children: list[Node] = []
        self.member: int | None = None  # a set that all below are connected with


class Trie:
    """Ordered sets by their common beginnings. `index` has the nodes that hold a shingle in some set's prefix."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], numbers: list[int]):
        self.index: dict[int, list[Node]] = {}
        order = sorted(numbers, key=lambda i: sets[i].astype(">u8").tobytes())
        stack: list[tuple[int, int, int, Node | None]] = [(0, len(order), 0, None)]
        while stack:
            low, high, depth, parent = stack.pop()
            own = order[low:high]
            if not own:
                continue
            first, last = sets[own[0]], sets[own[-1]]
            k = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:k] != last[depth:k])
            end = depth + int(differ[0]) if len(differ) else k
            node = Node(first[depth:end], depth, min(sizes[i] for i in own), max(sizes[i] for i in own), max(len(sets[i]) for i in own))
            if parent:
                parent.children.append(node)
            prefix = max(prefix_length(sets[i], sizes[i]) for i in own)
            for value in node.edge[: max(0, prefix - depth)].tolist():
                self.index.setdefault(value, []).append(node)
            while low < high and len(sets[order[low]]) == end:
                node.ends.append(order[low])
                low += 1
            while low < high:
                value, to = sets[order[low]][end], low + 1
                while to < high and sets[order[to]][end] == value:
                    to += 1
                stack.append((low, to, end, node))
                low = to

    def similar(self, values: np.ndarray, n: int, prefix: int, forest: Forest, own: int, smaller: bool):
        """Sets (by number) of similarity 0.8 or more that aren't connected with set `own` yet, found by going down from the nodes of its prefix."""
        seen: set[int] = set()
        for value in values[:prefix].tolist():
            stack = [(node, 0, 0) for node in self.index.get(value, ()) if id(node) not in seen]
            while stack:
                node, overlap, at = stack.pop()
                seen.add(id(node))
                if DENOMINATOR * node.most < NUMERATOR * n or (node.least > n if smaller else NUMERATOR * node.least > DENOMINATOR * n):
                    continue
                if self._connected(node, forest, forest.find(own)):
                    continue
                need = NUMERATOR * (n + max(node.least, -(-NUMERATOR * n // DENOMINATOR)))
                whole = NUMERATOR + DENOMINATOR
                if whole * (overlap + min(len(values) - at, node.longest - node.depth)) < need:
                    continue
                if len(node.edge):
                    place = np.searchsorted(values, node.edge)
                    hit = values[np.minimum(place, len(values) - 1)] == node.edge
                    overlap += int(np.count_nonzero(hit))
                    at = int(place[-1]) + int(hit[-1])
                    if whole * (overlap + min(len(values) - at, node.longest - node.depth - len(node.edge))) < need:
                        continue
                for i in node.ends:
                    yield i, overlap
                stack += [(child, overlap, at) for child in node.children]

    @staticmethod
    def _connected(node: Node, forest: Forest, root: int) -> bool:
        if node.member is None:
            members = [c.member for c in node.children] + node.ends
            if None in members or len({forest.find(m) for m in members}) > 1:
                return False
            node.member = members[0]
        return forest.find(node.member) == root


def prefix_length(values: np.ndarray, n: int) -> int:
    """How many of a set's shared shingles are in its prefix; those that it has alone come first and aren't there."""
    return max(0, int(prefix_size(np.array(n))) - (n - len(values)))


def join_sets(sets: list[np.ndarray], sizes: list[int], side: list[int] | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets of similarity 0.8 or more; with two sides, only sets of different sides are compared.

    Of each set its shared shingles in the global order and its whole size; sets of one known group are connected.
    """
    forest, links, heads, apart = Forest(len(sets)), [], {}, len(sets)
    for i, group in enumerate(known or []):
        apart -= forest.union(i, heads.setdefault(group, i))
    two = side is not None and len(set(side)) > 1
    trie = Trie(sets, sizes, [i for i in range(len(sets)) if not two or not side[i]])
    for i in sorted((i for i in range(len(sets)) if not two or side[i]), key=lambda i: sizes[i]):
        if apart == 1:
            break
        n = sizes[i]
        for j, overlap in trie.similar(sets[i], n, prefix_length(sets[i], n), forest, i, not two):
            if i != j and DENOMINATOR * overlap >= NUMERATOR * (n + sizes[j] - overlap) and forest.union(i, j):
                links.append((i, j))
                apart -= 1
    return links


def _joined(table: pa.Table) -> pa.Table:
    """Links of all tasks of a group."""
    table = table.sort_by([("task", "ascending"), ("node", "ascending")])
    task, node = table["task"].to_numpy(), table["node"].to_numpy()
    side, known, sizes, data = (table[c].to_pylist() for c in ("side", "known", "n", "data"))
    edge = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]])).tolist()
    a, b = [], []
    for i, j in zip(edge, edge[1:]):
        for x, y in join_sets([np.frombuffer(d, "<u8") for d in data[i:j]], sizes[i:j], side[i:j], None if known[i] is None else known[i:j]):
            a.append(node[i + x])
            b.append(node[i + y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _prefix_entries(batches):
    """node, value of each prefix shingle of the sets."""
    for batch in B.frugal(batches):
        nodes, sets = batch.column(0).to_pylist(), [np.frombuffer(d, "<u8") for d in batch.column(2).to_pylist()]
        heads = [s[: prefix_length(s, n)] for s, n in zip(sets, batch.column(1).to_pylist())]
        value = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), [len(h) for h in heads])), pa.array(value.view(np.int64))], ["node", "value"])


def _between_groups(sets: DataFrame) -> DataFrame:
    """task, side, node: who is to be compared with whom among sets (node, n, data, label, known) of different known groups.

    Sets of a component's largest group and the others are compared if they share a prefix shingle at all,
    in parts, each of them sent once for a part of the others. The others are compared among themselves by
    prefix shingle, in pairs of parts; of shingles that the very same sets have, one will do.
    """
    rows = sets.select("node", "label", "known", F.octet_length("data").cast("long").alias("weight"))
    sums = rows.groupBy("label", "known").agg(F.sum("weight").alias("weight"))
    largest = sums.groupBy("label").agg(F.max_by("known", F.struct("weight", "known")).alias("largest"))
    marked = rows.join(largest, "label").select("node", "label", "known", "weight", (F.col("known") == F.col("largest")).alias("major"))
    entries = sets.select("node", "n", "data").mapInArrow(_prefix_entries, "node long, value long").join(marked, "node")

    def parts(weight):
        return F.greatest(F.lit(1), F.ceil(2 * weight / TASK_BYTES)).cast("int")

    def part(n, seed: int):
        return F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")

    def upto(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    both = entries.groupBy("label", "value").agg(F.count_if("major").alias("a"), F.count_if(~F.col("major")).alias("b")).where("a > 0 and b > 0")
    touching = entries.join(both.select("label", "value"), ["label", "value"], "left_semi").select("node", "label", "major", "weight").distinct()
    size = touching.groupBy("label").agg(parts(F.sum(F.when(F.col("major"), F.col("weight")))).alias("majors"), parts(F.sum(F.when(~F.col("major"), F.col("weight")))).alias("minors"))
    dealt = touching.join(size, "label")
    of_major = dealt.where("major").select("node", "label", upto(F.col("minors")).alias("a"), part(F.col("majors"), 3).alias("c"), F.lit(1).alias("side"))
    of_minor = dealt.where("not major").select("node", "label", part(F.col("minors"), 3).alias("a"), upto(F.col("majors")).alias("c"), F.lit(0).alias("side"))
    against = of_major.unionByName(of_minor).select("node", "side", F.xxhash64("label", "a", F.lit(-1), "c").alias("task"))

    others = entries.where("not major")
    alike = [F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)")).alias(f"sum{seed}") for seed in (4, 5)]
    by_value = others.groupBy("label", "value").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.sum("weight").alias("weight"), F.count("*").alias("sets"), *alike).where("low <> high")
    chosen = by_value.groupBy("label", "sets", "sum4", "sum5").agg(F.min("value").alias("value"), parts(F.max("weight")).alias("parts")).select("label", "value", "parts")
    mine = others.join(chosen, ["label", "value"]).select("node", "label", "value", "parts", part(F.col("parts"), 6).alias("a"))
    among = mine.select("node", "label", "value", "a", upto(F.col("parts")).alias("c")).select("node", (F.col("a") > F.col("c")).cast("int").alias("side"), F.xxhash64("label", "value", F.least("a", "c"), F.greatest("a", "c")).alias("task"))
    return against.unionByName(among)


def links_of(sets: DataFrame, candidates: DataFrame, groups: int) -> DataFrame:
    """a, b: links that connect all similar sets (node, n, data) within the candidates' components (node, label)."""
    schema = "a long, b long"
    # sets are shuffled by node alone: what is known of a component goes to its nodes first
    weight = sets.select("node", F.octet_length("data").alias("weight")).join(candidates, "node").groupBy("label").agg(F.sum("weight").alias("weight"))
    large = checkpointed(weight.where(F.col("weight") > TASK_BYTES).select("label", F.ceil(2 * F.col("weight") / TASK_BYTES).cast("int").alias("parts")))
    placed = candidates.join(large, "label", "left")
    task = F.when(F.col("parts").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("label", "seed", F.pmod(F.xxhash64("node", "seed"), F.col("parts"))))
    seeds = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))
    none = F.lit(None).cast("long").alias("known")
    dealt = sets.join(placed, "node").withColumn("seed", F.explode(seeds)).select(task.alias("task"), F.lit(0).alias("side"), none, "node", "n", "data")
    links = checkpointed(dealt.withColumn("group", F.pmod("task", F.lit(groups))).groupBy("group").applyInArrow(B.tidy_group(_joined), schema))
    if large.isEmpty():
        return links
    grouped = components(links).withColumnRenamed("label", "known")
    whose = placed.where(F.col("parts").isNotNull()).join(grouped, "node", "left").select("node", "label", F.coalesce("known", "node").alias("known"))
    rest = checkpointed(sets.join(whose, "node").select("node", "n", "data", "label", "known"))
    more = _between_groups(rest).join(rest, "node").select("task", "side", "known", "node", "n", "data")
    return links.unionByName(more.groupBy("task").applyInArrow(B.tidy_group(_joined), schema))


def classes(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    n_blocks = B.count_blocks(docs, block_bytes)
    bits = B.bucket_bits(n_blocks)
    reps = docs.groupBy("key").agg(F.min("doc_id").alias("rep"))
    dealt = B.dealt(docs, n_blocks, F.struct("doc_id", "key"))
    # new names and so new attributes: both sides of a cogroup stem from the documents
    reps_side = reps.select(F.col("key").alias("rep_key"), F.col("rep").alias("rep_doc"))
    rep_rows = B.dealt(reps_side, n_blocks, F.struct(F.col("rep_doc").alias("doc_id"), F.col("rep_key").alias("key"))).select("block", "rep_key", "rep_doc", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("figures"))
    side = dealt.groupBy("block")
    asked = side.cogroup(rep_rows.groupBy("block")).applyInArrow(B.tidy(_asking(bits)), B.ASK)
    answered = B.answers(asked, B.counter(_frequency, "u1")).select("block", F.lit(None).cast("long").alias("rep_key"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("rep_doc"), "bucket", "figures")
    made = checkpointed(side.cogroup(rep_rows.unionByName(answered).groupBy("block")).applyInArrow(B.tidy(_prefixes(bits)), _MADE))

    chains = made.where("kind = 0").select("bucket", "data", "more", "sizes").groupBy("bucket").applyInArrow(B.tidy_group(_chains), "a long, b long")
    within = made.where("kind = 3").select("data", "more").mapInArrow(_links_of_blocks, "a long, b long")
    links = links_of(made.where("kind = 1").select("node", "n", "data"), components(chains.unionByName(within)), n_blocks)
    labels = components(links)

    sizes = made.where("kind = 2").select("data", "sizes").mapInArrow(_sizes, "key long, n_shingles long")
    nodes = sizes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = nodes.join(reps, "key")
    smallest = named.groupBy("label").agg(F.min("rep").alias("least"))
    final = named.join(smallest, "label").select("key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).alias("least"))
    return docs.select("doc_id", "key").join(final, "key").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with all their columns, one of each group of linked ones: that of smallest doc_id.

    Rows of one doc_id that are its representative all stay, as do rows of null doc_id.
    """
    found = classes(docs, block_bytes)
    dropped = found.where("doc_id is not null and component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")


def _sizes(batches):
    for batch in B.frugal(batches):
        key = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
        n = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n_shingles"])
