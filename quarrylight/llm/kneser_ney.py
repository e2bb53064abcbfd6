"""A quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The n-grams are of five bytes of UTF-8, so capitals, digits, marks and the letters of every language
are told apart, and an n-gram is its own key: nothing is hashed or folded. (Word n-grams would need
more disk than the task allows, see README.) Before a text stand edges, and its end is a symbol, so
the model is a distribution over texts.

Documents are dealt to blocks (see `blocks`). A block sends each bucket, once, the distinct n-grams of
all orders that it needs, with their counts in its trusted documents; the labels come to the block by
the same key. Buckets hold all n-grams of a history: they add the counts up, count the histories'
followers, and hand the different n-grams on, without their first byte, to the next lower order, whose
counts are these continuation counts. The asks are joined to the sums of all orders in their bucket,
and the block works out its documents' perplexities from the answers. The model is never gathered: only
the number of n-grams that occur one to four times, for each order, is sent to all.

A document's perplexity is compared with a quantile of the perplexities of all trusted documents of
its language; a language without trusted documents takes the quantile of all trusted ones.

Results: a row for each row; null and empty texts have no symbols, perplexity null, and are not kept; a
null language is a language of its own; null doc_ids are scored, but labels don't reach them; labels
that are null count for nothing and repeated ones once; repeated rows count and are scored as often as
they occur; ties with the quantile are kept; long texts are worked through in runs; an empty table gives
an empty one; without trusted text the model is uniform and everything that has text is kept. Only
doc_id, text and lang are read, so no column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrylight.llm import blocks as B
from quarrylight.llm._kernel import CHUNK_BYTES, mix, pieces, text_column
from quarrylight.llm._shared import checkpointed

ORDER = 5
SYMBOLS = 256
#: Stands before a text and for its end; no byte of UTF-8 has this value.
EDGE = 255
#: Of the trusted documents' perplexities in a language.
QUANTILE = 0.995
BLOCK_BYTES = 16 << 20

_U = np.uint64
_TAG = _U(8 * ORDER)  # a key is an n-gram below the number of its order
_ASKED = "block int, bucket int, n int, keys binary, counts binary"
_LOWER = "kind int, level int, bucket int, n int, keys binary, counts binary, once long, twice long, thrice long, fourfold long"
_TOLD = ["counts", "totals", "ones", "twos", "more"]
_ONCE_TO_FOUR = ["once", "twice", "thrice", "fourfold"]
_LABELS, _ANSWERS, _OFTEN = 0, 1, 2


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of full order that ends at each byte and at each text's end, and where each text's begin."""
    rows = len(offsets) - 1
    symbols = np.full(len(data) + rows * ORDER, EDGE, _U)
    symbols[np.arange(len(data)) + ORDER * np.repeat(np.arange(rows), np.diff(offsets)) + ORDER - 1] = data
    grams = symbols.copy()
    for i in range(1, ORDER):
        grams[i:] |= symbols[:-i] << _U(8 * i)
    real = np.ones(len(symbols), bool)
    starts = offsets[:-1] + ORDER * np.arange(rows)
    for i in range(ORDER - 1):
        real[starts + i] = False
    return grams[real], offsets + np.arange(rows + 1)


def event_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, n-grams, and where each row's begin, some megabytes at a time; a very long text comes in several runs."""
    for first, end, part, edge in pieces(data, offsets):
        if len(part) <= 2 * CHUNK_BYTES:
            grams, at = events(part, edge)
            yield first, grams, at
            continue
        for a in range(0, len(part) + 1, CHUNK_BYTES):
            before = part[max(0, a - ORDER + 1) : a]
            run = np.concatenate([np.full(ORDER - 1 - len(before), EDGE, np.uint8), before, part[a : a + CHUNK_BYTES], np.full(int(a + CHUNK_BYTES > len(part)), EDGE, np.uint8)]).astype(_U)
            grams = run[ORDER - 1 :].copy()
            for i in range(1, ORDER):
                grams |= run[ORDER - 1 - i : -i] << _U(8 * i)
            yield first, grams, np.array([0, len(grams)])


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


class Needed:
    """The distinct n-grams of a block's texts, of all orders, in the order in which buckets are asked for them."""

    def __init__(self, docs: pa.Table, trusted: np.ndarray | None, bits: int):
        self.data, self.offsets = text_column(docs["text"])
        found, counted = [], []
        filled = np.diff(self.offsets) > 0
        for first, grams, at in event_runs(self.data, self.offsets):
            counts = trusted is not None and (trusted & filled)[first : first + len(at) - 1]
            codes = grams << _U(1)
            if trusted is not None:
                codes |= np.repeat(counts, np.diff(at)).astype(_U)
            codes.sort()
            heads = np.flatnonzero(np.diff(codes, prepend=~codes[:1]))
            codes, n = codes[heads], np.diff(heads, append=len(codes))
            found.append(codes)
            counted.append(np.where(codes & _U(1), n, 0))
        top, counts = added(np.concatenate(found) >> _U(1), np.concatenate(counted)) if found else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.grams = [top]
        for order in range(ORDER - 1, 0, -1):
            self.grams.append(np.unique(self.grams[-1] & _U((1 << 8 * order) - 1)))
        self.grams.reverse()
        self.keys = np.concatenate([g | (_U(k) << _TAG) for k, g in enumerate(self.grams, 1)])
        self.counts = np.concatenate([np.zeros(len(self.keys) - len(top), np.int64), counts])
        bucket = bucket_of(self.keys, bits)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """All n-grams of a history have one bucket."""
    return B.bucket_of(mix(keys >> _U(8)), bits)


def _trusted(docs: pa.Table, aside: pa.Table) -> np.ndarray:
    """Which of the block's documents the labels trust."""
    if not aside.num_rows:
        return np.zeros(docs.num_rows, bool)
    ids = aside.filter(pc.equal(aside["kind"], _LABELS))["label_id"].combine_chunks()
    return np.array(pc.is_in(docs["doc_id"], value_set=ids.cast(docs["doc_id"].type), skip_nulls=True).to_pylist(), bool)


def _rows(buckets: list[int], spans: list[tuple[int, int]], keys: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    return {
        "bucket": pa.array(buckets, pa.int32()),
        "n": pa.array([b - a for a, b in spans], pa.int32()),
        "keys": pa.array([B.pack_rising(keys[a:b]) for a, b in spans], pa.binary()),
        "counts": pa.array([B.pack_planes(counts[a:b]) for a, b in spans], pa.binary()),
    }


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sizes = table["n"].to_pylist()
    keys = [B.unpack_rising(x, n) for x, n in zip(table["keys"].to_pylist(), sizes)]
    counts = [B.unpack_planes(x, n) for x, n in zip(table["counts"].to_pylist(), sizes)]
    return (np.concatenate(keys), np.concatenate(counts).astype(np.int64)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def _asking(bits: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), **_rows([], [], np.zeros(0, _U), np.zeros(0, _U))})
        needed = Needed(docs, _trusted(docs, aside), bits)
        buckets, spans = B.cuts(needed.bucket)
        return pa.table({"block": pa.array([key[0].as_py()] * len(buckets), pa.int32()), **_rows(buckets, spans, needed.keys[needed.order], needed.counts[needed.order])})

    return run


def _lowering(level: int, bits: int):
    """A bucket's different n-grams of an order, handed on to the next lower one, and how many occur one to four times."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _unpacked(table)
        own = (counts > 0) & (keys >> _TAG == _U(level))
        keys, counts = added(keys[own], counts[own])
        often = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
        shorter = np.zeros(0, _U)
        if level > 1:
            shorter = (keys & _U((1 << 8 * (level - 1)) - 1)) | (_U(level - 1) << _TAG)
        shorter, times = np.unique(shorter, return_counts=True)
        bucket = bucket_of(shorter, bits)
        order = np.argsort(bucket, kind="stable")
        buckets, spans = B.cuts(bucket[order])
        n = len(buckets)
        # the figures come as one more row
        parts = _rows(buckets, spans, shorter[order], times[order])
        extra = {"bucket": None, "n": None, "keys": None, "counts": None}
        return pa.table(
            {
                "kind": pa.array([0] * n + [1], pa.int32()),
                "level": pa.array([level] * (n + 1), pa.int32()),
                **{c: pa.concat_arrays([parts[c], pa.array([extra[c]], parts[c].type)]) for c in extra},
                **{c: pa.array([0] * n + [v], pa.int64()) for c, v in zip(_ONCE_TO_FOUR, often)},
            }
        )

    return run


def _answer(key: tuple, asked: pa.Table, lower: pa.Table) -> pa.Table:
    """A bucket's sums, put to each block's n-grams and their histories in the block's order."""
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in _TOLD)])
    if not asked.num_rows:
        return schema.empty_table()
    keys, counts = _unpacked(asked)
    some = counts > 0
    more = _unpacked(lower) if lower.num_rows else (keys[:0], counts[:0])
    seen, n = added(np.concatenate([keys[some], more[0]]), np.concatenate([counts[some], more[1]]))
    heads = np.flatnonzero(np.diff(seen >> _U(8), prepend=~(seen[:1] >> _U(8))))
    histories = (seen >> _U(8))[heads]
    figures = [np.add.reduceat(x.astype(np.int64), heads) if len(heads) else n[:0] for x in (n, n == 1, n == 2, n > 2)]
    out = {c: [] for c in _TOLD}
    at = 0
    for size in asked["n"].to_pylist():
        own = keys[at : at + size]
        at += size
        out["counts"].append(B.pack_planes(_looked_up(seen, n, own)))
        asked_histories = (own >> _U(8))[history_heads(own)]
        for name, values in zip(_TOLD[1:], figures):
            out[name].append(B.pack_planes(_looked_up(histories, values, asked_histories)))
    return pa.table({"block": asked["block"].cast(pa.int32()), "bucket": asked["bucket"].cast(pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in out.items()}}, schema)


def history_heads(keys: np.ndarray) -> np.ndarray:
    """Where the n-grams of another history begin."""
    return np.flatnonzero(np.diff(keys >> _U(8), prepend=~(keys[:1] >> _U(8))))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def discounts(once: int, twice: int, thrice: int, fourfold: int) -> np.ndarray:
    """What is taken from counts of none, one, two, and three or more, by how many n-grams occur so often."""
    n = [0, once, twice, thrice, fourfold]
    if not once or not twice:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = once / (once + 2 * twice)
    found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found))])


def probabilities(needed: Needed, aside: pa.Table) -> np.ndarray:
    """The interpolated probability of each n-gram of full order that the block needs."""
    told = aside.filter(pc.equal(aside["kind"], _ANSWERS)).sort_by("bucket")
    often = aside.filter(pc.equal(aside["kind"], _OFTEN))["often"].to_pylist()
    cut = {o["level"]: discounts(*(o[c] for c in _ONCE_TO_FOUR)) for o in (often[0] if often else [])}
    asked = needed.keys[needed.order]
    _, spans = B.cuts(needed.bucket)
    heads = [history_heads(asked[a:b]) for a, b in spans]
    counts = np.concatenate([B.unpack_planes(x, b - a) for x, (a, b) in zip(told["counts"].to_pylist(), spans)]).astype(np.int64)
    total, ones, twos, more = (np.concatenate([B.unpack_planes(x, len(h)) for x, h in zip(told[c].to_pylist(), heads)]).astype(float) for c in _TOLD[1:])
    history = np.cumsum(np.concatenate([np.bincount(h, minlength=b - a) for h, (a, b) in zip(heads, spans)])) - 1
    back = np.empty(len(asked), np.int64)
    back[needed.order] = np.arange(len(asked))
    below, at = np.full(1, 1.0 / SYMBOLS), 0
    for level, grams in enumerate(needed.grams, 1):
        own = back[at : at + len(grams)]
        at += len(grams)
        d, c, h = cut.get(level, discounts(0, 0, 0, 0)), counts[own], history[own]
        shorter = below[np.searchsorted(needed.grams[level - 2], grams & _U((1 << 8 * (level - 1)) - 1))] if level > 1 else below[0]
        seen = total[h] > 0
        size = np.where(seen, total[h], 1.0)
        given = np.where(seen, (d[1] * ones[h] + d[2] * twos[h] + d[3] * more[h]) / size, 1.0)
        below = np.maximum(c - d[np.minimum(c, 3)], 0.0) / size + given * shorter
    return below


def _scoring(bits: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        needed = Needed(docs, None, bits)
        logs = np.log10(probabilities(needed, aside))
        sums = np.zeros(docs.num_rows)
        for first, grams, at in event_runs(needed.data, needed.offsets):
            # by rows, so that equal texts have equal sums
            sums[first : first + len(at) - 1] += np.add.reduceat(logs[np.searchsorted(needed.grams[-1], grams)], at[:-1])
        size = np.diff(needed.offsets)
        n = np.where(size > 0, size + 1, 0)
        perplexity = 10 ** (-sums / np.maximum(n, 1))
        return pa.table([docs["doc_id"], docs["lang"], pa.array(n, pa.int64()), pa.array(perplexity, mask=n == 0), pa.array(_trusted(docs, aside))], names=["doc_id", "lang", "n_symbols", "perplexity", "trusted"])

    return run


def perplexities(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_symbols (bytes and the end), perplexity, trusted (a label of quality 1) of every row."""
    fields = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}
    n_blocks = B.count_blocks(docs, block_bytes)
    bits = B.bucket_bits(n_blocks)

    def block(doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(n_blocks)).cast("int")

    aside = f"aside_block int, kind int, label_id {fields['doc_id']}, bucket int, {', '.join(c + ' binary' for c in _TOLD)}, often array<struct<level:int,{','.join(c + ':bigint' for c in _ONCE_TO_FOUR)}>>"
    kinds = dict(x.split(" ", 1) for x in aside.split(", "))

    def beside(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select(*((F.lit(kind) if c == "kind" else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    # rows without an id are dealt by their text: labels don't reach them
    side = docs.select("doc_id", "text", "lang", F.when(F.col("doc_id").isNull(), block(F.col("text"))).otherwise(block(F.col("doc_id"))).alias("block")).groupBy("block")
    trusted = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast(fields["doc_id"]).alias("label_id")).distinct()
    known = beside(trusted.select("label_id", block(F.col("label_id")).alias("aside_block")), _LABELS)

    asked = side.cogroup(known.groupBy("aside_block")).applyInArrow(B.tidy(_asking(bits)), _ASKED)
    lower, rows = [], asked.select("bucket", "n", "keys", "counts")
    for level in range(ORDER, 0, -1):
        lower.append(rows.groupBy("bucket").applyInArrow(_lowering(level, bits), _LOWER))
        rows = lower[-1].where("kind = 0").select("bucket", "n", "keys", "counts")
    every = lower[0]
    for more in lower[1:]:
        every = every.unionByName(more)
    sums = every.where("kind = 0").select(F.col("bucket").alias("lower_bucket"), "n", "keys", "counts")
    answered = asked.groupBy("bucket").cogroup(sums.groupBy("lower_bucket")).applyInArrow(_answer, ", ".join(["block int", "bucket int", *(c + " binary" for c in _TOLD)]))
    often = every.where("kind = 1").groupBy("level").agg(*(F.sum(c).alias(c) for c in _ONCE_TO_FOUR))
    often = often.agg(F.collect_list(F.struct("level", *_ONCE_TO_FOUR)).alias("often")).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("aside_block"), "often")
    told = known.unionByName(beside(answered.withColumnRenamed("block", "aside_block"), _ANSWERS)).unionByName(beside(often, _OFTEN))
    return side.cogroup(told.groupBy("aside_block")).applyInArrow(_empty_or(B.tidy(_scoring(bits)), docs), f"doc_id {fields['doc_id']}, lang {fields['lang']}, n_symbols long, perplexity double, trusted boolean")


def _empty_or(run, docs: DataFrame):
    """A block without documents has no rows."""
    own = [(c, to_arrow_type(docs.schema[c].dataType)) for c in ("doc_id", "lang")]
    schema = pa.schema([*own, ("n_symbols", pa.int64()), ("perplexity", pa.float64()), ("trusted", pa.bool_())])

    def guarded(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        if docs.num_rows:
            return run(key, docs, aside)
        return schema.empty_table()

    return guarded


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept of every row."""
    scored = checkpointed(perplexities(docs, labels, block_bytes))
    known = scored.where("trusted and n_symbols > 0")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    own = known.groupBy(F.col("lang").alias("own_lang")).agg(cut.alias("own_cut"))
    every = known.agg(cut).first()[0]
    limit = F.coalesce("own_cut", F.lit(float("inf") if every is None else float(every)))
    kept = F.coalesce(F.col("perplexity") <= limit, F.lit(False))
    joined = scored.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    return joined.select("doc_id", "lang", "n_symbols", "perplexity", limit.alias("threshold"), kept.alias("kept"))
