"""Personal data, and the terms that give it away.

Base spans (email, ip, card, phone) are found by patterns. Around each stand the words of its
context; over the corpus these tell, for each term and each protected value, how much seeing the
term reveals the value: P(value | term), counted over all different texts that have the term, and
the information log2 P(value | term) / P(value). A term that is over both thresholds, in several
texts or wherever it stands at all, becomes a span too. A term that mostly stands with its value is
removed; another one is generalised: its place is taken by a broader term, one that goes along with
it in contexts, stands in more of them and discloses nothing itself ([TERM] if there is none).

Texts are told apart by hash, and copies of a text count once. Terms are words without marks at
their ends, in lower case; they are counted by 64-bit hashes of their bytes. Which words of the
corpus are candidates at all is seen in a bit map of fixed size, which may let others through; an
exact join follows.

Results: null and empty texts have no spans and the digest of an empty list; repeated rows give a
row each; a null doc_id stays null; an empty table gives an empty one; long texts are taken one by
one; of values that a term tells equally well any will do, as the term is the same; only doc_id and
text are read by `find`, and `sanitise` keeps all columns, whatever their names. Spans are of code
points in the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._kernel import pieces, runs, span_hash, sums_by_row, text_column, words
from quarrylight.llm._shared import checkpointed
from quarrylight.llm.blocks import released

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words of context on each side of a span; different texts that must show a term beside a value, unless it stands
#: nowhere else; least share and information at which a term discloses it; share from which it is removed, not generalised.
CONTEXT_WORDS = 8
MIN_CONTEXTS = 3
MIN_SHARE = 0.5
MIN_BITS = 6.0
REMOVE_SHARE = 0.9
#: Share of a term's contexts that a broader term has.
BROADER_SHARE = 0.8
#: Terms up to which the list is broadcast (16 bytes each); a longer one is joined.
BROADCAST_TERMS = 4_000_000
#: Bits of the map of candidate terms (16 MB).
MAP_BITS = 27

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-"
_EDGES = np.zeros(256, bool)
_EDGES[[ord(c) for c in _EDGE]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[d] for d in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the whole pattern, left to right, found from their @ signs in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str, digits: int | None = None) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of all base spans, in order; `digits`: how many 0-9 the text has, if known."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    digits = 99 if digits is None else digits
    if digits >= 4 and "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if digits >= 14:
        for m in _CARD.finditer(text):
            number = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and luhn(number):
                out.append((m.start(), 2, m.end()))
    if digits >= 10 and "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def value_of(kind: int, text: str) -> str:
    """A protected value, alike however it is written."""
    return f"{KINDS[kind]}:{text.lower() if kind < 2 else re.sub('[^0-9]', '', text)}"


def term_of(word: str) -> str | None:
    """The term that a word stands for: the word in lower case, without marks at its ends."""
    bare = word.strip(_EDGE)
    return (bare.lower() if bare.isascii() else pc.utf8_lower(pa.scalar(bare)).as_py()) or None


def term_hashes(terms: list[str]) -> np.ndarray:
    data, offsets = text_column(pa.array(terms, pa.string()))
    return span_hash(runs(data), offsets[:-1], offsets[1:])


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first and end row, and the term hash, row and place in its row of each word that has a term."""
    for first, end, data, offsets in pieces(*text_column(pc.utf8_lower(column))):
        starts, ends, rows = words(data, offsets)
        place = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=end - first))])[rows]
        edge = np.append(_EDGES[data], False)
        while (off := edge[starts] & (starts < ends)).any():
            starts = starts + off
        while (off := edge[ends - 1] & (starts < ends)).any():
            ends = ends - off
        own = starts < ends
        yield first, end, span_hash(runs(data), starts[own], ends[own]), rows[own], place[own]


def _outside(found: Iterator[re.Match], base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The matches, in order, that overlap no base span."""
    starts = [a for a, _, _ in base]
    reach = np.maximum.accumulate([b for _, _, b in base]).tolist()
    for m in found:
        i = bisect_left(starts, m.end())  # the base spans that begin before the word ends
        if not i or reach[i - 1] <= m.start():
            yield m


def contexts(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[str, str | None]]:
    """The different (value, term of its context) of a text, and (value, None); other spans are no context."""
    out: set[tuple[str, str | None]] = set()
    if not spans:
        return out
    found = [m for m in _WORD.finditer(text)]
    starts = [m.start() for m in found]
    private = np.zeros(len(found), bool)
    where = []
    for a, _, b in spans:
        i, j = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        private[max(i, 0) : j] = True
        where.append((max(i, 0), j))
    for (a, kind, b), (i, j) in zip(spans, where):
        near = [k for k in [*range(max(0, i - CONTEXT_WORDS), i), *range(j, min(len(found), j + CONTEXT_WORDS))] if not private[k]]
        value = value_of(kind, text[a:b])
        out.add((value, None))
        out.update((value, t) for k in near if (t := term_of(found[k][0])))
    return out


def _portions(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some megabytes of text; memory is released after each batch that came in."""
    for batch in batches:
        for first, end, _, _ in pieces(*text_column(batch.column(at))):
            yield batch.slice(first, end - first)
        released()


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[str, int]]:
    data, offsets = text_column(batch.column(at))
    for text, digits in zip(batch.column(at).to_pylist(), sums_by_row(_DIGIT[data], offsets).tolist()):
        yield text or "", digits


def associations(docs: DataFrame) -> DataFrame:
    """value, term, term_hash, hash: the hashes of the texts that show a term beside a value (null: the value at all), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 0):
            rows = [(value, term, h) for (text, digits), h in zip(_texts(batch, 0), batch.column(1).to_pylist()) for value, term in contexts(text, base_spans(text, digits))]
            hashes = term_hashes([r[1] or "" for r in rows]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(hashes), pa.array([r[2] for r in rows], pa.int64())], ["value", "term", "term_hash", "hash"])

    return docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(run, "value string, term string, term_hash long, hash long").distinct()


def bit_map(terms: DataFrame) -> np.ndarray:
    """A map of 2**MAP_BITS bits in which the terms' hashes (term_hash) have theirs set."""
    bit = F.shiftrightunsigned("term_hash", 64 - MAP_BITS)
    slots = terms.groupBy(F.shiftrightunsigned(bit, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term_hash, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return out


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - MAP_BITS)
    return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term_hash, hash: the texts' words that are among the terms (term_hash), once a text and run of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_hash = batch.column(1).to_numpy()
            for first, _, hashes, rows, _ in word_hashes(batch.column(0)):
                own = _in_map(shared.value, hashes)
                code = np.unique(np.stack([rows[own].astype(np.uint64), hashes[own]], 1), axis=0) if own.any() else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(code[:, 1]).view(np.int64)), pa.array(text_hash[first + code[:, 0].astype(np.int64)])], ["term_hash", "hash"])
            released()

    found = docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(run, "term_hash long, hash long")
    return found.join(terms.select("term_hash").distinct(), "term_hash", "left_semi")


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, term_hash, share, bits, broader: terms that reveal a protected value, by the value that each tells most of.

    A value's probability and a term's are counted over all different texts. Candidates are the terms
    whose contexts leave them a chance; how many texts have them is counted over the whole corpus.
    """
    n_texts = max(docs.select(F.xxhash64("text")).distinct().count(), 1)
    seen = checkpointed(associations(docs))
    beside = seen.where("term is not null")
    values = seen.where("term is null").groupBy("value").agg(F.count("*").alias("n_value"))
    pairs = beside.groupBy("value", "term").agg(F.min("term_hash").alias("term_hash"), F.count("*").alias("n_both"))
    near = beside.select("term", "hash").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    known = F.log2(F.lit(n_texts) / F.col("n_value"))  # what a value's name would tell
    may = (F.col("n_both") >= MIN_SHARE * F.col("n_near")) & ((F.col("n_both") >= MIN_CONTEXTS) | (F.col("n_both") == F.col("n_near")))
    found = checkpointed(pairs.join(near, "term").where(may).join(values, "value").where(known >= MIN_BITS))
    # a candidate of one text: is that the only text that has it? of several: how many have it?
    single, several = found.where("n_both = 1"), found.where("n_both > 1")
    alone = occurrences(docs, single).groupBy("term_hash").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low = high").select("term_hash", F.lit(1).cast("long").alias("n_term"))
    often = occurrences(docs, several).distinct().groupBy("term_hash").agg(F.count("*").alias("n_term"))
    counted = single.join(alone, "term_hash").unionByName(several.join(often, "term_hash"))
    share = F.col("n_both") / F.col("n_term")
    bits = F.log2(share * F.lit(n_texts) / F.col("n_value"))
    over = (share >= MIN_SHARE) & (bits >= MIN_BITS) & ((F.col("n_both") >= MIN_CONTEXTS) | (share == 1))
    told = checkpointed(counted.where(over).groupBy("term").agg(F.min("term_hash").alias("term_hash"), F.max(share).alias("share"), F.max(bits).alias("bits")))
    return told.join(_broader(beside, near, told), "term", "left")


def _broader(beside: DataFrame, near: DataFrame, told: DataFrame) -> DataFrame:
    """term, broader: for the terms that aren't removed, the narrowest of the terms that subsume them in contexts."""
    weak = told.where(F.col("share") < REMOVE_SHARE).select("term")
    of_weak = beside.join(weak, "term", "left_semi").select("term", "hash").distinct()
    others = beside.select(F.col("term").alias("broader"), "hash").distinct().join(told.select(F.col("term").alias("broader")), "broader", "left_anti")
    both = of_weak.join(others, "hash").groupBy("term", "broader").agg(F.count("*").alias("n"))
    sized = both.join(near, "term").join(near.select(F.col("term").alias("broader"), F.col("n_near").alias("n_broader")), "broader")
    fits = sized.where((F.col("n") >= BROADER_SHARE * F.col("n_near")) & (F.col("n_broader") > F.col("n_near")))
    return fits.groupBy("term").agg(F.min_by("broader", F.struct("n_broader", "broader")).alias("broader"))


class Terms:
    """Disclosing terms by hash: shares, and what takes the place of those that are generalised."""

    def __init__(self, hashes: np.ndarray, shares: np.ndarray, broader: list[str | None]):
        order = np.argsort(hashes)
        self.hashes, self.shares = hashes[order], shares[order].astype(np.float32)
        self.broader = {int(h): b for h, b, s in zip(hashes.tolist(), broader, shares.tolist()) if b is not None and s < REMOVE_SHARE}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def instead(self, h: int) -> str:
        share = self.shares[np.searchsorted(self.hashes, np.uint64(h))]
        return "" if share >= np.float32(REMOVE_SHARE) else self.broader.get(h, "[TERM]")


def _hashed(terms: DataFrame) -> DataFrame:
    """term_hash, share, broader of given terms (term, share and, if there is one, broader)."""
    broader = F.col("broader") if "broader" in terms.columns else F.lit(None).cast("string").alias("broader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(term_hashes(batch.column(0).to_pylist()).view(np.int64)), batch.column(1), batch.column(2)], ["term_hash", "share", "broader"])

    return terms.where("term is not null").select("term", F.col("share").cast("double"), broader).mapInArrow(run, "term_hash long, share double, broader string")


def _bounded(terms: DataFrame) -> Terms | None:
    """The terms, if they are few enough to be broadcast, else None."""
    if terms.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return None
    rows = terms.toArrow()
    return Terms(rows["term_hash"].to_numpy().view(np.uint64), rows["share"].to_numpy(), rows["broader"].to_pylist())


def _with_terms(docs: DataFrame, terms: DataFrame | None):
    """The documents, and the terms as a broadcast if they fit one; else each document has its own terms in a last column."""
    terms = checkpointed(_hashed(disclosing_terms(docs.select("text")) if terms is None else terms))
    wanted = _bounded(terms)
    if wanted is not None:
        return docs, docs.sparkSession.sparkContext.broadcast(wanted)
    name = "pii_terms"
    while name in docs.columns:
        name += "_"
    own = occurrences(docs.select("text"), terms).distinct().join(terms, "term_hash").groupBy("hash").agg(F.collect_list(F.struct("term_hash", "share", "broader")).alias(name))
    return docs.withColumn(name + "_key", F.xxhash64("text")).join(own.withColumnRenamed("hash", name + "_key"), name + "_key", "left").drop(name + "_key"), None


def _own(column: pa.Array) -> Terms:
    """The terms of a portion's documents."""
    rows = [t for own in column.to_pylist() for t in own or []]
    unique = list({t["term_hash"]: t for t in rows}.values())
    return Terms(np.array([t["term_hash"] for t in unique], np.int64).view(np.uint64), np.array([t["share"] for t in unique], float), [t["broader"] for t in unique])


def _all_spans(batch: pa.RecordBatch, at: int, terms: Terms) -> Iterator[tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]], dict[int, int]]]:
    """Of each text: the text, base spans, all spans (a term that overlaps a base span gives way), and the hash of the term that begins at a place."""
    hits: dict[int, dict[int, int]] = {}
    for first, _, hashes, rows, place in word_hashes(batch.column(at)):
        own = terms.find(hashes)
        for r, k, h in zip((rows[own] + first).tolist(), place[own].tolist(), hashes[own].tolist()):
            hits.setdefault(r, {})[k] = h
    for i, (text, digits) in enumerate(_texts(batch, at)):
        base, more, which = base_spans(text, digits), [], {}
        if i in hits:
            told = {m.start(): hits[i][k] for k, m in enumerate(_WORD.finditer(text)) if k in hits[i]}
            for m in _outside((m for m in _WORD.finditer(text) if m.start() in told), base):
                more.append((m.start(), 4, m.end()))
                which[m.start()] = told[m.start()]
        yield text, base, sorted(base + more) if more else base, which


def find(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_term of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, shared = _with_terms(docs.select("doc_id", "text"), terms)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 1):
            counts, digest, spans = [], [], []
            for _, base, every, _ in _all_spans(batch, 1, shared.value if shared else _own(batch.column(2))):
                counts.append([sum(s[1] == k for s in every) for k in range(5)])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            kinds = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kinds[:4], pa.array(digest, pa.string()), pa.array(spans, pa.string()), kinds[4]], names)

    return docs.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def cleaned(text: str, spans: list[tuple[int, int, int]], which: dict[int, int], terms: Terms) -> str:
    """The text with base spans as [EMAIL], ..., strong terms removed and other terms generalised."""
    out, done = [], 0
    for start, kind, end in spans:
        if end <= done:
            continue
        out.append(text[done : max(start, done)])
        out.append(terms.instead(which[start]) if kind == 4 else f"[{KINDS[kind].upper()}]")
        done = end
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The documents with all their columns, personal data and disclosing terms taken out of the texts; null texts stay null."""
    columns = docs.columns
    docs, shared = _with_terms(docs, terms)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, at):
            own = shared.value if shared else _own(batch.column(batch.num_columns - 1))
            null = batch.column(at).is_null().to_pylist()
            texts = [None if n else cleaned(text, every, which, own) for n, (text, _, every, which) in zip(null, _all_spans(batch, at, own))]
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes[: len(columns)]))
