"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by scaled forward recursion.

Documents are dealt to blocks. In round 0 the blocks send the counts of their words in the training
documents, packed by buckets of the words' hashes; counters add these up and answer each block about
its own words. In each further round blocks send expected counts of their frequent words in each
state, in the same order and so without the words, and are answered likewise: the vocabulary and the
emission table stay sharded by word, and nothing of their size is broadcast. Starts, transitions and
masses of states (some hundred sums) are added up by themselves and handed back as one row a block.

In the round after the counts a document's latent state is guessed from its most frequent word; each
further round is one iteration of Baum-Welch, by forward and backward recursions over whole documents.
At last every document is scored. Documents of up to LONG tokens are run through side by side; longer
ones are cut into pieces whose transfer matrices are multiplied, which gives the vectors at the cuts,
so that expectations and likelihoods are exact however long a text is.

Expected counts travel as 16-bit shares of a word's occurrences, which are known exactly.

Emissions: a frequent word has its own probability in each state. Rarer words share one for their
frequency class, in which a word's part is its count plus one. Words that training never saw are one
outcome, with the mass of the words seen once (Good-Turing). All of it is mixed with the base
unigram. So each state's emissions sum to 1 over the vocabulary, the end token and the unseen.

Results: a row for each row; null and empty texts are the end token alone; a null doc_id is hashed
as an empty string; repeated rows are trained on and scored as often as they occur; ties between a
document's most frequent words go to the smallest hash; an empty table gives an empty one; without
training words every word is unseen. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import blocks as B
from quarrylight.llm._kernel import LOWER, mix, pieces, runs, span_hash, text_column, words

STATES = 8
ITERATIONS = 2
#: Occurrences from which a word has its own emissions, at every size of the corpus.
FREQUENT_COUNT = 50
UNIGRAM_SHARE = 0.01
#: Tokens up to which a document is run through at once, and of a piece of a longer one.
LONG = 2048
PIECE = 256
BLOCK_BYTES = 16 << 20
END = np.uint64(0x5CA1AB1E0DDBA115)

_POWERS = 1 << np.arange(6)
_CLASSES = len(_POWERS) + 2  # 0: unseen, else one more than the logarithm of the count to base 2; the last: frequent
_ASK = "block int, bucket int, n int, keys binary, counts binary"
_MASSES = "block int, bucket int, masses binary, totals array<double>"
_TOLD = "aside_block int, kind int, round int, bucket int, data binary, totals array<double>"
_COUNTS, _SIZES, _SHARES, _TOTALS = range(4)


def held_out(doc_id: Column) -> Column:
    """Documents that training leaves out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


class Tokens:
    """A block's tokens: place of each among the distinct keys, and where each document's begin."""

    def __init__(self, docs: pa.Table):
        data, offsets = text_column(docs["text"])
        n = len(offsets) - 1
        hashes, counts = [], np.ones(n, np.int64)
        for first, end, part, edge in pieces(data, offsets):
            part = LOWER[part]
            starts, ends, rows = words(part, edge)
            counts[first:end] += np.bincount(rows, minlength=end - first)
            hashes.append(span_hash(runs(part), starts, ends))
        self.edge = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(self.edge[-1], np.uint64)
        is_end = np.zeros(len(flat), bool)
        is_end[self.edge[1:] - 1] = True
        flat[is_end] = END
        flat[~is_end] = np.concatenate(hashes) if hashes else []
        self.keys, self.token = np.unique(flat, return_inverse=True)
        self.training = ~np.array(docs["held_out"].to_pylist(), bool)
        self.document = np.repeat(np.arange(n), counts)

    def guess(self) -> np.ndarray:
        """A state for each document: a hash of its most frequent word (the first in key order of these)."""
        code = self.document * (len(self.keys) + 1) + self.token
        code = code[self.keys[self.token] != END]
        code.sort()
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(code)))
        doc, key = code[new] // (len(self.keys) + 1), code[new] % (len(self.keys) + 1)
        order = np.lexsort((key, -count, doc))
        first = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
        out = np.zeros(len(self.edge) - 1, np.int64)
        out[doc[first]] = (mix(self.keys[key[first]] + np.uint64(77)) % np.uint64(STATES)).astype(np.int64)
        return out


def class_of(counts: np.ndarray) -> np.ndarray:
    """Frequency classes: 0 unseen, 1 for one occurrence, 2 for two or three, ..., the last for frequent words."""
    return np.where(counts >= FREQUENT_COUNT, _CLASSES - 1, np.searchsorted(_POWERS, counts, "right"))


def pack_shares(masses: np.ndarray) -> bytes:
    """Rows of masses as 16-bit shares of their sums, state by state, low bytes before high ones."""
    sums = masses.sum(1, keepdims=True)
    shares = np.rint(masses / np.where(sums > 0, sums, 1) * 65535).astype("<u2")
    return np.ascontiguousarray(shares.T).view(np.uint8).reshape(STATES, -1, 2).transpose(0, 2, 1).tobytes()


def unpack_shares(packed: bytes, sums: np.ndarray) -> np.ndarray:
    """The masses, whose sums are known."""
    planes = np.frombuffer(packed, np.uint8).reshape(STATES, 2, -1).transpose(0, 2, 1)
    shares = np.ascontiguousarray(planes).view("<u2")[:, :, 0].T.astype(float)
    whole = shares.sum(1)
    return shares * (sums / np.where(whole > 0, whole, 1))[:, None]


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks that ask a bucket, by block: their numbers and where their words begin; place of each word among the distinct ones, its count in the block, all counts."""
    sizes = table["n"].to_pylist()
    keys = np.concatenate([B.unpack_rising(x, n) for x, n in zip(table["keys"].to_pylist(), sizes)])
    counts = np.concatenate([B.unpack_planes(x, n) for x, n in zip(table["counts"].to_pylist(), sizes)]).astype(np.int64)
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, counts, len(distinct)).astype(np.int64)
    return table["block"].to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), place, counts, total


def _told(kind: int, blocks: list[int], bucket: int | None, data: list[bytes | None], totals: list[list[float] | None]) -> pa.Table:
    n = len(blocks)
    columns = [pa.array(blocks, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([None] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(data, pa.binary()), pa.array(totals, pa.list_(pa.float64()))]
    return pa.table(columns, names=["aside_block", "kind", "round", "bucket", "data", "totals"])


def _tell_counts(table: pa.Table) -> pa.Table:
    """A bucket in round 0: the words' counts, answered to each block."""
    block, cut, place, _, total = _asked(table)
    data = [B.pack_planes(total[place[a:b]]) for a, b in zip(cut, cut[1:])]
    return _told(_COUNTS, block.tolist(), table["bucket"][0].as_py(), data, [None] * len(data))


def _sizes(table: pa.Table) -> pa.Table:
    """A bucket in round 0: how many words each frequency class has, and the sums of their counts plus one."""
    total = _asked(table)[4]
    group = class_of(total)
    size = np.concatenate([np.bincount(group, minlength=_CLASSES), np.bincount(group, total + 1, _CLASSES)])
    return _told(_SIZES, [0], None, [None], [size.astype(float).tolist()])


def _tell_shares(key: tuple, asked: pa.Table, sent: pa.Table) -> pa.Table:
    """A bucket in a later round: sums of the expected counts of each frequent word, answered to each block that has it."""
    if not asked.num_rows:
        return _told(_SHARES, [], None, [], [])
    block, cut, place, counts, total = _asked(asked)
    frequent = total >= FREQUENT_COUNT
    own = {}
    if sent.num_rows:
        own = {b: m for b, m in zip(sent["sent_block"].to_pylist(), sent["masses"].to_pylist()) if m}
    sums = np.zeros((len(total), STATES))
    for b, at, end in sorted(zip(block.tolist(), cut, cut[1:])):  # in one order, so that sums are the same every time
        if b in own:
            here = np.flatnonzero(frequent[place[at:end]] & (counts[at:end] > 0)) + at
            sums[place[here]] += unpack_shares(own[b], counts[here].astype(float))  # a block's words are distinct
    out = [(b, place[at:end][frequent[place[at:end]]]) for b, at, end in zip(block.tolist(), cut, cut[1:])]
    out = [(b, p) for b, p in out if len(p)]
    return _told(_SHARES, [b for b, _ in out], asked["bucket"][0].as_py(), [pack_shares(sums[p]) for _, p in out], [None] * len(out))


def _sum_totals(table: pa.Table) -> pa.Table:
    totals = [np.array(t) for t in table.sort_by("sent_block")["totals"].to_pylist() if t is not None]
    return _told(_TOTALS, [0] * bool(totals), None, [None] * bool(totals), [np.sum(totals, axis=0).tolist()] if totals else [])


class Told:
    """What a block has been told of its words in round 0 and in the last round."""

    def __init__(self, keys: np.ndarray, aside: pa.Table, bits: int, last: int):
        buckets, spans = B.cuts(B.bucket_of(keys, bits))
        counts = self._by_bucket(aside, _COUNTS, 0)
        self.counts = np.concatenate([B.unpack_planes(counts[u], b - a) for u, (a, b) in zip(buckets, spans)]).astype(np.int64)
        sizes = self._totals(aside, _SIZES, 0).reshape(2, _CLASSES)
        self.vocabulary, self.class_sum = int(sizes[0, 1:].sum()), sizes[1]
        self.tokens = int((sizes[1] - sizes[0]).sum())
        self.group = class_of(self.counts)
        self.frequent = self.group == _CLASSES - 1
        if last:
            shares = self._by_bucket(aside, _SHARES, last)
            own = [(shares[u], self.counts[a:b][self.frequent[a:b]]) for u, (a, b) in zip(buckets, spans) if self.frequent[a:b].any()]
            self.masses = np.concatenate([unpack_shares(x, c.astype(float)) for x, c in own]) if own else np.zeros((0, STATES))
            self.totals = Totals(self._totals(aside, _TOTALS, last))

    @staticmethod
    def _rows(aside: pa.Table, kind: int, number: int) -> pa.Table:
        return aside.filter(pc.and_(pc.equal(aside["kind"], kind), pc.equal(aside["round"], number)))

    def _by_bucket(self, aside: pa.Table, kind: int, number: int) -> dict[int, bytes]:
        rows = self._rows(aside, kind, number)
        return dict(zip(rows["bucket"].to_pylist(), rows["data"].to_pylist()))

    def _totals(self, aside: pa.Table, kind: int, number: int) -> np.ndarray:
        return np.array(self._rows(aside, kind, number)["totals"][0].as_py())

    def base(self) -> np.ndarray:
        """Unigram probabilities of the block's words."""
        return (self.counts + 1) / (self.tokens + 1 * (self.vocabulary + 1))

    def emissions(self) -> np.ndarray:
        """Probabilities of the block's words in each state."""
        group, frequent = self.group, self.frequent
        mass = self.totals.mass + 1e-9
        out = np.zeros((len(self.counts), STATES))
        out[frequent] = self.masses / mass
        rare = (group > 0) & ~frequent
        share = self.totals.classes / mass  # of each class in each state
        out[rare] = share[group[rare]] * ((self.counts[rare] + 1) / self.class_sum[group[rare]])[:, None]
        out[group == 0] = share[1]
        out /= 1 + share[1]
        return (1 - UNIGRAM_SHARE) * out + UNIGRAM_SHARE * self.base()[:, None]


class Totals:
    """Expected counts that all blocks share: starts, transitions, masses of states, of classes in states."""

    def __init__(self, values: np.ndarray | None = None):
        values = np.zeros(STATES * (2 + STATES + _CLASSES)) if values is None else values
        self.values = values
        self.start = values[:STATES]
        self.mass = values[STATES : 2 * STATES]
        self.step = values[2 * STATES : (2 + STATES) * STATES].reshape(STATES, STATES)
        self.classes = values[(2 + STATES) * STATES :].reshape(_CLASSES, STATES)

    def probabilities(self) -> tuple[np.ndarray, np.ndarray]:
        start = self.start + 1.0
        step = self.step + 0.1 + 10.0 * np.eye(STATES)
        return start / start.sum(), step / step.sum(1, keepdims=True)


class Sequences:
    """Documents, and pieces of those over LONG tokens, longest first: start, length, document, number of the piece."""

    def __init__(self, edge: np.ndarray, documents: np.ndarray):
        size = np.diff(edge)[documents]
        n = np.where(size > LONG, -(-size // PIECE), 1)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        head = np.repeat(edge[:-1][documents], n) + PIECE * number
        whole = np.repeat(size <= LONG, n)
        length = np.where(whole, np.repeat(size, n), np.minimum(PIECE, np.repeat(edge[1:][documents], n) - head))
        order = np.argsort(-length, kind="stable")
        self.head, self.length, self.document, self.number = head[order], length[order], np.repeat(documents, n)[order], number[order]
        self.piece = ~whole[order]

    def __len__(self) -> int:
        return len(self.head)

    def only(self, which: np.ndarray) -> Sequences:
        out = object.__new__(Sequences)
        out.head, out.length, out.document, out.number, out.piece = (x[which] for x in (self.head, self.length, self.document, self.number, self.piece))
        return out

    def active(self) -> list[int]:
        """For each place how many sequences are longer."""
        return np.searchsorted(-self.length, -np.arange(int(self.length[0]) if len(self) else 0), "left").tolist()

    def turns(self) -> list[np.ndarray]:
        """The first pieces of all documents, their second pieces, ..."""
        by = np.argsort(self.number, kind="stable")
        cut = np.searchsorted(self.number[by], np.arange(int(self.number.max(initial=-1)) + 2)).tolist()
        return [by[a:b] for a, b in zip(cut, cut[1:])]


def transfers(tokens: Tokens, emissions: np.ndarray, step: np.ndarray, pieces: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """Each piece as a matrix from the state before it to its last one, scaled, and the logarithm of the scale; a document's first piece has no step before it."""
    matrix = np.where((pieces.number == 0)[:, None, None], np.eye(STATES), step) * emissions[tokens.token[pieces.head]][:, None, :]
    scale = np.zeros(len(pieces))
    for t, n in enumerate(pieces.active()):
        if t:
            matrix[:n] = (matrix[:n].reshape(-1, STATES) @ step).reshape(n, STATES, STATES) * emissions[tokens.token[pieces.head[:n] + t]][:, None, :]
        c = matrix[:n].sum((1, 2))
        matrix[:n] /= c[:, None, None]
        scale[:n] += np.log10(c)
    return matrix, scale


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / rows.sum(1, keepdims=True)


def boundaries(tokens: Tokens, emissions: np.ndarray, start: np.ndarray, step: np.ndarray, pieces: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece the forward vector before it (the start, or that of the last token before) and the backward vector at its last token."""
    matrix, _ = transfers(tokens, emissions, step, pieces)
    before, after = np.tile(start, (len(pieces), 1)), np.ones((len(pieces), STATES))
    row = {"forward": np.tile(start, (len(tokens.edge), 1)), "backward": np.ones((len(tokens.edge), STATES))}
    for at in pieces.turns():
        doc = pieces.document[at]
        before[at] = row["forward"][doc]
        row["forward"][doc] = _unit(np.einsum("ij,ijk->ik", before[at], matrix[at]))
    for at in reversed(pieces.turns()):
        doc = pieces.document[at]
        after[at] = row["backward"][doc]
        row["backward"][doc] = _unit(np.einsum("ijk,ik->ij", matrix[at], after[at]))
    return before, after


def expectations(tokens: Tokens, emissions: np.ndarray, start: np.ndarray, step: np.ndarray, totals: Totals) -> np.ndarray:
    """Posterior of each training token's state, by scaled forward and backward recursions; adds to the totals."""
    run = Sequences(tokens.edge, np.flatnonzero(tokens.training))
    posterior = np.zeros((len(tokens.token), STATES), np.float32)
    if not len(run):
        return posterior
    before, beta = np.tile(start, (len(run), 1)), np.ones((len(run), STATES))
    cut = np.flatnonzero(run.piece)
    before[cut], beta[cut] = boundaries(tokens, emissions, start, step, run.only(cut))
    later = np.flatnonzero(run.number > 0)
    entry = before.copy()
    entry[later] = before[later] @ step
    active = run.active()
    scale = np.ones(len(tokens.token))
    alpha = entry * emissions[tokens.token[run.head]]
    for t, n in enumerate(active):
        at = run.head[:n] + t
        if t:
            alpha = (alpha[:n] @ step) * emissions[tokens.token[at]]
        c = alpha.sum(1)
        alpha /= c[:, None]
        scale[at] = c
        posterior[at] = alpha
    last = run.head + run.length - 1
    ends = posterior[last].astype(float)
    beta /= (ends * beta).sum(1, keepdims=True)
    posterior[last] = ends * beta
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        at = run.head[:n] + t
        ahead = emissions[tokens.token[at]] * beta[:n] / scale[at][:, None]
        here = posterior[at - 1].astype(float)
        totals.step += here.T @ ahead * step
        beta[:n] = ahead @ step.T
        posterior[at - 1] = here * beta[:n]
    at = run.head[later]
    totals.step += before[later].T @ (emissions[tokens.token[at]] * beta[later] / scale[at][:, None]) * step  # from piece to piece
    totals.start += posterior[run.head[run.number == 0]].sum(0)
    return posterior


def likelihood(tokens: Tokens, emissions: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """log10 probability of each document: the forward recursion, over products of pieces for long ones."""
    n_docs = len(tokens.edge) - 1
    every, out = Sequences(tokens.edge, np.arange(n_docs)), np.zeros(n_docs)
    run = every.only(~every.piece)
    alpha = start * emissions[tokens.token[run.head]]
    for t, n in enumerate(run.active()):
        if t:
            alpha = (alpha[:n] @ step) * emissions[tokens.token[run.head[:n] + t]]
        c = alpha.sum(1)
        alpha /= c[:, None]
        out[run.document[:n]] += np.log10(c)
    cut = every.only(every.piece)
    matrix, scale = transfers(tokens, emissions, step, cut)
    out += np.bincount(cut.document, scale, n_docs)
    row = np.tile(start, (n_docs, 1))
    for at in cut.turns():
        doc = cut.document[at]
        row[doc] = np.einsum("ij,ijk->ik", row[doc], matrix[at])
        c = row[doc].sum(1)
        row[doc] /= c[:, None]
        out[doc] += np.log10(c)
    return out


def _counting(bits: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        tokens = Tokens(docs)
        counts = np.bincount(tokens.token[tokens.training[tokens.document]], minlength=len(tokens.keys))
        buckets, spans = B.cuts(B.bucket_of(tokens.keys, bits))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(buckets), pa.int32()),
                "bucket": pa.array(buckets, pa.int32()),
                "n": pa.array([b - a for a, b in spans], pa.int32()),
                "keys": pa.array([B.pack_rising(tokens.keys[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([B.pack_planes(counts[a:b]) for a, b in spans], pa.binary()),
            }
        )

    return run


def _expecting(bits: int, last: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        tokens = Tokens(docs)
        told, totals = Told(tokens.keys, aside, bits, last), Totals()
        on = tokens.training[tokens.document]
        if last:
            posterior = expectations(tokens, told.emissions(), *told.totals.probabilities(), totals)
        else:
            state = tokens.guess()
            posterior = np.zeros((len(tokens.token), STATES), np.float32)
            posterior[on, state[tokens.document[on]]] = 1
            totals.start += np.bincount(state[tokens.training], minlength=STATES)
            totals.step += np.diag(posterior.sum(0))
        mass = np.stack([np.bincount(tokens.token[on], posterior[on, s], len(tokens.keys)) for s in range(STATES)], 1)
        totals.mass += mass.sum(0)
        for c in range(_CLASSES):
            totals.classes[c] += mass[told.group == c].sum(0)
        block, (buckets, spans) = key[0].as_py(), B.cuts(B.bucket_of(tokens.keys, bits))
        own = told.frequent & (np.bincount(tokens.token[on], minlength=len(tokens.keys)) > 0)
        sent = [(u, pack_shares(mass[a:b][own[a:b]])) for u, (a, b) in zip(buckets, spans) if own[a:b].any()]
        sent.append((block % (1 << bits), None))  # the totals go along with some bucket's rows
        return pa.table(
            {
                "block": pa.array([block] * len(sent), pa.int32()),
                "bucket": pa.array([u for u, _ in sent], pa.int32()),
                "masses": pa.array([m for _, m in sent], pa.binary()),
                "totals": pa.array([None] * (len(sent) - 1) + [totals.values.tolist()], pa.list_(pa.float64())),
            }
        )

    return run


def _scoring(bits: int, last: int):
    def run(key: tuple, docs: pa.Table, aside: pa.Table) -> pa.Table:
        tokens = Tokens(docs)
        told, n = Told(tokens.keys, aside, bits, last), len(docs)
        base = np.bincount(tokens.document, np.log10(told.base())[tokens.token], n)
        known = np.bincount(tokens.document, told.counts[tokens.token] > 0, n).astype(np.int64)
        score = likelihood(tokens, told.emissions(), *told.totals.probabilities())
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": docs["held_out"],
                "n_tokens": pa.array(np.diff(tokens.edge)),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, told.tokens)),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    return run


def score(docs: DataFrame, iterations: int = ITERATIONS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_blocks = B.count_blocks(docs, block_bytes)
    bits = B.bucket_bits(n_blocks)
    side = B.dealt(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), n_blocks, F.struct("doc_id", F.xxhash64("text"))).groupBy("block")

    def with_side(aside: DataFrame, run, schema: str) -> DataFrame:
        return side.cogroup(aside.groupBy("aside_block")).applyInArrow(B.tidy(run), schema)

    def for_all(parts: DataFrame, number: int) -> DataFrame:
        """The sum of rows of totals, to every block; by decimals, so that their order doesn't matter."""
        each = parts.select("kind", F.posexplode("totals").alias("at", "value")).groupBy("kind", "at").agg(F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("value"))
        whole = each.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("totals"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("data", "binary"))]
        return whole.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("aside_block"), "kind", F.lit(number).alias("round"), *none, "totals")

    def told(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("round", F.lit(number)).select(*(x.split()[0] for x in _TOLD.split(", ")))

    nothing = docs.sparkSession.createDataFrame([], "aside_block int")
    asked = with_side(nothing, _counting(bits), _ASK)
    by_bucket = asked.groupBy("bucket")
    counts = told(by_bucket.applyInArrow(_tell_counts, _TOLD), 0).unionByName(for_all(by_bucket.applyInArrow(_sizes, _TOLD), 0))
    aside = counts
    for number in range(1, iterations + 2):
        sent = with_side(aside, _expecting(bits, number - 1), _MASSES).select(F.col("block").alias("sent_block"), F.col("bucket").alias("sent_bucket"), "masses", "totals")
        shares = told(by_bucket.cogroup(sent.groupBy("sent_bucket")).applyInArrow(_tell_shares, _TOLD), number)
        aside = counts.unionByName(shares).unionByName(for_all(sent.groupBy("sent_bucket").applyInArrow(_sum_totals, _TOLD), number))
    return with_side(aside, _scoring(bits, iterations + 1), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
