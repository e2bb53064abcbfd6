"""BPE encoding and decoding with a memory-mapped minimal acyclic transducer as lexicon.

`encode` counts the pre-tokens of the corpus, compiles the most frequent ones into a minimal
acyclic automaton whose paths add up to the number of the word, stores that number's ids beside
it, and sends the file to the executors, which map it into memory. A word is looked up there
once in a task; a word that the lexicon lacks is merged exactly, pair by pair in order of rank.

Results: a null text counts as empty; an empty text has no ids (n_tokens 0, digests of the empty
string); repeated rows and repeated doc_ids give a row each; an empty table gives an empty one;
a null doc_id stays null; other columns are not read. Texts are encoded whole, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._kernel import pieces, ranges, runs, span_hash, words
from quarrylight.llm.blocks import frugal

#: Most words that the lexicon holds, and so its proven size bound: a few MB.
LEXICON_WORDS = 65_536
#: Entries that a worker keeps of what it has encoded, and entries that a task counts before it hands them on.
CACHE_WORDS = 500_000
COUNTED_WORDS = 400_000

#: Rank of a pair that no merge joins; bytes of a word up to which words are merged many at a time.
_NEVER = np.iinfo(np.int32).max
_SHORT = 48

#: Separators of str.split() that the pattern doesn't take as white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PLAIN_SPACE = dict.fromkeys([9, 10, 11, 12, 13], " ")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """Ids, merges and text rules of a tokenizer file of the kind `word_bpe_49k.json`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + end] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))
        pairs = sorted(self.merges)
        self.pair_keys = np.array([*pairs, 1 << 62], np.int64)
        self.pair_rank = np.array([*(self.merges[k][0] for k in pairs), _NEVER], np.int32)
        self.pair_new = np.array([*(self.merges[k][1] for k in pairs), 0], np.int64)
        self.ends = np.array([self.inner, self.final], np.int64)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def parts(self, text: str) -> list[str | int]:
        """The normalised parts of a text between special tokens, and the ids of those."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out.append(part.lower())
            else:
                out.append(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a run without ASCII white space; most runs are letters and perhaps a mark."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the adjacent pair of lowest rank, the leftmost of these, is joined until none is left."""
        raw = word.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(a << 20 | b) for a, b in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p[0] < best):
                    best, at = p[0], i
            if best is None:
                return ids
            new = pairs[at][1]
            ids[at : at + 2] = [new]
            del pairs[at]
            if at:
                pairs[at - 1] = get(ids[at - 1] << 20 | new)
            if at < len(pairs):
                pairs[at] = get(new << 20 | ids[at + 1])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges; the last place stands for none."""
        keys = left << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def merge_table(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of one length, a row of bytes each: all words take their next merge together."""
        ids = self.ends[0][table]
        ids[:, -1] = self.ends[1][table[:, -1]]
        m, width = ids.shape
        lengths = np.full(m, width)
        if width == 1:
            return ids, lengths
        place = self._ranks(ids[:, :-1], ids[:, 1:])
        rank = self.pair_rank[place]
        live = np.arange(m)
        while True:
            at = rank[live].argmin(axis=1)
            on = rank[live, at] != _NEVER
            live, at = live[on], at[on]
            if not len(live):
                return ids, lengths
            new = self.pair_new[place[live, at]]
            for array, frm in ((ids, 1), (rank, 0), (place, 0)):
                part = array[live]
                part[:, :-1] = np.where(np.arange(part.shape[1] - 1) >= (at + frm)[:, None], part[:, 1:], part[:, :-1])
                array[live] = part
            ids[live, at] = new
            lengths[live] -= 1
            n = lengths[live]
            spare = live[n <= width - 1]
            rank[spare, np.minimum(lengths[spare] - 1, width - 2)] = _NEVER  # what was shifted in from beyond the end
            for side in (0, 1):
                i = at - 1 + side
                fits = (i >= 0) & (i + 1 < n)
                rows, cols = live[fits], i[fits]
                found = self._ranks(ids[rows, cols], ids[rows, cols + 1])
                place[rows, cols], rank[rows, cols] = found, self.pair_rank[found]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n, for very long words."""
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (p := self.merges.get(ids[i] << 20 | ids[j])):
                heapq.heappush(heap, (p[0], i, ids[i], ids[j], p[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [x for x, live in zip(ids, alive) if live]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words, as one block of arrays.

    Words are added in byte order; when a word leaves a path, the states below it can't change
    any more and are replaced by equal ones that are there already, so suffixes are shared. The
    numbers of words that end before each arc add up to a word's rank, the place of its ids.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)) of finished states
    path: list[list] = [[False, []]]  # the open path: final, arcs
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((labels.pop(), register[key]))

    previous = b""
    for word in words:
        same = 0
        while same < min(len(word), len(previous)) and word[same] == previous[same]:
            same += 1
        close(same)
        for b in word[same:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
        previous = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    below: list[int] = []
    for final, arcs in states:  # targets come first
        below.append(final + sum(below[t] for _, t in arcs))
    first = np.zeros(len(states) + 1, np.int32)
    first[1:] = np.cumsum([len(arcs) for _, arcs in states])
    n = int(first[-1])
    label, target, skip = np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for s, (final, arcs) in enumerate(states):
        total = int(final)
        for k, (b, t) in enumerate(arcs, int(first[s])):
            label[k], target[k], skip[k] = b, t, total
            total += below[t]
    ids = [entries[w] for w in words]
    at = np.zeros(len(words) + 1, np.int32)
    at[1:] = np.cumsum([len(x) for x in ids])
    final = np.array([s[0] for s in states], np.uint8)
    flat = np.array([i for x in ids for i in x], np.uint32)
    head = np.array([len(states), n, len(words), len(flat)], np.int32)
    return b"".join(x.tobytes() for x in (head, first, target, skip, at, flat, label, final))


class Lexicon:
    """A compiled lexicon, mapped from a file."""

    def __init__(self, block: bytes):
        file, path = tempfile.mkstemp(suffix=".lexicon")
        with os.fdopen(file, "wb") as out:
            out.write(block)
        with open(path, "rb") as back:
            view = mmap.mmap(back.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(path)  # the mapping stays
        states, arcs, words, flat = (int(x) for x in np.frombuffer(view, np.int32, 4))
        place = 16

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(view, kind, n, place)
            place += out.nbytes
            return out

        self.first, self.target, self.skip, self.at = take(np.int32, states + 1), take(np.int32, arcs), take(np.int32, arcs), take(np.int32, words + 1)
        self.flat, label, self.final = take(np.uint32, flat), take(np.uint8, arcs), take(np.uint8, states)
        self.root, self.size = states - 1, words
        self.keys = np.repeat(np.arange(states), np.diff(self.first)) << 8 | label

    def ranks(self, table: np.ndarray) -> np.ndarray:
        """Numbers of words of one length, a row of bytes each; -1 for those that the lexicon lacks."""
        out = np.full(len(table), -1)
        live, state, total = np.arange(len(table)), np.full(len(table), self.root), np.zeros(len(table), np.int64)
        for column in table.T:
            keys = state << 8 | column[live]
            k = np.searchsorted(self.keys, keys)
            on = (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(k), bool)
            live, k = live[on], k[on]
            state, total = self.target[k].astype(np.int64), total[on] + self.skip[k]
        ends = self.final[state] == 1
        out[live[ends]] = total[ends]
        return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n: how often each pre-token occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, chunks = vocabulary(path), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for chunk, n in chunks.items():
                for word in vocab.words(chunk) if chunk else ():
                    counts[word] += n
            chunks.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in frugal(batches):
            for text in batch.column(0).to_pylist():
                for part in vocab.parts(text or ""):
                    if not isinstance(part, int):
                        chunks.update(part.translate(_PLAIN_SPACE).split(" ") if _ODD_SPACE.search(part) else part.split())
                if len(chunks) > COUNTED_WORDS:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The `size` most frequent pre-tokens, compiled; at most `size` rows reach the driver."""
    vocab = vocabulary(path)
    top = word_counts(docs, path).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    return compile_lexicon({w.encode(): vocab.merge(w) for w in top.column(0).to_pylist() if len(w) <= 64})


def encode(docs: DataFrame, path: str, finish: Callable, schema: str, lexicon: bytes | None = None, id_column: str | Column = "doc_id") -> DataFrame:
    """Rows that `finish` makes of each text's encoder; `finish(encoder, ids, texts)` returns Arrow columns.

    This is the general form: `digests` (below) and others give their own `finish`.
    """
    block = docs.sparkSession.sparkContext.broadcast(lexicon) if lexicon is not None else None
    name = hashlib.sha256(lexicon).hexdigest() if lexicon is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, name, block)
        for batch in frugal(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield finish(coder, part.column(0), part.column(1).to_pylist())

    return docs.select(F.col(id_column) if isinstance(id_column, str) else id_column, "text").mapInArrow(run, schema)


class Encoder:
    """Encodes texts, some hundred at a time; the chunks that it hasn't seen are looked up or merged together."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None):
        self.vocab, self.lexicon = vocab, lexicon
        self.numbers = [str(i) for i in range(len(vocab.tokens))]
        self.forget()

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each begins."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data, start = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        counts, parts = np.zeros(len(raw), np.int64), []
        for width in np.unique(size):
            group = np.flatnonzero(size == width)
            if width > _SHORT:
                for i in group:
                    ids = self.vocab.merge(words[i])
                    counts[i] = len(ids)
                    parts.append((np.array([i]), np.array([ids])))
                continue
            table = data[start[group][:, None] + np.arange(width)]
            rank = self.lexicon.ranks(table) if self.lexicon else np.full(len(group), -1)
            ids, n = np.zeros((len(group), width), np.int64), np.zeros(len(group), np.int64)
            old, new = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
            if len(old):
                at = self.lexicon.at[rank[old]].astype(np.int64)
                n[old] = self.lexicon.at[rank[old] + 1] - at
                ids[np.repeat(old, n[old]), ranges(np.zeros(len(old), np.int64), n[old])] = self.lexicon.flat[ranges(at, n[old])]
            if len(new):
                ids[new], n[new] = self.vocab.merge_table(table[new])
            counts[group] = n
            parts.append((group, ids))
        at = np.zeros(len(raw) + 1, np.int64)
        at[1:] = np.cumsum(counts)
        flat = np.zeros(at[-1], "<u4")
        for group, ids in parts:
            n = counts[group]
            column = ranges(np.zeros(len(group), np.int64), n)
            flat[np.repeat(at[group], n) + column] = ids[np.repeat(np.arange(len(group)), n), column]
        return flat, at

    def learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Remembers the ids of chunks that haven't been seen, by the hashes of their bytes (ascending)."""
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        split = [self.vocab.words(c) for c in chunks]
        number: dict[str, int] = {}
        order = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
        flat, at = self.words(list(number))
        size = np.diff(at)[order]
        edge = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, split)])]
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.first = np.insert(self.first, where, edge[:-1] + len(self.pool))
        self.count = np.insert(self.count, where, np.diff(edge))
        self.pool = np.concatenate([self.pool, flat[ranges(at[:-1][order], size)]])

    def forget(self) -> None:
        self.keys, self.first, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """All ids of each text."""
        parts = [self.vocab.parts(t or "") for t in texts]
        plain = [p for text in parts for p in text if not isinstance(p, int)]
        raw = [p.encode() for p in plain]
        offsets = np.concatenate([[0], np.cumsum(list(map(len, raw)), dtype=np.int64)])
        joined = b"".join(raw)
        coded: list[np.ndarray] = []
        for first, end, data, edge in pieces(np.frombuffer(joined, np.uint8), offsets):
            begin = int(offsets[first])
            starts, ends, rows = words(data, edge)
            keys, one, place = np.unique(span_hash(runs(data), starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, keys)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
            if not known.all():
                if len(self.keys) > CACHE_WORDS:
                    self.forget()
                    known[:] = False
                new = np.flatnonzero(~known)
                a, b = (starts[one[new]] + begin).tolist(), (ends[one[new]] + begin).tolist()
                self.learn(keys[new], [joined[i:j].decode() for i, j in zip(a, b)])
                at = np.searchsorted(self.keys, keys)
            count = self.count[at][place]
            ids = self.pool[ranges(self.first[at][place], count)]
            total = np.concatenate([[0], np.cumsum(count)])
            cut = total[np.searchsorted(rows, np.arange(end - first + 1))].tolist()
            coded += [ids[i:j] for i, j in zip(cut, cut[1:])]
        if len(coded) == len(parts) == len(plain) and all(len(p) == 1 for p in parts):
            return coded
        rest = iter(coded)
        return [np.concatenate([np.zeros(0, "<u4"), *(np.array([p], "<u4") if isinstance(p, int) else next(rest) for p in text)]) for text in parts]

    def write(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """The ids of each text as decimal numbers, and what they decode to: the tokens joined by spaces."""
        number, name = self.numbers.__getitem__, self.vocab.tokens.__getitem__
        out = []
        for ids in self.encode(texts):
            listed = ids.tolist()
            out.append((" ".join(map(number, listed)), " ".join(map(name, listed))))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, name: str | None = None, block=None) -> Encoder:
    """The worker's encoder for a tokenizer and a broadcast lexicon; later tasks find what earlier ones have learned."""
    key = (path, name)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary(path), Lexicon(block.value) if block else None)
    return _encoders[key]


def digests(docs: DataFrame, path: str, lexicon: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(coder: Encoder, ids: pa.Array, texts: list) -> pa.RecordBatch:
        n, first, second = [], [], []
        for written, decoded in coder.write(texts):
            n.append(written.count(" ") + 1 if written else 0)
            first.append(hashlib.sha256(written.encode()).hexdigest())
            second.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path, finish, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", train_lexicon(docs, path) if lexicon is None else lexicon)
