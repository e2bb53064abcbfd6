"""Quality rules: decision lists learned from labelled statistics, applied as Spark conditions.

`statistics` measures every whole text. `learn` grows conjunctions of thresholds one after another
on labelled rows (sequential covering): each is grown on one part of the rows by information gain,
pruned on the other part, kept if it is precise there, and its rows are then set aside. The list
becomes one ordered CASE WHEN that Spark evaluates; the first rule that holds decides.

Results: null and empty texts have no words and fail the base rule; documents without labels, or
tables without enough labels, are judged by the base rule and by what rules there are; null labels
and null doc_ids in the labels are not learned from; several labels of a document count several
times. Input columns whose names begin like those of the statistics (stat_) are left out of the
results of `statistics` and `judge`, and kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._kernel import SEPARATOR, mix, pieces, runs, span_hash, sums_by_row, text_column, windows, words
from quarrylight.llm.blocks import frugal

#: Labelled rows that a list is learned from at most (the ones of smallest id hash), and how it is learned.
LABELLED_ROWS = 50_000
MIN_ROWS = 20
PRECISION = 0.9
MAX_RULES = 12
MAX_CONDITIONS = 4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_chars"]
PREFIX = "stat_"


def _table(members: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members] if isinstance(members, str) else list(members)] = True
    return out


SYMBOL, UPPER, LOWER_CASE, DIGIT, MARK = _table("#*$%&|<>"), _table(range(65, 91)), _table(range(97, 123)), _table(range(48, 58)), _table(".,;:!?")


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a run of texts."""
    n = len(offsets) - 1
    out = {name: np.zeros(n, np.int64) for name in COUNTS}
    starts, ends, rows = words(data, offsets)
    out["n_words"] = np.bincount(rows, minlength=n)
    heads = (data & 0xC0) != 0x80
    out["n_chars"] = sums_by_row(heads, offsets)
    out["word_chars"] = sums_by_row(heads & ~SEPARATOR[data], offsets)
    for name, members in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_lower", LOWER_CASE), ("n_digits", DIGIT), ("n_marks", MARK)):
        out[name] = sums_by_row(members[data], offsets)
    if not len(starts):
        return out
    sums = runs(data)
    values, first = windows(span_hash(sums, starts, ends), rows, 3)
    if len(values):
        values = mix(values + rows[first].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))  # alike in one row only
        order = np.sort(values)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.searchsorted(twice, values)
            again = first[twice[np.minimum(at, len(twice) - 1)] == values]
            covered = np.zeros(len(starts), bool)
            for i in range(3):
                covered[again + i] = True
            out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    # lines: a word tells the line that it stands in
    cuts = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], cuts[cuts + 1 < len(data)] + 1]))
    lines = np.unique(np.searchsorted(begin, starts, "right") - 1)
    begin_at = begin[lines]
    row = np.searchsorted(offsets, begin_at, "right") - 1
    next_cut = np.append(cuts, len(data))[np.searchsorted(cuts, begin_at)]
    line = span_hash(sums, begin_at, np.minimum(next_cut, offsets[row + 1]))
    out["n_lines"] = np.bincount(row, minlength=n)
    order = np.lexsort((line, row))
    same = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][1:][same], minlength=n)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """All columns of the documents, and the counts of their texts as stat_... columns."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith(PREFIX)])
    names = docs.columns
    at = names.index("text")
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            data, offsets = text_column(batch.column(at))
            found = [measure(d, o) for _, _, d, o in pieces(data, offsets)]
            counts = [pa.array(np.concatenate([f[c] for f in found]) if found else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], [*names, *(PREFIX + c for c in COUNTS)])

    return docs.mapInArrow(run, fields + "".join(f", {PREFIX}{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What rules may ask about: sizes, and shares that don't depend on the size."""
    s = {c: F.col(PREFIX + c).cast("double") for c in COUNTS}

    def share(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(1.0))

    return {
        "words": s["n_words"],
        "word_length": share(s["word_chars"], s["n_words"]),
        "symbols_a_word": share(s["n_symbols"], s["n_words"]),
        "dup_lines": share(s["n_dup_lines"], s["n_lines"]),
        "repeat_words": share(s["n_repeat_words"], s["n_words"]),
        "words_a_line": share(s["n_words"], s["n_lines"]),
        "upper": share(s["n_upper"], s["n_upper"] + s["n_lower"]),
        "digits": share(s["n_digits"], s["word_chars"]),
        "marks_a_word": share(s["n_marks"], s["n_words"]),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions together make a document bad."""

    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(values.values()))), bool)
        for c in self.conditions:
            out &= c.holds(values)
        return out

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            x = columns[c.feature]
            out = out & ((x > F.lit(c.threshold)) if c.above else (x <= F.lit(c.threshold)))
        return out


def _gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    """Information gain of a longer conjunction, times the bad rows that it still covers."""
    if not bad:
        return -1.0
    return bad * (np.log2(bad / (bad + good)) - np.log2(bad_before / (bad_before + good_before)))


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Adds the condition of largest gain until no good row is covered or nothing is gained."""
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[on]).any():
        best, best_gain = None, 1e-9
        p, q = float(bad[on].sum()), float((~bad[on]).sum())
        for name, x in values.items():
            x_on, bad_on = x[on], bad[on]
            order = np.argsort(x_on, kind="stable")
            xs, hits = x_on[order], np.cumsum(bad_on[order])
            cut = np.flatnonzero(xs[1:] > xs[:-1])
            if len(cut) > 64:
                cut = cut[np.linspace(0, len(cut) - 1, 64).astype(int)]
            for i in cut:
                below_bad, below = float(hits[i]), i + 1.0
                middle = float((xs[i] + xs[i + 1]) / 2)
                for above, b, n in ((False, below_bad, below), (True, p - below_bad, len(xs) - below)):
                    gain = _gain(b, n - b, p, q)
                    if gain > best_gain:
                        best, best_gain = Condition(name, above, middle), gain
        if best is None:
            break
        rule.append(best)
        on &= best.holds(values)
    return rule


def prune(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Drops last conditions as long as (bad - good) / covered doesn't fall on rows that the rule wasn't grown on."""

    def worth(r: list[Condition]) -> float:
        on = Rule(tuple(r), 0).holds(values)
        n = on.sum()
        return -1.0 if not n else (2.0 * bad[on].sum() - n) / n

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(values: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """An ordered list of rules for bad rows; `part` true: rows to grow on, false: rows to prune and test on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        a, b = left & part, left & ~part
        if bad[a].sum() < MIN_ROWS or bad[b].sum() < MIN_ROWS / 2:
            break
        on_a, on_b = ({k: v[m] for k, v in values.items()} for m in (a, b))
        rule = prune(grow(on_a, bad[a]), on_b, bad[b])
        if not rule:
            break
        hit = Rule(tuple(rule), 0).holds(on_b)
        covered = int(hit.sum())
        precision = float(bad[b][hit].mean()) if covered else 0.0
        if covered < MIN_ROWS / 4 or precision < PRECISION:
            break
        rules.append(Rule(tuple(rule), precision))
        left &= ~rules[-1].holds(values)
    return rules


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """A list learned from at most `rows` labelled documents (quality 0 is bad)."""
    key = F.col("doc_id").cast("string")
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label_quality"), F.xxhash64(key).alias("label_hash"))
        .orderBy("label_hash", "label_id", "label_quality")
        .limit(rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label_quality", "label_hash")
    names = list(features())
    got = statistics(known).select("label_quality", "label_hash", *(c.alias(n) for n, c in features().items())).orderBy("label_hash", "label_quality", *names).toArrow()
    values = {n: got[n].to_numpy() for n in names}
    return learn(values, got["label_quality"].to_numpy() == 0, got["label_hash"].to_numpy() % 3 != 0)


def base_failed() -> Column:
    n, repeated = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one Spark condition: false where a rule finds a document bad."""
    columns = features()
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(columns), False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns, the statistics, stat_base_failed and stat_kept."""
    return statistics(docs).withColumn(PREFIX + "base_failed", base_failed()).withColumn(PREFIX + "kept", verdict(rules))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the rules keep, with the columns that they came with."""
    whole = docs.select("text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    return judge(whole, rules).where(F.col(PREFIX + "kept")).select("row.*")
