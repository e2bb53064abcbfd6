"""A small text classifier: hashed trigram features, one hidden layer, a gate for what it doesn't know."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHED, FEATURES, HIDDEN = 256, 260, 64
#: Largest probability below which nothing is claimed; labelled rows that training takes at most.
GATE, TRAINING_ROWS = 0.30, 20_000
UNKNOWN = "UNKNOWN"


def features(text: str | None) -> np.ndarray:
    """Shares of byte trigrams by FNV-1a hash, and shares of letters, digits, spaces, marks."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    out = np.zeros(FEATURES, np.float32)
    if len(raw) >= 3:
        h = np.full(len(raw) - 2, 2166136261, np.uint32)
        for i in range(3):
            h = (h ^ raw[i : len(raw) - 2 + i]) * np.uint32(16777619)
        out[:HASHED] = np.bincount(h % HASHED, minlength=HASHED) / len(h)
    if len(raw):
        letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
        digit, space = (raw >= 48) & (raw <= 57), (raw == 32) | ((raw >= 9) & (raw <= 13))
        out[HASHED:] = [letter.mean(), digit.mean(), space.mean(), (~(letter | digit | space)).mean()]
    return out


@dataclass
class Model:
    labels: list[str]
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(x @ self.first + self.first_bias, 0)
        z = hidden @ self.second + self.second_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _sample(rows: DataFrame, text: str, label: str, limit: int) -> pd.DataFrame:
    """hash, label, features, n of the labelled rows of smallest text hash: each text and label once, with how often it stands there.

    Counts by the first bits of the hash tell which rows come into question, some 1/65,536 of all more
    than the limit; of these each text is sent as its features, so that the driver gets no text.
    """
    labelled = rows.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(text).alias("hash"))
    first = F.shiftright("hash", 48)
    counts = labelled.groupBy(first.alias("first")).agg(F.count("*").alias("n")).toPandas().sort_values("first")
    enough = counts["first"][counts["n"].cumsum() >= limit]
    last = int(enough.iloc[0]) if len(enough) else 1 << 15
    groups = labelled.where(first <= last).groupBy("hash", "text", "label").agg(F.count("*").alias("n"))
    vector = F.pandas_udf(lambda texts: pd.Series([features(t) for t in texts], dtype=object), "array<float>")
    return groups.select("hash", "label", "n", vector("text").alias("features")).toPandas().sort_values(["hash", "label"])


def train(rows: DataFrame, text: str, label: str, limit: int = TRAINING_ROWS, steps: int = 600, seed: int = 1) -> Model:
    """Fitted by Adam on a bounded sample: the labelled rows of smallest text hash."""
    sample = _sample(rows, text, label, limit)
    at = np.repeat(np.arange(len(sample)), np.minimum(sample["n"].to_numpy(int), limit))[:limit]
    owned = sample["label"].to_numpy()[at]
    labels = sorted(set(owned))
    x = np.stack(sample["features"].to_list())[at] if len(at) else np.zeros((0, FEATURES), np.float32)
    y = np.searchsorted(labels, owned) if len(at) else np.zeros(0, int)
    rng = np.random.default_rng(seed)
    w = [rng.standard_normal((FEATURES, HIDDEN)) * 0.3, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, len(labels))) * 0.2, np.zeros(len(labels))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1 if len(x) else 1):
        at = rng.integers(0, len(x), 128)
        a, b = x[at] * 20, y[at]
        hidden = np.maximum(a @ w[0] + w[1], 0)
        z = hidden @ w[2] + w[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(b)), b] -= 1
        p /= len(b)
        back = (p @ w[2].T) * (hidden > 0)
        for i, g in enumerate((a.T @ back, back.sum(0), hidden.T @ p, p.sum(0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(labels, w[0] * 20, *w[1:])


def classified(model: Model, text: Column) -> Column:
    """struct(label, probability): UNKNOWN for empty texts and below the gate."""

    def run(texts: pd.Series) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"label": [], "probability": []})
        p = model.probabilities(np.stack([features(t) for t in texts]))
        best, top = p.argmax(1), p.max(1)
        known = (top >= GATE) & np.array([bool(t) for t in texts])
        return pd.DataFrame({"label": [model.labels[b] if k else UNKNOWN for b, k in zip(best, known)], "probability": np.where(known, top, 0.0)})

    return F.pandas_udf(run, "label string, probability double")(text)
