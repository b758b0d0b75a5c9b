"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees of one depth, stored as three flat arrays (feature, threshold, leaf), and
a batch walks them all at once with numpy indexing.  Training reads at most ``SAMPLE`` labelled documents
(the smallest hashes of their ids), whose statistics alone come to the driver; scoring reads every whole
text where it lies and shuffles nothing.

Cases: a null text counts as empty; an empty text has statistics of zero and so a score like any other;
labels that are null, not 0 or 1, or without a document are not used, and conflicting labels of a document
all are; a document without a label is scored like any other; without any usable label every score is 0.5;
repeated rows get equal scores; an empty table gives an empty result; other columns pass through, and the
added columns replace columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, without
from .quality_rules import measure

#: Labelled documents that training reads at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.2, 1.0, 5.0
THRESHOLD = 0.3

FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_lines", "repeated_words", "words_per_line", "upper_share",
    "stutter_share", "distinct_share", "top_word_share", "digit_share", "punctuation_per_word", "bang_per_word", "letter_share", "longest_word",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers that the trees see, from the whole text alone."""
    n_words, chars, symbols, dup, rep, lines, letters, upper, stutter = measure(text)
    if not n_words:
        return (0.0,) * len(FEATURES)
    words = text.encode().split()
    counts = Counter(words)
    codes = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    digits = int(codes[48:58].sum())
    return (
        float(np.log1p(n_words)), chars / n_words, symbols / n_words, dup / max(1, lines), rep / n_words, n_words / max(1, lines),
        upper / max(1, letters), stutter / n_words, len(counts) / n_words, max(counts.values()) / n_words, digits / chars,
        int(codes[[33, 44, 46, 58, 59, 63]].sum()) / n_words, int(codes[33]) / n_words, letters / chars, max(map(len, counts)),
    )


@dataclass
class Forest:
    """Flat arrays: node k of a tree has children 2k+1 and 2k+2; the last level are leaves."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a value above it goes right
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            total += self.leaf[t, at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss over binned features."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: value <= cut b
    p = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(p / (1 - p)))
    raw = np.full(n, start)
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    slots = np.arange(d)[None, :] * BINS + binned
    for t in range(TREES):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            code = ((at - first)[:, None] * (d * BINS) + slots).ravel()
            size = width * d * BINS
            gs = np.bincount(code, np.repeat(g, d), size).reshape(width, d, BINS).cumsum(2)
            hs = np.bincount(code, np.repeat(h, d), size).reshape(width, d, BINS).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(hs < LEAST * 0.05) | (ht - hs < LEAST * 0.05)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        at -= inner
        gl, hl = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf[t] = RATE * gl / (hl + L2)
        raw += leaf[t, at]
    return Forest(feature, threshold, leaf, start)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Documents that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> Forest:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), without the held-out fold.

    The sample's ids are at most ``sample`` rows, so they are broadcast whatever the tables' size.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def per_batch(texts):
        return [pa.array([list(statistics(t)) for t in texts], pa.list_(pa.float64()))]

    rows = append_columns(texts, "text", [("x", T.ArrayType(T.DoubleType()))], per_batch).select("doc_id", "quality", "x")
    found = sorted(map(tuple, rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample).collect()))
    x = np.array([r[2] for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float))


NAMES = ("score", "predicted")


def with_score(docs: DataFrame, model: Forest, text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = NAMES) -> DataFrame:
    """``docs`` with a score (0 to 1) and a verdict (1 if score >= threshold)."""

    def per_batch(texts):
        x = np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))
        s = model.score(x)
        return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

    return append_columns(docs, text_col, list(zip(names, (T.DoubleType(), T.IntegerType()))), per_batch)


def accepted(docs: DataFrame, model: Forest, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    names = tuple(fresh(docs.columns, f"_{n}") for n in NAMES)
    return without(with_score(docs, model, text_col, threshold, names).where(F.col(names[1]) == 1), names)
