"""Quality classifier by Bradley-Terry pairwise ranking.

Each preference pair sets a labelled good document against a labelled bad one; the chance that the good one wins is the logistic
function of the difference of their scores, and a score is linear in features of the whole text. The weights minimise the
logistic loss over feature differences (Newton steps with a small ridge). The threshold is a score quantile: that at the share
of bad labels among the training rows. Scores are then mapped to 0..1 so that the threshold lands on CUT = 0.7.

Features see the text alone: variety and repetition of words and lines, capitals, symbols, digits, word length, and how well the
text compresses. Labels are learned from at most ``max_labels`` rows (MAX_LABELS; the rows with the least hash of their id) and
``max_pairs`` pairs (MAX_PAIRS); what reaches the driver is bounded by these. Scoring is one pass over all texts.

Defined results: null and empty texts score like a text without words; unlabelled or unusable labels (null id or quality) are
left out; of documents with one id the text with the least hash is learned from; without both classes there is nothing to rank and every document scores CUT; repeated rows score alike; a null id is
never held out; an empty table gives an empty result. Other columns (lang, source, n_chars, ...) are never read.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELS, MAX_PAIRS, RIDGE, CUT = 16_000, 60_000, 1e-2, 0.7
LETTERS, DIGITS = string.ascii_letters.encode(), string.digits.encode()
PROSE_MARKS = b".,;:'\"()-?"
ODD = bytes(c for c in range(33, 127) if c not in LETTERS + DIGITS + PROSE_MARKS)
ASCII = bytes(range(128))
NAMES = ("no_words", "variety", "repeats", "top_word", "capitals", "odd_symbols", "odd_words", "bare_symbols", "digits", "word_length", "long_words", "sentence_ends", "line_repeats", "compresses", "log_words", "odd_lines")


def features(text: str | None) -> list[float]:
    """NAMES of a whole text; ratios as square roots, so that a little of something odd shows."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (len(NAMES) - 1)
    data = text.encode("utf-8", "surrogatepass")
    size = len(data)
    counts = Counter(words)
    without = lambda chars: size - len(data.translate(None, chars))
    lines = [x for x in text.split("\n") if x]
    odd_words = bare = capitals = ends = long_words = letters = 0
    for word, k in counts.items():
        last = word[-1]
        letters += k * len(word)
        if last in ".!?":
            ends += k
        if not last.isalnum() and last not in ".,;:'\")?-":
            odd_words += k
        if len(word) > 1 and word.isupper():
            capitals += k
        if not any(map(str.isalnum, word[:3])):
            bare += k
        if len(word) > 24:
            long_words += k
    odd_lines = sum(1 for x in lines if len(x.encode("utf-8", "surrogatepass").translate(None, ODD)) < 0.97 * len(x.encode("utf-8", "surrogatepass")) or x.isupper())
    root = math.sqrt
    return [
        0.0,
        math.log(len(counts) + 1) / math.log(n + 1),
        root(sum(map(eq, words, words[1:])) / n),
        root(max(counts.values()) / n),
        root(capitals / n),
        root(without(ODD) / size),
        root(odd_words / n),
        root(bare / n),
        root(without(DIGITS) / size),
        math.log(letters / n),
        root(long_words / n),
        root(ends / n),
        root(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        min(1.0, len(zlib.compress(data, 1)) / (size + 20)),
        math.log(n + 1) / 10,
        root(odd_lines / len(lines)) if lines else 0.0,
    ]


class Ranker(NamedTuple):
    """Scores: logistic(slope * (weights . (features - means) / scales - threshold) + logit(CUT))."""

    weights: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    threshold: float
    slope: float

    def score(self, matrix: np.ndarray) -> np.ndarray:
        raw = (matrix - self.means) / self.scales @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + math.log(CUT / (1 - CUT)), -500, 500)))


def rank(good: np.ndarray, bad: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = RIDGE) -> Ranker:
    """Fit the pairwise model; pairs cycle through both classes, so each row is used as evenly as can be."""
    both = np.concatenate([good, bad])
    width = both.shape[1]
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.zeros(width), np.ones(width), 0.0, 1.0)
    means, scales = both.mean(axis=0), both.std(axis=0) + 1e-6
    g, b = (good - means) / scales, (bad - means) / scales
    n = int(min(max_pairs, len(g) * len(b)))
    k = np.arange(n, dtype=np.int64)
    rounds = k // max(len(g), len(b))
    difference = g[(k + rounds * (len(g) <= len(b))) % len(g)] - b[(k + rounds * (len(b) < len(g))) % len(b)]
    weights = np.zeros(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(difference @ weights, -500, 500)))
        gradient = difference.T @ (p - 1) / n + ridge * weights
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / n + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    raw_good, raw_bad = g @ weights, b @ weights
    # the bad labels' share gives the quantile; linear interpolation puts it between the ranks
    threshold = float(np.quantile(np.concatenate([raw_good, raw_bad]), len(bad) / len(both)))
    gap = float(np.median(raw_good) - np.median(raw_bad))
    return Ranker(weights, means, scales, threshold, 8 / max(gap, 1e-6))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS, max_pairs: int = MAX_PAIRS) -> Ranker:
    """Learn from the labelled rows that aren't held out: at most max_labels of them, chosen by the hash of their id."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label"))
    chosen = F.broadcast(usable.distinct().orderBy(F.xxhash64("l_id"), "label").limit(max_labels))  # max_labels rows of two numbers

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return text.map(features)

    met = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text")).join(chosen, F.col("d_id") == F.col("l_id"))
    # of documents with one id the text with the least hash counts, so that no more rows than labels reach the driver
    one = met.groupBy("d_id", "label").agg(F.min(F.struct(F.xxhash64("d_text").alias("h"), F.col("d_text"))).alias("m"))
    rows = one.select("d_id", "label", measured("m.d_text").alias("f")).toPandas().sort_values(["d_id", "label"], kind="stable")
    matrix = np.array(rows["f"].tolist(), float).reshape(len(rows), len(NAMES))
    label = rows["label"].to_numpy(int)
    return rank(matrix[label == 1], matrix[label == 0], max_pairs)


def scores(text: Column, ranker: Ranker) -> Column:
    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        matrix = np.array([features(t) for t in text], float).reshape(len(text), len(NAMES))
        return pd.Series(ranker.score(matrix))

    return scored(text)


def classify(docs: DataFrame, ranker: Ranker, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), scores(F.col(text_col), ranker).alias("score"))
    return rows.select(id_col, "held_out", "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, ranker: Ranker, *, text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return docs.filter(scores(F.col(text_col), ranker) >= CUT)
