"""Quality scores of texts by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmill.llm.common import fold, whole_text

#: Most labelled rows that a model is fitted on (the ones with the smallest key hashes); about 200 bytes each.
TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "log_bytes upper lower digit blank newline high exclaim period comma stars percent amp dollar hash bar other_punct "
    "entropy words mean_word long_word short_words distinct_words top_word top_three distinct_lines mean_line "
    "marked_words upper_words number_words"
).split()


def statistics(text: str) -> list[float]:
    """The numbers that describe one whole text; all 0 for a text without characters."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / len(data)
    seen = share[share > 0]
    punctuation = share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()
    named = [share[ord(c)] for c in "!.,*%&$#|"]
    words = text.split()
    tally = Counter(words)
    n = max(1, len(words))
    top = tally.most_common(3)
    lengths = np.fromiter(map(len, tally), np.int64, len(tally))
    times = np.fromiter(tally.values(), np.int64, len(tally))
    lines = text.split("\n")
    marked = sum(c for w, c in tally.items() if not w[-1].isalnum() and w[-1] not in ".,")
    upper = sum(c for w, c in tally.items() if len(w) > 1 and w.isupper())
    numbers = sum(c for w, c in tally.items() if w[0].isdigit())
    return [
        math.log(len(data)),
        share[65:91].sum(),
        share[97:123].sum(),
        share[48:58].sum(),
        share[32],
        share[10],
        share[128:].sum(),
        *named,
        punctuation - sum(named),
        float(-(seen * np.log2(seen)).sum()),
        math.log1p(len(words)),
        float((lengths * times).sum()) / n,
        float(lengths.max()) if len(lengths) else 0.0,
        float(times[lengths < 3].sum()) / n,
        len(tally) / n,
        top[0][1] / n if top else 0.0,
        sum(c for _, c in top) / n,
        len(set(lines)) / len(lines),
        math.log1p(len(text) / len(lines)),
        marked / n,
        upper / n,
        numbers / n,
    ]


@dataclass(frozen=True)
class Trees:
    """All trees of a model in three arrays of one row per tree: the node at ``i`` has children ``2i+1`` and ``2i+2``.

    Inner nodes hold a feature and a threshold (values above it go right); leaves, the last level, hold values.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 per row: all rows walk down one level of all trees at a time."""
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        logit = self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0
) -> Trees:
    """Boosted trees on the logistic loss, grown level by level from histograms of gradients.

    Without rows, or with one label only, the model gives the label's smoothed share to every text.
    """
    n, inner = len(y), 2**depth - 1
    base = math.log((y.sum() + 1) / (n - y.sum() + 1))
    feature = np.zeros((trees, inner), np.int32)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    if n and 0 < y.sum() < n:
        inside = np.arange(1, bins) / bins
        cuts = [np.unique(np.quantile(column, inside, method="lower")) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])
        logit = np.full(n, base)
        for tree in range(trees):
            p = 1 / (1 + np.exp(-logit))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width, start = 2**level, 2**level - 1
                best, at, where = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
                for j, column in enumerate(binned):
                    cell = node * bins + column
                    g = np.bincount(cell, gradient, width * bins).reshape(width, bins).cumsum(axis=1)
                    h = np.bincount(cell, weight, width * bins).reshape(width, bins).cumsum(axis=1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    parts = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                    parts[(h < 1) | (h_all - h < 1)] = 0
                    split = parts[:, : len(cuts[j])].argmax(axis=1) if len(cuts[j]) else np.zeros(width, np.int64)
                    gain = parts[np.arange(width), split]
                    better = gain > best
                    best[better], at[better], where[better] = gain[better], split[better], j
                cut = where >= 0
                feature[tree, start : start + width][cut] = where[cut]
                threshold[tree, start : start + width][cut] = [cuts[j][s] for j, s in zip(where[cut], at[cut])]
                right = cut[node] & (binned[where[node], np.arange(n)] > at[node])
                node = 2 * node + right
            g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, weight, inner + 1)
            value[tree] = rate * g / (h + ridge)
            logit += value[tree][node]
    return Trees(base, feature, threshold, value, depth)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    rows: int = TRAIN_ROWS,
) -> Trees:
    """Fit on at most ``rows`` labelled rows outside the held-out fold.

    Which rows is decided on the narrow label table, by the hash of the key, so the sample is the same at each run and
    its keys (under 1 MB) can be broadcast to the scan of the texts. Their statistics, 250 bytes a row, reach the
    driver. Labels other than 0 and 1 and rows without a key are left out; keys with several labels have the largest.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("key").isNotNull() & (fold("key", FOLDS) != 0))
    known = known.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias("key"), whole_text(text).alias("text"))
    sample = texts.join(F.broadcast(known), "key").select("key", "y", "text")

    def batches(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in stream:
            yield pd.DataFrame({"key": frame["key"], "y": frame["y"], "x": [statistics(t) for t in frame["text"]]})

    schema = f"key {docs.schema[key].dataType.simpleString()}, y int, x array<double>"
    got = sample.mapInPandas(batches, schema).toPandas().sort_values("key", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(model: Trees, text: str = "text") -> Column:
    """The score of each whole text, 0 to 1: the higher, the likelier label 1. Null texts count as empty."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.array([statistics(t) for t in texts], float)))

    return scores(whole_text(text))


def classify(
    docs: DataFrame, model: Trees, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``docs``.

    ``held_out`` marks the fold whose labels no model saw, ``predicted`` is 1 for scores of at least ``threshold``.
    Null and empty texts have the score of a text whose statistics are all 0. Rows with a null key are scored and
    counted as not held out. Repeated rows get the same score each. Only the key and the text are read; an empty
    table gives an empty result.
    """
    held_out = F.coalesce(fold(key, FOLDS) == 0, F.lit(False))
    scored = docs.select(F.col(f"`{key}`").alias(key), held_out.alias("held_out"), score(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
