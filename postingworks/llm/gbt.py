"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of texts are computed in blocks of bytes; a boosted ensemble of shallow trees is fitted in numpy on a sample
of labelled rows whose size is bounded by a parameter, then flattened into arrays, so that scoring is one vectorised
walk of all rows through all trees.

Defined results: a null or empty text has all its statistics zero and is scored like any other; with no labelled rows
every score is 0.5; the fit uses `sample_rows` labelled rows at most, those of the smallest hashes of their keys; rows without a label and labels without a row take no part in the fit; labels other than 0 and 1 are
ignored; of repeated labels each counts; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks
from .rules import _repeated, base_counts

SAMPLE_ROWS = 20_000
BINS = 48
TREES = 60
DEPTH = 4
RATE = 0.2
MIN_CHILD = 8.0

FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "lower", "digit", "punctuation", "symbol", "space", "line",
    "bang", "stop", "beyond_ascii", "symbols_a_word", "dup_lines", "repeat_words", "distinct_words", "same_neighbour",
    "ends_in_symbol", "ends_in_stop", "upper_words", "longest_word", "pipe",
]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(at) - 1
    base = base_counts(data, at)
    size = np.diff(at)

    def share(flags, of=None):
        total = np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])
        return total / np.maximum(size if of is None else of, 1)

    word_doc, word_hash, starts, ends = (base[x] for x in ("word_doc", "word_hash", "starts", "ends"))
    n_words = np.maximum(base["n_words"], 1)

    def of_words(flags):
        return np.bincount(word_doc[flags], minlength=n) / n_words

    with np.errstate(over="ignore"):
        again = _repeated(word_hash + word_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[1]
    same = np.zeros(len(word_doc), bool)
    same[1:] = (word_hash[1:] == word_hash[:-1]) & (word_doc[1:] == word_doc[:-1])
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    symbol = np.isin(data, list(b"#*$%&|<>^~@_=+\\{}[]"))
    tail = data[ends - 1] if len(ends) else data[:0]
    longest = np.zeros(n)
    np.maximum.at(longest, word_doc, ends - starts)
    lines = np.diff(np.concatenate(([0], np.cumsum(data == 10)))[at])
    upper_after = np.zeros(len(starts), bool)
    if len(starts):
        second = np.minimum(starts + 1, ends - 1)
        upper_after = (ends - starts > 1) & upper[second]
    columns = [
        np.log1p(base["word_chars"]), np.log1p(base["n_words"]), base["word_chars"] / n_words, share(upper), share(lower), share((data >= 48) & (data <= 57)),
        share(np.isin(data, list(b".,;:?!'\"()-"))), share(symbol), share((data == 32) | ((data >= 9) & (data <= 13))), lines / n_words,
        share(data == 33), share(data == 46), share(data >= 128), base["n_symbols"] / n_words, base["n_dup_lines"] / np.maximum(lines + 1, 1), base["n_repeat_words"] / n_words,
        1 - of_words(again), of_words(same), of_words(np.isin(tail, list(b"#*$%&|<>!"))), of_words(np.isin(tail, list(b".,;:?"))), of_words(upper_after), longest, share(data == 124),
    ]
    out = np.stack([np.asarray(c, float) for c in columns], axis=1)
    out[size == 0] = 0.0
    return out


@dataclass
class Ensemble:
    """All trees, flattened: node t's feature, threshold and left child (right is the next); leaves have feature -1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + go)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0) -> Ensemble:
    """Newton boosting of the logistic loss on feature histograms; grown level by level."""
    feature, threshold, left, value, roots = [], [], [], [], []
    if not len(y):
        return Ensemble(0.0, *(np.zeros(0, np.int64) for _ in range(5)), depth)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    total = np.full(len(y), base := float(np.log(mean / (1 - mean))))
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    width = bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        open_nodes, place = [roots[-1]], np.zeros(len(y), np.int64)  # place: index into open_nodes, or -1
        for level in range(depth + 1):
            inside = np.flatnonzero(place >= 0)
            m = len(open_nodes)
            if not m:
                break
            sum_g = np.bincount(place[inside], g[inside], m)
            sum_h = np.bincount(place[inside], h[inside], m)
            for i, node in enumerate(open_nodes):
                value[node] = rate * sum_g[i] / (sum_h[i] + ridge)
            if level == depth:
                break
            best = np.zeros(m)
            pick = np.full((m, 2), -1)
            for f in range(n_features):
                cell = place[inside] * width + binned[inside, f]
                cg = np.cumsum(np.bincount(cell, g[inside], m * width).reshape(m, width), axis=1)
                ch = np.cumsum(np.bincount(cell, h[inside], m * width).reshape(m, width), axis=1)
                rg, rh = sum_g[:, None] - cg, sum_h[:, None] - ch
                gain = cg**2 / (ch + ridge) + rg**2 / (rh + ridge) - (sum_g**2 / (sum_h + ridge))[:, None]
                gain[(ch < MIN_CHILD / 4) | (rh < MIN_CHILD / 4)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(m), top] > best + 1e-9
                best[better] = gain[np.arange(m), top][better]
                pick[better] = np.stack([np.full(m, f), top], axis=1)[better]
            following, moved = [], np.full(len(y), -1)
            for i, node in enumerate(open_nodes):
                f, b = pick[i]
                if f < 0:
                    continue
                feature[node], threshold[node], left[node] = int(f), float(edges[f][b]), len(feature)
                for _ in range(2):
                    feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
                rows = inside[place[inside] == i]
                moved[rows] = len(following) + (binned[rows, f] > b)
                following += [left[node], left[node] + 1]
            open_nodes, place = following, moved
        one = Ensemble(0.0, np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array([roots[-1]]), depth)
        step = one.score(x)
        total += np.log(step / (1 - step))
    return Ensemble(base, np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth)


def fit_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on `sample_rows` labelled rows at most, chosen by a hash of the key."""
    chosen = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col(key).isNotNull()).orderBy(F.xxhash64(key), key, "y").limit(sample_rows)
    # A row for each key, so that a text is measured once, however often its key is labelled.
    counts = chosen.groupBy(key).agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    rows = docs.select(key, text).join(F.broadcast(counts), key)  # of bounded size: sample_rows keys
    kind = docs.schema[key].dataType.simpleString()

    def measured(batches):
        for batch in batches:
            for a, b, data, at in blocks(batch.column(1)):
                x = statistics(data, at)
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in (0, 2, 3, 4)), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], names=[key, "n0", "n1", "t", "x"])

    known = rows.select(key, text, "n0", "n1", F.xxhash64(text).alias("t")).mapInArrow(measured, f"`{key}` {kind}, n0 long, n1 long, t long, x array<double>")
    # Limited again, as a key may have any number of rows; in a task, as the driver would get that many rows of each task.
    first = known.withColumn("h", F.xxhash64(key)).orderBy("h", key, "t").limit(sample_rows).coalesce(1).toPandas()
    found = pd.concat([first.assign(y=y, n=first[f"n{y}"]) for y in (0, 1)]).sort_values(["h", key, "y", "t"], kind="stable")
    found["n"] = np.diff(np.minimum(np.cumsum(found["n"].to_numpy(np.int64)), sample_rows), prepend=0)
    found = found[found["n"] > 0].sort_values([key, "y", "t"], kind="stable")
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(FEATURES)))
    times = found["n"].to_numpy()
    return fit_trees(np.repeat(x, times, axis=0), np.repeat(found["y"].to_numpy(float), times))


def score_documents(docs: DataFrame, model: Ensemble, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key and score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            for a, b, data, at in blocks(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(shared.value.score(statistics(data, at)))], names=[key, "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(scored, f"`{key}` {kind}, score double")


def good_documents(docs: DataFrame, model: Ensemble, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs with at least this score, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            for a, b, data, at in blocks(batch.column(place)):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.score(statistics(data, at)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
