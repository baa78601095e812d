"""Quality scores by an additive model of lookup tables with pairwise interactions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import prepare_workers, written

SAMPLE_ROWS = 20_000  # labelled documents a model is fitted on, about
BINS = 48  # bins of a feature; pairs use a third of them
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 10  # interactions kept
RATE = 0.1

SPACE = re.compile(r"[\x20\x09-\x0D]+")

# Byte classes: lower case, upper case, digit, white space, other ASCII, part of a longer
# character.
KIND = np.full(256, 4, "u1")
KIND[ord("a") : ord("z") + 1] = 0
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[[9, 10, 11, 12, 13, 32]] = 3
KIND[128:] = 5

FEATURES = [
    "log_words",
    "word_length",
    "log_lines",
    "words_per_line",
    "upper",
    "digits",
    "marks",
    "wide",
    "top_mark",
    "bare_marks",
    "marked_words",
    "stops",
    "distinct_words",
    "top_word",
    "repeated_next",
    "repeated_pairs",
    "repeated_lines",
    "short_words",
    "long_words",
    "capitalised",
]


def describe(text: str) -> list[float]:
    """The features of one whole text, all shares unless named otherwise."""
    raw = np.frombuffer(text.encode(), "u1")
    kinds = np.bincount(KIND[raw], minlength=6)
    visible = max(1, len(raw) - int(kinds[3]))
    letters = max(1, int(kinds[0] + kinds[1]))
    words = [w for w in SPACE.split(text) if w]
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line]
    n_lines = max(1, len(lines))
    counted = Counter(words)
    top = counted.most_common(1)[0][1] if counted else 0
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    marks = raw[KIND[raw] == 4]
    by_mark = np.bincount(marks, minlength=256)
    sentence_marks = int(by_mark[ord(".")] + by_mark[ord(",")])
    alphabetic = sum(map(str.isalpha, words))
    bare = sum(not (w[0].isalnum() or w[-1].isalnum()) for w in words)
    lengths = np.fromiter(map(len, words), "i8", len(words))
    return [
        float(np.log1p(len(words))),
        float(lengths.mean()) if len(words) else 0.0,
        float(np.log1p(len(lines))),
        len(words) / n_lines,
        int(kinds[1]) / letters,
        int(kinds[2]) / visible,
        (len(marks) - sentence_marks) / visible,
        int(kinds[5]) / visible,
        int(by_mark.max()) / visible,
        bare / n,
        1 - alphabetic / n,
        sentence_marks / visible,
        len(counted) / n,
        top / n,
        same / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        float((lengths <= 3).mean()) if len(words) else 0.0,
        float((lengths >= 14).mean()) if len(words) else 0.0,
        sum(map(str.istitle, words)) / n,
    ]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [describe(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))],
            names=["doc_id", "features"],
        )


def document_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` of every row, written once; a null text counts as empty."""
    prepare_workers(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return written(rows.mapInArrow(_describe, f"doc_id {kind}, features array<double>"), "features")


def _grow(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A shallow tree over ordered bins: its value in each bin, from sums per bin."""
    cuts = [0, len(gradient)]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def merit(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    while len(cuts) - 1 < leaves:
        best = (1e-6, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = merit(a, at) + merit(at, b) - merit(a, b)
                gain[(h[at] - h[a] < 1) | (h[b] - h[at] < 1)] = 0
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(at[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    value = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return value


def _grow_pair(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two features: one cut of the first, then one of the second on each side."""
    best = (0.0, np.zeros_like(gradient))
    for turned in (False, True):
        g, h = (gradient.T, weight.T) if turned else (gradient, weight)
        down_g, down_h = g.cumsum(axis=0), h.cumsum(axis=0)
        for cut in range(len(g) - 1):
            value, gain = np.zeros_like(g), 0.0
            for rows, sg, sh in (
                (slice(None, cut + 1), down_g[cut], down_h[cut]),
                (slice(cut + 1, None), down_g[-1] - down_g[cut], down_h[-1] - down_h[cut]),
            ):
                own = _grow(sg, sh, 2)
                value[rows] = own
                gain += float((own * sg).sum())
            if gain > best[0]:
                best = (gain, value.T.copy() if turned else value)
    return best[1], best[0]


@dataclass
class AdditiveModel:
    """``score = logistic(base + table per feature + table per pair)``."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.tables:
            at = self.bins(x)
            for j, t in enumerate(self.tables):
                out += t[at[j]]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[at[a] // 3, at[b] // 3]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost shallow trees, feature after feature in cycles, then pairs on what is left.

    Without rows the score is a half; with one label only, its share with one row of each
    label added.
    """
    model = AdditiveModel(base=float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    if not len(y) or y.min() == y.max():
        return model
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], steps)) for j in range(x.shape[1])]
    at = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.edges]
    margin = np.full(len(y), model.base)

    def sums(index, size):
        p = 1 / (1 + np.exp(-margin))
        return (
            np.bincount(index, y - p, minlength=size),
            np.bincount(index, p * (1 - p), minlength=size),
        )

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            step = RATE * _grow(*sums(at[j], BINS))
            t += step
            margin += step[at[j]]

    coarse, side = at // 3, BINS // 3
    ranked = []
    for a in range(len(model.tables)):
        for b in range(a + 1, len(model.tables)):
            g, h = sums(coarse[a] * side + coarse[b], side * side)
            gain = _grow_pair(g.reshape(side, side), h.reshape(side, side))[1]
            ranked.append((-gain, a, b))
    model.pairs = [(a, b) for _, a, b in sorted(ranked)[:PAIRS]]
    model.pair_tables = [np.zeros((side, side)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            cell = coarse[a] * side + coarse[b]
            g, h = sums(cell, side * side)
            step = RATE * _grow_pair(g.reshape(side, side), h.reshape(side, side))[0]
            t += step
            margin += step.ravel()[cell]
    return model


def fit_quality(
    features: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality"
) -> AdditiveModel:
    """Fit on about ``SAMPLE_ROWS`` labelled documents among those ``usable``.

    A document labelled more than once has the label of most rows, good if they tie; one that
    repeats counts once. A threshold on the hash of the id draws the sample, so its size is
    bounded and it does not depend on the layout of the files.
    """
    per_doc = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    )
    per_doc = written(per_doc, "labels")
    share = min(1.0, SAMPLE_ROWS / max(1, per_doc.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = (
        features.where(drawn)
        .groupBy("doc_id")
        .agg(F.min("features").alias("features"))
        .join(per_doc.where(drawn), "doc_id")
        .select("doc_id", "label", "features")
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in rows], "f8").reshape(len(rows), len(FEATURES))
    return fit_additive(x, np.array([r["label"] for r in rows], "f8"))


def _score(model: AdditiveModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy()
            x = flat.reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(x), pa.float64())],
                names=["doc_id", "score"],
            )

    return score


def score_quality(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id, score`` of every row; empty texts are scored like any other."""
    prepare_workers(features.sparkSession)
    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(_score(model), f"doc_id {kind}, score double")
