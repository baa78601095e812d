"""Language identification: the family first, then linear machines between its languages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lethe.llm.common import prepare_workers


UNKNOWN = "und"
LANGUAGE, SCORE = "lang_pred", "score"
FEATURES = 1 << 12  # hashed letter trigrams
PER_LANGUAGE = 400  # labelled documents per language that a model is fitted on, at most
LETTER = r"\p{L}"

# Bytes of lower-case text: letters and all bytes of longer characters keep a code, any other
# byte ends a word.
CODES = np.zeros(256, "u4")
CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
CODES[128:] = np.arange(27, 155)


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of trigram counts; word ends count as a letter."""
    codes = CODES[np.frombuffer(text.encode(), "u1")]
    codes = np.concatenate([[0], codes, [0]]).astype("u4")
    word = codes[1:] + codes[:-1] > 0
    codes = codes[np.concatenate([[True], word])]  # one word end between words
    if len(codes) < 3:
        return np.zeros(FEATURES, "f4")
    mixed = (codes[:-2] * 24593 + codes[1:-1] * 769 + codes[2:]) * np.uint32(2654435761)
    counts = np.bincount(mixed >> 20, minlength=FEATURES)
    root = np.sqrt(counts).astype("f4")
    return root / np.linalg.norm(root)


def fit_machine(x: np.ndarray, positive: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype("f8")
    y = np.where(positive, 1.0, -1.0)
    # Classes of unequal size count the same.
    limit = np.where(positive, c * len(y) / (2 * positive.sum()), c * len(y) / (2 * (~positive).sum()))
    square = (x * x).sum(axis=1)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (w @ x[i])) / square[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype("f4")


def group_families(languages: list[str], means: np.ndarray) -> list[list[str]]:
    """Merge the languages whose mean vectors are closest until about the root of their number
    of families is left."""
    families = [[i] for i in range(len(languages))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    near = unit @ unit.T
    while len(families) > max(1, round(len(languages) ** 0.5)):
        a, b = max(
            combinations(range(len(families)), 2),
            key=lambda p: near[np.ix_(families[p[0]], families[p[1]])].mean(),
        )
        families[a] += families.pop(b)
    return [sorted(languages[i] for i in family) for family in families]


class LanguageModel:
    """Families, one machine per family, and one per pair of languages within a family."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        languages = sorted(set(lang))
        means = np.array([x[lang == name].mean(axis=0) for name in languages])
        self.families = group_families(languages, means) if languages else []
        family = np.array(
            [next(i for i, f in enumerate(self.families) if name in f) for name in lang], int
        )
        machines = []
        if len(self.families) > 1:
            machines += [fit_machine(x, family == i) for i in range(len(self.families))]
        self.pairs: list[list[tuple[int, int, int]]] = []
        for members in self.families:
            own = []
            for a, b in combinations(range(len(members)), 2):
                both = (lang == members[a]) | (lang == members[b])
                own.append((a, b, len(machines)))
                machines.append(fit_machine(x[both], lang[both] == members[a]))
            self.pairs.append(own)
        self.weights = np.array(machines, "f4").reshape(len(machines), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and confidence of one feature vector.

        Confidence is the logistic of the lead of the family, times that of the winner's
        weakest duel.
        """
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        best, sure = 0, 1.0
        if len(self.families) > 1:
            order = np.argsort(-margins[: len(self.families)], kind="stable")
            best = int(order[0])
            sure = _logistic(float(margins[order[0]] - margins[order[1]]))
        members, duels = self.families[best], self.pairs[best]
        wins = np.zeros(len(members))
        lead = np.zeros(len(members))
        weakest = np.full(len(members), np.inf)
        for a, b, machine in duels:
            m = float(margins[machine])
            wins[a if m >= 0 else b] += 1
            lead[a] += m
            lead[b] -= m
            weakest[a], weakest[b] = min(weakest[a], m), min(weakest[b], -m)
        winner = int(np.lexsort((-lead, -wins))[0])
        if duels:
            sure *= _logistic(2 * float(weakest[winner]))
        return members[winner], min(max(sure, 0.0), 1.0)


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-2 * min(max(z, -30.0), 30.0))))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, values = [], []
        for text in pc.utf8_lower(batch.column("text")):
            x = features(text.as_py())
            at = np.flatnonzero(x)
            places.append(at.astype("<u2").tobytes())
            values.append(x[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            names=["lang", "places", "features"],
        )


def fit_languages(
    df: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> LanguageModel:
    """Fit on at most ``per_language`` documents per language among those ``usable``.

    Counts per language fix a threshold on the hash of the id, which leaves about twice the
    sample; the smallest hashes of these are taken. So the sample's size is bounded, it does
    not depend on the layout of the files, and only sampled texts move.
    """
    prepare_workers(df.sparkSession)
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    labelled = df.where(
        usable & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    ).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    # Counting need not read texts.
    counts = (
        df.where(usable & F.col(lang_col).isNotNull())
        .groupBy(F.col(lang_col).alias("lang"))
        .agg(F.count("*").alias("n"))
        .withColumn("threshold", F.lit(float(2 * per_language << 30)) / F.col("n"))
    )
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    sample = (
        # One row per language: small enough for every task, so no text is shuffled for it.
        labelled.join(F.broadcast(counts.select("lang", "threshold")), "lang")
        .where(F.col("draw") < F.col("threshold"))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= per_language)
        .select("lang", "text")
        .mapInArrow(_sparse, "lang string, places binary, features binary")
    )
    rows = sample.collect()  # per_language rows of a few kilobytes for each language
    # Rows come in no fixed order; the fit must not depend on it.
    rows.sort(key=lambda r: (r["lang"], bytes(r["places"]), bytes(r["features"])))
    x = np.zeros((len(rows), FEATURES), "f4")
    for i, row in enumerate(rows):
        x[i, np.frombuffer(row["places"], "<u2")] = np.frombuffer(row["features"], "<f4")
    return LanguageModel(x, np.array([r["lang"] for r in rows], object))


def _predict(model: LanguageModel):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = pc.match_substring_regex(batch.column(0), LETTER).to_pylist()
            lower = pc.utf8_lower(batch.column(0))
            names, scores = [], []
            for has_letter, text in zip(lettered, lower, strict=True):
                if has_letter and model.families:
                    name, score = model.predict(features(text.as_py()))
                else:
                    name, score = UNKNOWN, 0.0
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                batch.columns[1:] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=batch.schema.names[1:] + [LANGUAGE, SCORE],
            )

    return predict


def predict_languages(
    df: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text"
) -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score``.

    The whole text decides, nothing else. A null text, or one without a letter, is ``und``
    with score 0, and so is everything if no labelled document was there to learn from. A
    column of ``keep`` that has the name of an added one is left out.
    """
    prepare_workers(df.sparkSession)
    kept = [c for c in keep if c.lower() not in (LANGUAGE, SCORE)]
    rows = df.select(F.col(text_col).alias("input"), *kept)
    schema = StructType(
        [*rows.schema.fields[1:], StructField(LANGUAGE, StringType()), StructField(SCORE, DoubleType())]
    )
    return rows.mapInArrow(_predict(model), schema)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether the id falls into this fold; a null id into none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
