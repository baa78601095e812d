"""Quality rules on text statistics: fixed limits, then robust outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.common import free_name, prepare_workers, written

WHITE_BYTES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5  # words of a passage that counts as repeated

STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_capitals",
    "n_marks",
)

_BYTE = np.arange(256)
_is_white = np.isin(_BYTE, list(WHITE_BYTES))
_is_symbol = np.isin(_BYTE, list(SYMBOLS))
_starts_char = (_BYTE & 0xC0) != 0x80
_is_capital = (_BYTE >= ord("A")) & (_BYTE <= ord("Z"))
_is_mark = np.isin(_BYTE, [b for b in range(33, 127) if not chr(b).isalnum()])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of :data:`WINDOW` words that the text has at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    for word in words:
        known.setdefault(word, len(known))
    if len(known) == len(words):
        return 0
    codes = np.fromiter(map(known.__getitem__, words), "i8", len(words))
    # Windows are numbered exactly: pairs, pairs of pairs, and the last word.
    size = len(words) + 1
    pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * size + pairs[2:], return_inverse=True)[1]
    fives = np.unique(fours[:n] * size + codes[WINDOW - 1 :], return_inverse=True)[1]
    twice = np.bincount(fives)[fives] > 1
    cover = np.zeros(len(words) + 1, "i8")
    cover[:n] += twice
    cover[WINDOW : WINDOW + n] -= twice
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in :data:`STATISTICS`; zeros for null."""
    if not text:
        return (0,) * len(STATISTICS)
    data = text.encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    lines = [line for line in data.split(b"\n") if line.strip(WHITE_BYTES)]
    return (
        len(words),
        int(counts[_starts_char & ~_is_white].sum()),
        int(counts[_is_symbol].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        int(counts[_is_capital].sum()),
        int(counts[_is_mark].sum()),
    )


def document_statistics(
    df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id", "lang", "source")
) -> DataFrame:
    """The kept columns and :data:`STATISTICS` of every whole text, in one scan. A null text has
    zeros. A kept column may have the name of a statistic, which then gets an underscore."""
    prepare_workers(df.sparkSession)
    names = [free_name(n, keep) for n in STATISTICS]
    source = df.select(*keep, F.col(text_col).alias(free_name("text", keep)))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = np.array([text_statistics(t.as_py()) for t in texts], "i8").reshape(-1, len(names))
            made = [pa.array(rows[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *names]
            )

    return source.mapInArrow(work, schema)


# The vector that is judged, in SCALE-ths: whole numbers, so sums over any number of rows are
# exact and do not depend on their order.
SCALE = 256
FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
# No feature is known better than this; without it one that nearly all texts share has no spread.
FLOOR = (1.0, 0.15, 0.1, 0.1, 0.1, 0.05, 0.05)

MIN_ROWS = 50  # of a group with an estimate of its own
HALF = 0.75  # share of a group that the determinant is least over
MAX_STEPS = 12
BINS = 16  # of distances, per doubling
INLIERS, OUTLIERS = 0.975, 0.999  # quantiles of squared distances of a normal sample


def feature_columns(stat: dict[str, Column]) -> list[Column]:
    """Logarithms of sizes, roots of rare shares."""
    one = F.lit(1)
    words, chars = F.greatest(stat["n_words"], one), F.greatest(stat["word_chars"], one)
    values = [
        F.log2(1 + stat["n_words"]),
        F.log2((stat["word_chars"] + 1) / words),
        F.sqrt(stat["n_symbols"] / chars),
        stat["n_dup_lines"] / F.greatest(stat["n_lines"], one),
        stat["n_repeat_words"] / words,
        F.sqrt(stat["n_capitals"] / chars),
        F.sqrt(stat["n_marks"] / chars),
    ]
    return [F.round(v * SCALE).cast("long").alias(n) for v, n in zip(values, FEATURES, strict=True)]


def chi_square_quantile(share: float, dimensions: int) -> float:
    def below(x: float) -> float:
        a, half = dimensions / 2, x / 2
        term = total = 1 / a
        k = 0
        while term > total * 1e-17:
            k += 1
            term *= half / (a + k)
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 1e-9, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return low


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
ESTIMATE = "g long, start int, n long, median double, spread double, mean array<double>, inverse array<double>"


def ridge_estimate(n: int, sums: Sequence[int], products: Sequence[int]):
    """Logarithm of the determinant of the covariance with the floor added, mean, and the upper
    half of the inverse covariance, from exact sums."""
    size = len(FEATURES)
    covariance = np.zeros((size, size))
    for (i, j), both in zip(PAIRS, products, strict=True):
        exact = n * int(both) - int(sums[i]) * int(sums[j])
        covariance[i, j] = covariance[j, i] = exact / (n * n)
    covariance += np.diag(np.square(np.array(FLOOR) * SCALE))
    inverse = np.linalg.inv(covariance)
    weights = [float(inverse[i, j]) * (1 if i == j else 2) for i, j in PAIRS]
    return float(np.linalg.slogdet(covariance)[1]), [int(s) / n for s in sums], weights


def _estimates(batches):
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            spread, mean, inverse = ridge_estimate(r.n, r.sums, r.products)
            rows.append((r.g, r.start, r.n, r.median, spread, mean, inverse))
        names = [f.split()[0] for f in ESTIMATE.split(", ")]
        yield type(batch)(rows, columns=names)


def _distance(mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of the row's features."""
    off = [F.col(n) - mean[i] for i, n in enumerate(FEATURES)]
    return sum(
        (inverse[k] * off[i] * off[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0)
    )


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(1e-6))) * BINS).cast("int")


def _sums(distances: DataFrame, *keys: str) -> DataFrame:
    return distances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(n) for n in FEATURES]).alias("sums"),
        F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in PAIRS]).alias("products"),
    )


def _added(arrays: str, size: int) -> Column:
    return F.array(*[F.sum(F.col(arrays)[i]) for i in range(size)]).alias(arrays)


def _concentrate(distances: DataFrame, label: str) -> DataFrame:
    """Estimates from the rows of least distance (``g, start, distance`` and features).

    Rows are added up per bin of distance before anything is shuffled, so a group of any size
    is a few hundred rows here. The bins up to ``HALF`` of the group's rows give the estimate;
    a bin is taken whole.
    """
    binned = _sums(distances.withColumn("bin", _bin(F.col("distance"))), "g", "start", "bin")
    own = Window.partitionBy("g", "start")
    ahead = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn(
        "all", F.sum("n").over(own)
    )
    chosen = placed.where(F.col("ahead") < F.ceil(F.col("all") * F.lit(HALF)))
    half = F.col("ahead") < F.ceil(F.col("all") / 2)
    middle = F.pow(F.lit(2.0), (F.max(F.when(half, F.col("bin"))) + 0.5) / BINS)
    summed = chosen.groupBy("g", "start").agg(
        F.sum("n").alias("n"), middle.alias("median"), _added("sums", len(FEATURES)), _added("products", len(PAIRS))
    )
    return written(summed.mapInPandas(_estimates, ESTIMATE), label)


BROADCAST_GROUPS = 10_000  # rows of a few hundred bytes
SALTS = 64


def _each_salt() -> Column:
    return F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))


def _of_group(rows: DataFrame, values: DataFrame, few: bool) -> DataFrame:
    """Rows with the values of their group ``g``, of which there is one row each (and start).

    A few groups are sent to all tasks. Beyond ``BROADCAST_GROUPS`` the values are repeated for
    each salt, so that a group with a third of the rows meets them in ``SALTS`` places.
    """
    if few:
        return rows.join(F.broadcast(values), "g")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)))
    copies = values.withColumn("salt", _each_salt())
    return salted.join(copies, ["g", "salt"]).drop("salt")


def _first_distances(rows: DataFrame, few: bool) -> DataFrame:
    """Two starts: features by median and median deviation, summed up, and the largest of them.
    Features are whole numbers of a few thousand values, so medians are exact counts."""
    medians = written(
        rows.groupBy("g").agg(F.array(*[F.median(n) for n in FEATURES]).alias("medians")), "medians"
    )
    off = _of_group(rows, medians, few).select(
        "*", *[F.abs(F.col(n) - F.col("medians")[i]).alias(f"off{i}") for i, n in enumerate(FEATURES)]
    )
    spread = off.groupBy("g").agg(
        F.array(
            *[
                F.greatest(F.median(f"off{i}") * 1.4826, F.lit(FLOOR[i] * SCALE))
                for i in range(len(FEATURES))
            ]
        ).alias("spreads")
    )
    known = written(medians.join(spread, "g"), "spreads")
    each = [
        F.pow((F.col(n) - F.col("medians")[i]) / F.col("spreads")[i], F.lit(2))
        for i, n in enumerate(FEATURES)
    ]
    starts = F.array(sum(each, F.lit(0.0)), F.greatest(*each))
    return _of_group(rows, known, few).select(
        "g", *FEATURES, F.posexplode(starts).alias("start", "distance")
    )


def group_numbers(rows: DataFrame) -> DataFrame:
    """``lang, source, g``: groups of at least ``MIN_ROWS`` rows have a number of their own.

    Smaller ones of a language share one, and what is still smaller, of all languages, another.
    Groups that stay below ``MIN_ROWS`` are not listed.
    """
    counts = written(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    small = counts.where(F.col("n") < MIN_ROWS)
    of_lang = small.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"))
    rest = of_lang.where(F.col("n_lang") < MIN_ROWS).agg(F.sum("n_lang").alias("n_rest"))
    joined = counts.join(of_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn(
        "n_rest", F.lit(rest.first()[0] or 0)
    )
    level = (
        F.when(F.col("n") >= MIN_ROWS, 0)
        .when(F.col("n_lang") >= MIN_ROWS, 1)
        .when(F.col("n_rest") >= MIN_ROWS, 2)
    )
    leveled = joined.select("lang", "source", level.alias("level")).where("level IS NOT NULL")
    named = leveled.select(
        "lang",
        "source",
        "level",
        F.when(F.col("level") < 2, F.col("lang")).alias("g_lang"),
        F.when(F.col("level") < 1, F.col("source")).alias("g_source"),
    )
    numbers = written(
        named.select("level", "g_lang", "g_source").distinct().withColumn("g", F.monotonically_increasing_id()),
        "groups",
    )
    a, b = named.alias("a"), numbers.alias("b")
    same = F.lit(True)
    for c in ("level", "g_lang", "g_source"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select("a.lang", "a.source", "b.g")


def least_determinants(rows: DataFrame, few: bool) -> DataFrame:
    """Final estimate per group (``g`` and features): of two starts, each concentrated until no
    determinant falls any more, the one of least determinant, weighted again over its inliers."""
    estimates = _concentrate(_first_distances(rows, few), "start")
    for _ in range(MAX_STEPS):
        both = _of_group(rows, estimates.select("g", "start", "mean", "inverse"), few)
        stepped = _concentrate(
            both.withColumn("distance", _distance(F.col("mean"), F.col("inverse"))), "step"
        )
        # A group whose determinant does not fall stays where it is, whatever others do.
        fell = F.col("b.spread") < F.col("a.spread") - 1e-9
        columns = [F.when(fell, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in estimates.columns]
        estimates = written(
            estimates.alias("a").join(stepped.alias("b"), ["g", "start"]).select(*columns, fell.alias("fell")),
            "estimates",
        )
        moved = estimates.where("fell").limit(1).count()
        estimates = estimates.drop("fell")
        if not moved:
            break
    best = F.min_by(
        F.struct("mean", "inverse", "median"), F.struct(F.round("spread", 9), "start")
    )
    chosen = written(estimates.groupBy("g").agg(best.alias("e")).select("g", "e.*"), "best")
    size = len(FEATURES)
    usual = F.greatest(F.col("median") / chi_square_quantile(0.5, size), F.lit(1.0))
    inside = _of_group(rows, chosen, few).where(
        _distance(F.col("mean"), F.col("inverse")) <= usual * chi_square_quantile(INLIERS, size)
    )
    summed = _sums(inside, "g").select(
        "g", F.lit(0).alias("start"), "n", F.lit(0.0).alias("median"), "sums", "products"
    )
    return written(summed.mapInPandas(_estimates, ESTIMATE).select("g", "mean", "inverse"), "estimates")


def judge_documents(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The kept columns, :data:`STATISTICS`, ``base_failed``, ``distance`` and ``kept``.

    ``base_failed`` holds where the fixed limits do: fewer than ten words, or over a fifth of
    the words in passages that the text repeats. The others' vectors are held against the
    minimum-covariance-determinant estimate of their language and source: ``distance`` is the
    squared Mahalanobis distance, and a text beyond the ``OUTLIERS`` quantile is not kept.

    All rows take part in the estimates. Each step adds rows up per group and bin of distance
    within the tasks, so a group of any size is spread. Groups below ``MIN_ROWS`` rows are
    judged together with the other small ones of their language, and of all languages; if
    those are still fewer, there is nothing to judge by, ``distance`` is null and they are kept
    unless ``base_failed``. Null languages and sources are groups. A null or empty text fails
    the limits. Repeated rows count as often as they stand. An empty table gives no rows. Extra
    columns are not read; kept ones may have any name, new ones then get an underscore.
    """
    inner = [f"keep_{i}" for i in range(len(keep))]
    source = df.select(
        *[F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)],
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.col(text_col).alias("text"),
    )
    counted = document_statistics(source, "text", [*inner, "lang", "source"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = written(
        counted.select(
            "*", *feature_columns({n: F.col(n) for n in STATISTICS}), failed.alias("base_failed")
        ),
        "statistics",
    )
    groups = group_numbers(stats.where(~F.col("base_failed"))).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "g"
    )
    groups = written(groups, "numbered")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    if few:
        salt = F.lit(0).cast("long")
        groups = F.broadcast(groups.withColumn("g_salt", salt))
    else:
        salt = F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS))
        groups = groups.withColumn("g_salt", _each_salt())
    rows = written(
        stats.withColumn("salt", F.when(~F.col("base_failed"), salt))
        .join(
            groups,
            F.col("lang").eqNullSafe(F.col("g_lang"))
            & F.col("source").eqNullSafe(F.col("g_source"))
            & (F.col("salt") == F.col("g_salt")),
            "left",
        )
        .select(*inner, *STATISTICS, *FEATURES, "base_failed", "g"),
        "judged",
    )
    in_groups = rows.where("g IS NOT NULL")
    estimates = least_determinants(in_groups.select("g", *FEATURES), few)
    # Rows without a group, of which no two need to meet, are told apart from those with one.
    alone = rows.where("g IS NULL").select(
        "*", F.lit(None).cast("array<double>").alias("mean"), F.lit(None).cast("array<double>").alias("inverse")
    )
    judged = (
        _of_group(in_groups, estimates, few)
        .unionByName(alone)
        .withColumn("distance", _distance(F.col("mean"), F.col("inverse")))
    )
    inside = F.coalesce(
        F.col("distance") <= chi_square_quantile(OUTLIERS, len(FEATURES)), F.lit(True)
    )
    made = {**{n: F.col(n) for n in STATISTICS}, "base_failed": F.col("base_failed"),
            "distance": F.col("distance"), "kept": ~F.col("base_failed") & inside}
    return judged.select(
        *[F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)],
        *[value.alias(free_name(name, keep)) for name, value in made.items()],
    )
