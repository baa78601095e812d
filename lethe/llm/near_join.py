"""N-gram Jaccard join of documents by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import free_name, prepare_workers, with_row_key, written
from lethe.llm.components import connected_components
from lethe.llm.shingles import TOKENS, drawn, mix, set_name, shingle_set, sketch

SIMILARITY = 0.8
RECALL = 0.999  # of a pair at exactly this similarity
BUCKET = 2048  # sets compared with one another by one task
DEPTH = 3  # buckets still larger after so many splits are compared in tiles
REPEATS = 3  # independent choices when a large bucket is split again
TILE = 512  # sets on a side of an exact tile, and their shingles
TILE_SHINGLES = 1 << 19
COLUMNS = 1 << 13  # shingles counted at once in a tile

# Two sets that agree at fewer positions than four deviations below the expected number are
# not looked at again.
MATCHES = math.floor(
    SIMILARITY * TOKENS - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) * TOKENS)
)


def found_per_run(depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold shares a bucket after ``depth`` splits.

    It shares one chosen token on average at the first split and ``REPEATS`` at each further
    one: a branching process.
    """
    chance = 1.0
    for _ in range(depth - 1):
        chance = 1 - math.exp(-REPEATS * chance)
    return 1 - math.exp(-chance)


def runs_needed(recall: float = RECALL) -> int:
    """Runs that find a pair with this chance, even one whose buckets are all split fully."""
    return math.ceil(math.log(1 - recall) / math.log(1 - found_per_run()))


# Sets and sketches


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sizes, sketches, marks = [], [], [], []
        for text in batch.column("text"):
            shingles = shingle_set(text.as_py())
            names.append(set_name(shingles))
            sizes.append(len(shingles))
            values = sketch(shingles)
            sketches.append(values.tobytes())
            marks.append(values.astype("u1").tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row_key"),
                pa.array(names, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(sketches, pa.binary()),
                pa.array(marks, pa.binary()),
            ],
            names=["doc_id", "row_key", "set", "n", "sketch", "marks"],
        )


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), TOKENS)


# Splitting


def _choose(sketches: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child buckets: each token of a set is chosen with chance 1 / (0.8 TOKENS).

    The choice depends on path, position and token alone, so all sets of a bucket that hold a
    token choose it together.
    """
    positions = drawn(6, TOKENS)
    draw = mix((sketches.astype("u8") + positions) ^ paths[:, None])
    row, at = np.nonzero(draw < np.uint64(2**64 / (SIMILARITY * TOKENS)))
    return row, mix(draw[row, at] + np.uint64(1)).view("i8")


def _first_split(runs: int):
    roots = drawn(7, runs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _sketches(batch.column("sketch"))
            for root in roots:
                row, child = _choose(values, np.full(len(values), root, "u8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("set").take(pa.array(row)), pa.array(child)],
                    names=["set", "bucket"],
                )

    return split


def _next_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    again = drawn(8, REPEATS)
    for batch in batches:
        paths = batch.column("bucket").to_numpy().view("u8")
        values = _sketches(batch.column("sketch"))
        for repeat in again:
            row, child = _choose(values, paths ^ repeat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("set").take(pa.array(row)), pa.array(child)], names=["set", "bucket"]
            )


# Groups of rows that lie together


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of rows with equal key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        edges = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and keys[a] != name:
                yield pa.Table.from_batches(held)
                held = []
            name = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each row to the first row of its component, of a symmetric relation."""
    edges, left = [], near.any(axis=1)
    while left.any():
        first = int(left.argmax())
        inside = np.zeros(len(near), bool)
        inside[first] = True
        fresh = inside
        while fresh.any():
            reached = near[fresh].any(axis=0)
            fresh = reached & ~inside
            inside |= reached
        edges += [(first, int(i)) for i in np.flatnonzero(inside) if i != first]
        left &= ~inside
    return edges


EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between sets of a bucket, or of a pair of bucket chunks, that may be similar."""
    for group in grouped(batches, "tile"):
        sets = group.column("set").to_pylist()
        if len(sets) < 2:
            continue
        sizes = group.column("n").to_numpy()
        marks = b"".join(group.column("marks").to_pylist())
        values = np.frombuffer(marks, "u1").reshape(len(sets), TOKENS)
        near = np.zeros((len(sets), len(sets)), bool)
        rows = max(1, (1 << 22) // (len(sets) * TOKENS))
        for at in range(0, len(sets), rows):
            part = slice(at, at + rows)
            near[part] = (values[part, None] == values[None]).sum(axis=2) >= MATCHES
        low = np.minimum(sizes[:, None], sizes[None])
        near &= low >= SIMILARITY * np.maximum(sizes[:, None], sizes[None])
        np.fill_diagonal(near, False)
        edges = _forest(near)
        if edges:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sets[a] for a, _ in edges], pa.binary()),
                    pa.array([sets[b] for _, b in edges], pa.binary()),
                ],
                schema=EDGES,
            )


def _laid(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows of a key in one task, side by side."""
    return df.repartition(key).sortWithinPartitions(key, *more)


def candidate_links(sets: DataFrame, recall: float = RECALL) -> DataFrame:
    """``a, b``: links that join all pairs of sets found to be possibly similar.

    Each run splits the sets by chosen tokens; a bucket of up to ``BUCKET`` sets is compared, a
    larger one split again by tokens chosen for its path, ``REPEATS`` times. What is larger
    after ``DEPTH`` splits is compared chunk by chunk. Runs are repeated until the recall is
    reached; all go through the same jobs. Buckets are compared by one byte of each sketch
    position, which can only add candidates.
    """
    links = None
    nodes = sets.select("set", "sketch").mapInArrow(
        _first_split(runs_needed(recall)), "set binary, bucket long"
    )
    for depth in range(1, DEPTH + 1):
        nodes = written(nodes, "buckets")
        counts = nodes.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        shared = written(nodes.join(counts, "bucket"), "shared")
        more = depth < DEPTH
        leaves = shared.where(F.col("members") <= BUCKET) if more else shared
        found = _compared(leaves, sets.select("set", "n", "marks"))
        links = found if links is None else links.unionByName(found)
        large = shared.where(F.col("members") > BUCKET)
        if not more or large.isEmpty():
            break
        nodes = large.join(sets.select("set", "sketch"), "set").mapInArrow(
            _next_split, "set binary, bucket long"
        )
    return links


def _compared(leaves: DataFrame, sets: DataFrame) -> DataFrame:
    """Compare the members of each bucket; one above the limit as pairs of chunks of it."""
    chunks = F.ceil(F.col("members") / (BUCKET // 2)).cast("int")
    own = F.pmod(F.xxhash64("set"), chunks).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda j: F.md5(
            F.concat_ws(":", F.col("bucket"), F.least("own", j), F.greatest("own", j))
        ),
    )
    whole = F.array(F.md5(F.col("bucket").cast("string")))
    tiled = (
        leaves.withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("tile", F.explode(F.when(F.col("members") <= BUCKET, whole).otherwise(others)))
        .select("set", F.unhex("tile").alias("tile"))
    )
    rows = tiled.join(sets, "set")
    return written(_laid(rows, "tile").mapInArrow(_compare, "a binary, b binary"), "links")


# Exact tiles


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, from products of slices of the membership
    matrix; shingles of a single set are left out."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    column, owner = number[column[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), "f8")
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        member = np.zeros((len(sets), COLUMNS), "f4")
        member[owner[a:b], column[a:b] - at] = 1
        total += member @ member.T
    return total


VERIFIED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per tile, how many documents each set is linked to, and a forest of the links."""
    for group in grouped(batches, "tile"):
        names = group.column("set").to_pylist()
        if len(names) < 2:
            continue
        sets = [shingle_set(t) for t in group.column("text").to_pylist()]
        side = group.column("side").to_numpy()
        copies = group.column("copies").to_numpy()
        sizes = np.array([len(s) for s in sets], "f8")
        common = _intersections(sets)
        near = common / (sizes[:, None] + sizes[None] - common) >= SIMILARITY
        np.fill_diagonal(near, False)
        if side[0]:  # two chunks: only pairs across
            near &= side[:, None] != side[None]
        links = near @ copies
        linked = np.flatnonzero(links)
        edges = _forest(near)
        if len(linked):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in linked] + [names[a] for a, _ in edges], pa.binary()),
                    pa.array([None] * len(linked) + [names[b] for _, b in edges], pa.binary()),
                    pa.array([*links[linked].tolist(), *[0] * len(edges)], pa.int64()),
                ],
                schema=VERIFIED,
            )


def _tiles(members: DataFrame) -> DataFrame:
    """Explode the members of candidate components to tiles, so that every pair of similar
    size meets in exactly one.

    Side 0 marks a tile that compares a chunk with itself, 1 and 2 the chunks of any other. A
    component that fits is one tile. A larger one is parted into bands of set size, where
    similar sets lie in the same or in neighbouring bands, and bands into chunks by hash.
    """
    band = F.floor(F.log("n") / F.lit(-math.log(SIMILARITY - 0.01))).cast("int")
    totals = members.groupBy("component").agg(
        F.count("*").alias("c_sets"), F.sum("n").alias("c_size")
    )
    sized = members.join(totals, "component").withColumn("band", band)
    fits = (F.col("c_sets") <= TILE) & (F.col("c_size") <= TILE_SHINGLES)
    single = sized.where(fits).select(
        "set", "row_key", "copies",
        F.array(
            F.struct(F.md5("component").alias("tile"), F.lit(0).alias("side"))
        ).alias("tiles"),
    )
    large = sized.where(~fits)
    chunks = large.groupBy("component", "band").agg(
        F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES))
        .cast("int")
        .alias("chunks")
    )
    near_by = chunks.select(
        "component",
        F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"),
        F.struct("band", "chunks").alias("other"),
    ).groupBy("component", "band").agg(F.collect_list("other").alias("others"))
    placed = large.join(chunks, ["component", "band"]).join(near_by, ["component", "band"])
    own = F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int")

    def with_other(other):
        def tile(j):
            mine_first = (F.col("band") < other["band"]) | (
                (F.col("band") == other["band"]) & (F.col("own") <= j)
            )
            mine = F.concat_ws(".", F.col("band"), F.col("own"))
            theirs = F.concat_ws(".", other["band"], j)
            return F.struct(
                F.md5(
                    F.concat_ws(
                        ":",
                        F.hex("component"),
                        F.when(mine_first, mine).otherwise(theirs),
                        F.when(mine_first, theirs).otherwise(mine),
                    )
                ).alias("tile"),
                F.when((F.col("band") == other["band"]) & (F.col("own") == j), 0)
                .when(mine_first, 1)
                .otherwise(2)
                .alias("side"),
            )

        return F.transform(F.sequence(F.lit(0), other["chunks"] - 1), tile)

    many = placed.withColumn("own", own).select(
        "set", "row_key", "copies", F.flatten(F.transform("others", with_other)).alias("tiles")
    )
    return single.unionByName(many)


def near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    recall: float = RECALL,
    row_key: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, row_key, set_id, class_id, links, kept``.

    Documents are sets of shingles of five words (a shorter text is one shingle). ``links`` is
    the number of other documents whose Jaccard similarity is at least 0.8, equal sets
    included; ``class_id`` is the smallest id reached over links, ``set_id`` the smallest with
    the same set. One document of each class is ``kept``, the one of the smallest id (a null
    id comes last; of rows that repeat it, one). A text that is null, or has no words, links to
    nothing and is kept.

    Candidates come from chosen paths over sketches (:func:`candidate_links`); then all pairs
    of similar size within a component of candidates are compared exactly on their whole
    texts, in tiles. Pairs are counted, never emitted, so a group of near copies of any size
    gives as many rows as it has sets. Copies stand for one another from the beginning.
    With ``row_key`` that binary column, different in all rows, is returned as ``row_key``.
    """
    prepare_workers(df.sparkSession)
    if row_key is None:
        row_key = free_name("row_key", df.columns)
        df = with_row_key(df, row_key).withColumn(row_key, F.unhex(F.md5(row_key)))
    keyed = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(row_key).alias("row_key"),
        F.col(text_col).alias("text"),
    )
    kind = keyed.schema["doc_id"].dataType.simpleString()
    docs = written(
        keyed.mapInArrow(
            _sketch, f"doc_id {kind}, row_key binary, `set` binary, n long, sketch binary, marks binary"
        ),
        "sketches",
    )
    first = F.min(
        F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key", "n", "sketch", "marks")
    )
    sets = written(
        docs.where("n > 0")
        .groupBy("set")
        .agg(first.alias("first"), F.count("*").alias("copies"))
        .select("set", "copies", "first.*"),
        "sets",
    )
    candidates = connected_components(candidate_links(sets, recall))
    members = written(
        candidates.withColumnRenamed("node", "set").join(sets.drop("sketch", "marks"), "set"), "members"
    )
    tiled = written(_tiles(members), "tiles")
    texts = (
        keyed.select("row_key", "text")
        .join(tiled, "row_key")
        .select("set", "copies", "text", F.explode("tiles").alias("at"))
        .select("set", "copies", "text", F.unhex("at.tile").alias("tile"), "at.side")
    )
    verified = written(
        _laid(texts, "tile", "side").mapInArrow(_verify, "a binary, b binary, links long"),
        "verified",
    )
    links = verified.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(
        F.sum("links").alias("others")
    )
    classes = connected_components(verified.where("b IS NOT NULL").select("a", "b"))
    named = sets.select("set", "copies", F.struct("missing", "doc_id", "row_key").alias("own"))
    in_class = classes.withColumnRenamed("node", "set").join(named, "set")
    heads = in_class.groupBy("component").agg(F.min("own").alias("head"))
    described = (
        named.join(links, "set", "left")
        .join(in_class.join(heads, "component").select("set", "head"), "set", "left")
        .select(
            "set",
            F.col("own.doc_id").alias("set_id"),
            F.coalesce("head", "own").alias("head"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    rows = docs.select("doc_id", "row_key", F.when(F.col("n") > 0, F.col("set")).alias("set"))
    return rows.join(described, "set", "left").select(
        "doc_id",
        "row_key",
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
        F.when(F.col("set").isNull(), F.col("doc_id"))
        .otherwise(F.col("head.doc_id"))
        .alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce(F.col("row_key") == F.col("head.row_key"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`near_copies` keeps, all columns as they are."""
    key = free_name("row_key", df.columns)
    keyed = with_row_key(df, key).withColumn(key, F.unhex(F.md5(key)))
    gone = near_copies(keyed, id_col, text_col, row_key=key).where(~F.col("kept"))
    return keyed.join(
        gone.select(F.col("row_key").alias(key)), key, "left_anti"
    ).select(*df.columns)
