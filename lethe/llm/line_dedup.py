"""Line deduplication by an exact set-similarity join over rare-first token prefixes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import WHITE, free_name, with_row_key, written

SIMILARITY = 0.8
# Words share this many counters of how often they occur; the table of their classes goes to all
# tasks. With few counters a rare word takes the class of a frequent one that it shares with.
COUNTERS = 1 << 18
COUNTER_ROWS = 1 << 10  # counters in one row to the driver
RARITY_BITS = 56  # a token is its rarity class above this many bits of its hash


FILTER_BITS = 1 << 22  # of the filter on lines to fetch
MAPS = 4  # bitmaps of 64 places per set of a candidate pair
REPRESENTATIVES = 3  # tokens by which a set is first held against single others


def split_words(text: Column) -> Column:
    """Words of a text, parted by white space; a split at one character needs no pattern."""
    for white in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_rarity(texts: DataFrame) -> list[int]:
    """Class of each counter: the power of two below the number of words that share it.

    All words of all texts are counted, combined before the shuffle; the result has
    ``COUNTERS`` entries whatever the input.
    """
    words = texts.select(F.explode(split_words(F.col("text"))).alias("word"))
    counted = words.groupBy(
        F.pmod(F.xxhash64("word"), F.lit(COUNTERS)).cast("int").alias("counter")
    ).agg(F.floor(F.log2(F.count("*"))).cast("int").alias("rarity"))
    rows = (
        counted.groupBy((F.col("counter") / COUNTER_ROWS).cast("int").alias("row"))
        .agg(F.collect_list("counter").alias("counters"), F.collect_list("rarity").alias("rarities"))
        .collect()
    )
    found = [0] * COUNTERS
    for r in rows:
        for counter, rarity in zip(r["counters"], r["rarities"], strict=True):
            found[counter] = rarity
    return found


def token_order(words: Column, rarity: list[int]) -> Column:
    """Tokens of the words in one order for all lines: rare first, then by hash."""
    classes = F.from_json(F.lit(json.dumps(rarity)), "array<int>")
    mask = F.lit((1 << RARITY_BITS) - 1)

    def token(h: Column) -> Column:
        return F.shiftleft(
            F.get(classes, F.pmod(h, F.lit(COUNTERS)).cast("int")).cast("long"), RARITY_BITS
        ).bitwiseOR(h.bitwiseAND(mask))

    # Of plain numbers: the native sort and set need no comparison function.
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: token(F.xxhash64(w)))))


def least_overlap(n: Column, m: Column, similarity: float) -> Column:
    """Common tokens that sets of these sizes need."""
    share = similarity / (1 + similarity)
    return F.ceil((n + m) * F.lit(share) - F.lit(1e-9))


def _parities(words: Column) -> Column:
    """Parity of the words in each of 64 places: places that differ hold words not in common."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda bits, h: bits.bitwiseXOR(
            F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
        ),
    )


def line_sets(docs: DataFrame, rarity: list[int], similarity: float) -> DataFrame:
    """One row per line with words, written once: where it stands, two hashes that stand for its
    set of words, the set's size, parities and prefix. No text or word leaves this scan."""
    lines = docs.select(
        "doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).where(F.col("line").rlike(f"[^{WHITE}]"))
    words = split_words(F.col("line"))
    tokens = lines.select("doc_id", "row_key", "line_no", token_order(words, rarity).alias("t"))
    n = F.size("t")
    return written(
        tokens.select(
            "doc_id",
            "row_key",
            "line_no",
            F.xxhash64("t").alias("k1"),
            F.xxhash64(F.lit(1), "t").alias("k2"),
            n.alias("n"),
            _parities(F.col("t")).alias("bits"),
            # Half of a hash is enough to find candidates by.
            F.transform(
                F.slice("t", F.lit(1), prefix_length(n, similarity)),
                lambda t: t.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"),
            ).alias("prefix"),
        ),
        "lines",
    )


def _bitmaps(tokens: Column) -> Column:
    """Parity of the tokens in each of 64 places of ``MAPS`` bitmaps."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def step(maps, t):
        bit = F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int"))
        which = F.shiftright(t, 6).bitwiseAND(F.lit(MAPS - 1))
        return F.struct(
            *[
                maps[f"m{i}"].bitwiseXOR(F.when(which == i, bit).otherwise(zero)).alias(f"m{i}")
                for i in range(MAPS)
            ]
        )

    return F.aggregate(tokens, F.struct(*[zero.alias(f"m{i}") for i in range(MAPS)]), step)


def prefix_length(n: Column, similarity: float) -> Column:
    """Tokens of which a set shares one with every similar set that is not larger; with
    :func:`least_overlap` of two sets of its own size, with every one that is not smaller."""
    return (n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)) + 1).cast("int")


FIRST = ["missing", "doc_id", "row_key", "line_no"]


def distinct_sets(lines: DataFrame) -> DataFrame:
    """One row per token set with its first line, numbered."""
    first = F.min(
        F.struct(
            F.col("doc_id").isNull().alias("missing"),
            "doc_id", "row_key", "line_no", "n", "bits", "prefix",
        )
    )
    sets = (
        lines.groupBy("k1", "k2")
        .agg(first.alias("first"), F.count("*").alias("copies"))
        .select("k1", "k2", "copies", "first.*")
    )
    return written(sets.withColumn("id", F.monotonically_increasing_id()), "line-sets")


def _may_be_similar(a: dict[str, Column], b: dict[str, Column], similarity: float) -> Column:
    """Length and parity filters, which drop no pair that is similar enough."""
    need = least_overlap(a["n"], b["n"], similarity)
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    return (small >= large * F.lit(similarity) - F.lit(1e-9)) & (
        F.bit_count(a["bits"].bitwiseXOR(b["bits"])) <= a["n"] + b["n"] - 2 * need
    )


def representative_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: for each set ``b`` the sets that share one of its rarest tokens and whose first
    line lies in the document of least id.

    The representative of a token is a minimum, combined before the shuffle, and each set has
    at most ``REPRESENTATIVES`` of them, however large the group of near copies that it is in.
    """
    tokens = sets.select(
        "id", "doc_id", "n", "bits", F.explode(F.slice("prefix", 1, REPRESENTATIVES)).alias("token")
    )
    first = tokens.groupBy("token").agg(
        *[F.min_by(c, "doc_id").alias(f"a_{c}") for c in ("id", "n", "bits")]
    )
    a, b = ({"n": F.col(f"{p}n"), "bits": F.col(f"{p}bits")} for p in ("a_", ""))
    return (
        tokens.join(first, "token")
        .where((F.col("a_id") != F.col("id")) & _may_be_similar(a, b, similarity))
        .select(F.col("a_id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )


def candidate_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: sets that share a prefix token and pass the length, positional and parity
    filters; at least one of the two is still ``open``.

    Both sides are one and the same shuffled table. That the smaller set of a pair is met by a
    shorter prefix, as it has more tokens in common for its size, follows from the positional
    filter.
    """
    kept = ["id", "n", "bits", "open"]
    tokens = sets.select(*kept, F.posexplode("prefix").alias("pos", "token"))
    a, b = ({c: F.col(f"{p}.{c}") for c in (*kept, "pos", "token")} for p in "ab")
    need = least_overlap(a["n"], b["n"], similarity)
    return (
        tokens.alias("a")
        .join(
            tokens.alias("b"),
            (a["token"] == b["token"])
            & ((a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["id"] < b["id"])))
            & (a["open"] | b["open"])
            & _may_be_similar(a, b, similarity)
            & (F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= need),
        )
        .select(a["id"].alias("a"), b["id"].alias("b"))
        .distinct()
    )


def _maybe_among(rows: DataFrame, *keys: str) -> Column:
    """A test that holds for every key of ``rows`` and for few others while these are few.

    The keys are folded into ``FILTER_BITS`` bits, whatever their number, and go to the tasks
    as one small array; a full array only stops saving work.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    words = rows.groupBy(F.floor(h / 64).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    found = {r["at"]: r["bits"] for r in words}
    array = F.from_json(
        F.lit(json.dumps([found.get(i, 0) for i in range(FILTER_BITS // 64)])), "array<bigint>"
    )
    return F.get(array, F.floor(h / 64).cast("int")).bitwiseAND(bit) != 0


def similar_pairs(
    docs: DataFrame, sets: DataFrame, candidates: DataFrame, similarity: float
) -> DataFrame:
    """The candidates whose word sets have at least this Jaccard similarity, of 64-bit hashes
    of the whole words. Lines of candidates are taken out of their texts where these lie."""
    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    place = ["row_key", "line_no"]
    wanted = written(sets.join(ids, "id", "left_semi").select("id", *place), "line-wanted")
    lines = docs.select("row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hashed = F.transform(split_words(F.col("line")), lambda w: F.xxhash64(w))
    words = written(
        lines.where(_maybe_among(wanted, *place))
        .join(wanted, place)
        .select("id", F.array_distinct(hashed).alias("words"))
        .withColumn("maps", _bitmaps(F.col("words"))),
        "line-words",
    )
    # Bitmaps of more places part most of the pairs that are not similar before words travel.
    maps = words.select("id", F.size("words").alias("n"), "maps")
    rough = candidates.join(maps.select(*[F.col(c).alias(f"a_{c}") for c in maps.columns]), F.col("a") == F.col("a_id")).join(
        maps.select(*[F.col(c).alias(f"b_{c}") for c in maps.columns]), F.col("b") == F.col("b_id")
    )
    differ = sum(
        (F.bit_count(F.col(f"a_maps.m{i}").bitwiseXOR(F.col(f"b_maps.m{i}"))) for i in range(MAPS)),
        F.lit(0),
    )
    most = F.col("a_n") + F.col("b_n") - 2 * least_overlap(F.col("a_n"), F.col("b_n"), similarity)
    both = (
        rough.where(differ <= most)
        .select("a", "b")
        .join(words.select(F.col("id").alias("a"), F.col("words").alias("a_words")), "a")
        .join(words.select(F.col("id").alias("b"), F.col("words").alias("b_words")), "b")
    )
    common = F.size(F.array_intersect("a_words", "b_words"))
    union = F.size("a_words") + F.size("b_words") - common
    return both.where(common / union >= similarity).select("a", "b")


def later_sets(
    docs: DataFrame, sets: DataFrame, candidates: DataFrame, similarity: float
) -> DataFrame:
    """``id`` of the sets that come later than a similar one of the candidates."""
    pairs = similar_pairs(docs, sets, candidates, similarity)
    firsts = sets.select("id", F.struct(*FIRST).alias("first"))
    ordered = pairs.join(firsts.select(F.col("id").alias("a"), F.col("first").alias("a_first")), "a").join(
        firsts.select(F.col("id").alias("b"), F.col("first").alias("b_first")), "b"
    )
    later = F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a"))
    return ordered.select(later.alias("id")).distinct()


def find_repeated_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    row_key: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, row_key, n_lines, removed``, the last the ascending
    numbers (from 0) of the lines to remove.

    A line goes if an earlier one, by document id and line number, has a word set of Jaccard
    similarity at least ``similarity``, whether that one stays or not. Lines without words
    stay. A null text has no lines, an empty one a single empty line. A null id comes last;
    rows with the same id are ordered by where they lie. An empty table gives an empty result,
    extra columns are not read. With ``row_key`` that column, different in all rows, is
    returned as ``row_key``.
    """
    if row_key is None:
        row_key = free_name("row_key", df.columns)
        df = with_row_key(df, row_key).withColumn(row_key, F.unhex(F.md5(row_key)))
    docs = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(row_key).alias("row_key"),
        F.col(text_col).alias("text"),
    )
    lines = line_sets(docs, word_rarity(docs), similarity)
    sets = distinct_sets(lines)
    # First against one representative per token. What is later there needs no other witness:
    # of a group of near copies few stay open, and only these are held against all sets.
    met = written(representative_pairs(sets, similarity), "line-pairs")
    found = written(later_sets(docs, sets, met, similarity), "line-later")
    marked = sets.join(found.withColumn("marked", F.lit(True)), "id", "left")
    candidates = written(
        candidate_pairs(marked.withColumn("open", F.col("marked").isNull()), similarity), "line-pairs"
    )
    later = found.unionByName(later_sets(docs, sets, candidates, similarity)).distinct()
    known = (
        sets.join(later.withColumn("later", F.lit(True)), "id", "left")
        .where((F.col("copies") > 1) | F.col("later"))
        .select(
            "k1", "k2", F.col("row_key").alias("first_row"), F.col("line_no").alias("first_line"), "later"
        )
    )
    stays = (
        (F.col("row_key") == F.col("first_row"))
        & (F.col("line_no") == F.col("first_line"))
        & F.col("later").isNull()
    )
    removed = (
        lines.select("row_key", "line_no", "k1", "k2")
        .join(known, ["k1", "k2"])
        .where(~stays)
        .groupBy("row_key")
        .agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    )
    counted = docs.select(
        "doc_id", "row_key", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines")
    )
    return counted.join(removed, "row_key", "left").select(
        "doc_id",
        "row_key",
        F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def drop_repeated_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``df`` with the lines of :func:`find_repeated_lines` taken out of the texts."""
    key = free_name("row_key", df.columns)
    gone = free_name("removed", df.columns)
    keyed = with_row_key(df, key).withColumn(key, F.unhex(F.md5(key)))
    found = find_repeated_lines(keyed, id_col, text_col, similarity, key).where(F.size("removed") > 0)
    joined = keyed.join(
        found.select(F.col("row_key").alias(key), F.col("removed").alias(gone)), key, "left"
    )
    left = F.filter(
        F.split(text_col, "\n"), lambda line, i: ~F.array_contains(F.col(gone), i)
    )
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.withColumn(text_col, text).select(*df.columns)
