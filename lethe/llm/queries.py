"""The registered queries of this subpackage and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import (
    exact_dedup,
    language_id,
    line_dedup,
    merkle,
    mixing,
    near_join,
    packing,
    periodic,
    quality,
    quality_rules,
    sharding,
    token_files,
    topk,
)
from lethe.llm.common import WHITE, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


SHARDS = {s: 1.0 for s in range(24)}
ONE_MORE = SHARDS | {24: 1.0}


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight, and with a 25th.

    Its hash is not in DuckDB; ``tests/llm/test_sharding.py`` recomputes it.
    """
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign_shards(sized, "doc_id", SHARDS, grown=ONE_MORE)
    return sharding.number_slots(placed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query(
    "op6_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
      FROM documents
    )
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id,
           count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM d
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


MIX_WEIGHTS = (5, 2, 1)


@query(
    "op7_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
      FROM d GROUP BY source
    ), w AS (
      SELECT *, CASE turn % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
    ), l AS (
      SELECT *, most / weight AS fill,
        ((SELECT sum(source_size) FROM w)::DOUBLE * 1.0 - coalesce(sum(most) OVER ahead, 0)::DOUBLE)
        / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER ahead, 0)) AS level
      FROM w
      WINDOW ahead AS (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t AS (
      SELECT source, source_size,
        CASE WHEN most < weight * level THEN most::DOUBLE
             ELSE weight * (SELECT arg_min(level, (fill, turn)) FROM l WHERE NOT most < weight * level)
        END AS target
      FROM l
    ), b AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (
          PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size::BIGINT AS size, source_size, target,
      (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
       + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE budget END
                           - ahead)))::BIGINT AS taken
    FROM b
    """,
)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


@query(
    "op9_top_k_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), p AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
      SELECT query_id,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
             vec_id, score
      FROM p
    )
    SELECT * FROM r WHERE rank <= 5
    """,
)
def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search_embeddings(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are not SQL; ``tests/llm/test_tokens.py`` encodes whole texts with the library."""
    path = token_files.new_token_dir(spark)
    token_files.write_token_files(
        table(spark, sf_dir, "documents"), path, end_id=2, special_tokens=True
    )
    return token_files.read_digests(spark, path)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are not SQL; ``tests/llm/test_packing.py`` puts all pieces together again."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, end_id=0, special_tokens=True)


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained model; ``tests/llm/test_language_id.py`` measures it on held-out rows."""
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.in_fold("doc_id", 4, 2)
    model = language_id.fit_languages(docs, F.col("doc_id").isNotNull() & ~held_out)
    rows = docs.withColumn("held_out", held_out)
    return language_id.predict_languages(rows, model, ["doc_id", "held_out"])


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained model; ``tests/llm/test_quality.py`` measures it on held-out rows."""
    held_out = language_id.in_fold("doc_id", 5, 0)
    features = quality.document_features(table(spark, sf_dir, "documents"))
    model = quality.fit_quality(features, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score_quality(features, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op2_near_join")
def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen paths are not SQL; ``tests/llm/test_near_join.py`` compares all pairs."""
    found = near_join.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "set_id", "class_id", "links")


@query(
    "op3_line_dedup",
    r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS line_no
      FROM documents
    ), t AS (
      SELECT doc_id, line_no,
             list_sort(list_distinct(list_filter(
               regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS words
      FROM l
    ), s AS (
      SELECT words, len(words) AS n, min((doc_id, line_no)) AS first,
             row_number() OVER () AS id
      FROM t WHERE len(words) > 0 GROUP BY words
    ), w AS (
      SELECT id, n, unnest(words) AS word FROM s
    ), c AS (
      SELECT word, count(*) AS c FROM w GROUP BY word
    ), o AS (
      SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY c, word) AS pos
      FROM w JOIN c USING (word)
    ), p AS (
      SELECT id, n, word FROM o WHERE pos <= n - ceil(n * 0.8 - 1e-9) + 1
    ), x AS (
      SELECT DISTINCT a.id AS a, b.id AS b
      FROM p a JOIN p b ON a.word = b.word AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
    ), v AS (
      SELECT a.first AS fa, b.first AS fb, a.id AS a, b.id AS b
      FROM x JOIN s a ON x.a = a.id JOIN s b ON x.b = b.id
      WHERE len(list_intersect(a.words, b.words)) / (a.n + b.n - len(list_intersect(a.words, b.words))) >= 0.8
    ), g AS (
      SELECT DISTINCT CASE WHEN fa < fb THEN b ELSE a END AS id FROM v
    ), r AS (
      SELECT t.doc_id, list_sort(list(t.line_no::INT)) AS removed
      FROM t JOIN s ON t.words = s.words LEFT JOIN g ON s.id = g.id
      WHERE g.id IS NOT NULL OR s.first <> (t.doc_id, t.line_no)
      GROUP BY t.doc_id
    )
    SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
           coalesce(len(removed), 0)::BIGINT AS n_removed,
           coalesce(array_to_string(removed, ','), '') AS removed
    FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
    """,
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.find_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(
      list_transform(range(len({text})), lambda i: ascii(substr({text}, i + 1, 1))::BIGINT),
      lambda c, b: list_reduce(range(8), lambda r, k:
        xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
      4294967295), 4294967295)"""


def _sql_merkle(levels: int, upper: int) -> str:
    """Trees of up to ``8 ** levels`` rows per language and ``8 ** upper`` languages."""
    row = " || ".join(
        f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
        for c in ("doc_id", "source", "lang", "n_chars", "t")
    )
    parts = [
        f"""WITH d AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p0,
                 count(*) OVER (PARTITION BY lang) AS n,
                 (SELECT sha256({row}) FROM (SELECT text AS t)) AS leaf,
                 (SELECT sha256({row}) FROM (SELECT
                    CASE WHEN {_sql_crc32("doc_id::VARCHAR")} % 3 = 0
                         THEN translate(text, '{CAPITALS}', '{CAPITALS.lower()}') ELSE text END AS t)) AS told
          FROM documents
        )""",
        "a0 AS (SELECT lang AS g, p0 AS p, n, leaf AS h FROM d)",
    ]

    def climb(name: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{name}s{k} AS (
              SELECT g, p, n, h,
                coalesce(string_agg(h, '') OVER (PARTITION BY g, p // 8 ORDER BY p
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '') OVER (PARTITION BY g, p // 8 ORDER BY p
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
              FROM {name}{k})""")
            parts.append(f"""{name}{k + 1} AS (
              SELECT g, p // 8 AS p, any_value(n) AS n,
                CASE WHEN any_value(n) > {8**k} THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h
              FROM {name}s{k} GROUP BY g, p // 8)""")

    climb("a", levels)
    parts.append(f"""b0 AS (
      SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p,
             count(*) OVER () AS n, h, g AS lang FROM a{levels})""")
    climb("b", upper)
    proof, fold, joins = "''", "told", ""
    for k in range(levels):
        joins += f" JOIN as{k} ON as{k}.g IS NOT DISTINCT FROM d.lang AND as{k}.p = d.p0 // {8**k}"
    joins += f" JOIN a{levels} z ON z.g IS NOT DISTINCT FROM d.lang JOIN b0 ON b0.lang IS NOT DISTINCT FROM d.lang"
    for k in range(upper):
        joins += f" JOIN bs{k} ON bs{k}.p = b0.p // {8**k}"
    for name, count, n in (("as", levels, "d.n"), ("bs", upper, "b0.n")):
        for k in range(count):
            real = f"{n} > {8**k}"
            proof += f" || CASE WHEN {real} THEN {name}{k}.l || {name}{k}.r ELSE '' END"
            fold = f"(SELECT CASE WHEN {real} THEN sha256({name}{k}.l || x || {name}{k}.r) ELSE x END FROM (SELECT {fold} AS x))"
    return f"""{", ".join(parts)}, e AS (
      SELECT d.doc_id, d.leaf, z.h AS subroot, (SELECT h FROM b{upper}) AS root,
             sha256({proof}) AS proof_sha256, {fold} AS folded_root
      FROM d {joins})
    SELECT *, folded_root = root AS verified FROM e"""


@query("op13_merkle_manifest", _sql_merkle(levels=7, upper=3))
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.row_digest(*rest, F.col("text"))
    changed = merkle.row_digest(*rest, F.translate("text", CAPITALS, CAPITALS.lower()))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    told = F.when(tampered, changed).otherwise(leaf)
    found = merkle.build_manifest(docs, leaf, carried=[F.col("doc_id"), told.alias("told")])
    back = merkle.folded(F.col("path"), F.col("told"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        back.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query(
    "op11_periodic_runs",
    rf"""
    WITH d AS (
      SELECT row_number() OVER () AS row, doc_id, {_sql_crc32("doc_id::VARCHAR")} AS h,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), e AS (
      SELECT *, (h // 10) % len(w) AS a, h % 10 = 0 AND len(w) > 0 AS cyclic FROM d
    ), f AS (
      SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM e
    ), v AS (
      SELECT row, doc_id, CASE WHEN cyclic THEN list_transform(range(len(w)),
        lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
      FROM f
    ), t AS (
      SELECT row, unnest(range(len(w))) AS i, unnest(w) AS word,
             unnest(list_transform(range(len(w)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS gram
      FROM v WHERE len(w) > 0
    ), c AS (
      SELECT row, max(i) AS last FROM t GROUP BY row
    ), m AS (
      SELECT x.row, x.i, y.i - x.i AS q,
             x.i - row_number() OVER (PARTITION BY x.row, y.i - x.i ORDER BY x.i) AS stretch
      FROM t x JOIN t y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i JOIN c ON c.row = x.row
      WHERE y.i + 7 <= c.last
    ), s AS (
      SELECT row, min(i) AS start, count(*) + 7 + q AS length, q FROM m GROUP BY row, q, stretch
    ), r AS (
      SELECT row, start, length, min(q) AS period FROM s
      WHERE length >= 24 AND length >= 3 * q GROUP BY row, start, length
    ), b AS (
      SELECT row, count(*) AS n_runs,
             first((start, length, period) ORDER BY length::DOUBLE / period DESC, start, period) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
      FROM r GROUP BY row
    ), k AS (
      SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM t
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.row = t.row
                        AND r.start + r.period <= t.i AND t.i < r.start + r.length)
      GROUP BY row
    )
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start,
           best[2]::BIGINT AS length, best[3]::BIGINT AS period,
           (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
           sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM v LEFT JOIN b ON v.row = b.row LEFT JOIN k ON v.row = k.row
    """,
)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(with_cycles(docs).select("doc_id", "text"))
    best = periodic.densest(F.col("runs"))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_cycles(docs: DataFrame) -> DataFrame:
    """The contract's texts: in every tenth document, by the hash of its id, the words from a
    place on are replaced by repetitions of the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("*", h.alias("h"), F.floor(h / 10).alias("g")).withColumn(
        "words",
        F.when(
            F.col("h") % 10 == 0,
            F.filter(F.split("text", f"[{WHITE}]+"), lambda w: w != ""),
        ),
    )
    n = F.nullif(F.size("words").cast("long"), F.lit(0))
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    rest = (n - a).cast("int")
    cycle = F.slice("words", a + 1, p)
    repeated = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), a), repeated), " ")
    return chosen.withColumn("text", F.when(F.size("words") > 0, made).otherwise(F.col("text")))


@query("op12_quality_rules")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterated estimates are not SQL; ``tests/llm/test_quality_rules.py`` recomputes them."""
    found = quality_rules.judge_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
    )
