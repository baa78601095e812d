"""Embedding and triplet extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe import messages
from lethe.catalog import query
from lethe.catalog.inputs import (
    DIMENSION,
    REQ,
    document_requests,
    spread,
    spread_by_size,
    table,
    text_of,
)
from lethe.catalog.requests import _BLANK, _LINES, document_lines
from lethe.functions.annotate import COPULA, FUNCTION_WORDS, VERBS
from lethe.functions.arrays import l2_norm, l2_normalise
from lethe.operators import triplets
from lethe.operators.embed import embed_and_extract_batch, embed_documents, hashing_encoder


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_VERBS = " ".join(f"WHEN lw = '{form}' THEN '{base}'" for form, base in VERBS.items())


def sql_triplets(docs: str, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}trip(doc_id, n, subject, predicate, object)`` over a relation
    (doc_id, text), by rows and windows where the Spark side folds arrays."""
    p = prefix
    return rf"""{p}sent AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+|\n+'),
                             lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]+')) AS ss
  FROM {docs}),
{p}words AS (
  SELECT doc_id, s_id, list_filter(regexp_extract_all(s, '[\p{{L}}\p{{N}}]+'),
                                   lambda w: lower(w) NOT IN ({_quoted(FUNCTION_WORDS)})) AS ws
  FROM (SELECT doc_id, unnest(range(len(ss))) AS s_id, unnest(ss) AS s FROM {p}sent)),
{p}tok AS (
  SELECT doc_id, s_id, t_id, word, lw, CASE
      WHEN lw IN ({_quoted(COPULA)}) THEN 'be' {_VERBS}
      WHEN length(lw) >= 5 AND ends_with(lw, 'ied') THEN substr(lw, 1, length(lw) - 3) || 'y'
      WHEN length(lw) >= 5 AND ends_with(lw, 'ed') THEN substr(lw, 1, length(lw) - 2)
      ELSE '' END AS verb
  FROM (SELECT *, lower(word) AS lw FROM (
          SELECT doc_id, s_id, unnest(range(len(ws))) AS t_id, unnest(ws) AS word
          FROM {p}words))),
{p}tag AS (
  SELECT *, min(CASE WHEN verb <> '' THEN t_id END) OVER w AS first_verb,
         lead(verb, 1, '') OVER o AS v1, lead(verb, 2, '') OVER o AS v2
  FROM {p}tok
  WINDOW w AS (PARTITION BY doc_id, s_id), o AS (PARTITION BY doc_id, s_id ORDER BY t_id)),
{p}role AS (
  SELECT *, CASE WHEN verb <> '' THEN 'p' WHEN word < 'A' THEN NULL
                 WHEN v1 <> '' OR v2 <> '' THEN 's'
                 WHEN t_id > first_verb THEN 'o' END AS role FROM {p}tag),
{p}fold AS (
  SELECT doc_id, s_id, list_reduce(
      list({{'r': role, 'v': CASE WHEN role = 'p' THEN verb ELSE word END}} ORDER BY t_id),
      lambda a, x: CASE
        WHEN (x.r = 's' OR a.s <> '') AND (x.r = 'p' OR a.p <> '') AND (x.r = 'o' OR a.o <> '')
        THEN {{'s': '', 'p': '', 'o': '', 'd': list_append(a.d, {{
            's': CASE WHEN x.r = 's' THEN x.v ELSE a.s END,
            'p': upper(CASE WHEN x.r = 'p' THEN x.v ELSE a.p END),
            'o': CASE WHEN x.r = 'o' THEN x.v ELSE a.o END}})}}
        ELSE {{'s': CASE WHEN x.r = 's' THEN x.v ELSE a.s END,
               'p': CASE WHEN x.r = 'p' THEN x.v ELSE a.p END,
               'o': CASE WHEN x.r = 'o' THEN x.v ELSE a.o END, 'd': a.d}} END,
      {{'s': '', 'p': '', 'o': '', 'd': []::STRUCT(s VARCHAR, p VARCHAR, o VARCHAR)[]}}).d AS d
  FROM {p}role WHERE role IS NOT NULL GROUP BY doc_id, s_id),
{p}direct AS (
  SELECT doc_id, flatten(list(d ORDER BY s_id)) AS d FROM {p}fold GROUP BY doc_id),
{p}heads AS (
  SELECT doc_id, list(word ORDER BY s_id, t_id) FILTER (verb = '' AND word >= 'A') AS nouns,
         list(verb ORDER BY s_id, t_id) FILTER (verb <> '') AS verbs
  FROM {p}tok GROUP BY doc_id),
{p}backup AS (
  SELECT h.doc_id, [CASE
      WHEN len(nouns) >= 2 AND len(verbs) >= 1
        THEN {{'s': nouns[1], 'p': upper(verbs[1]), 'o': nouns[2]}}
      ELSE {{'s': nouns[1], 'p': '{messages.ASSOCIATED_WITH}',
             'o': regexp_replace(substr(d.text, 1, 30),
                                 '^[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+|[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+$',
                                 '', 'g')}}
      END] AS d
  FROM {p}heads h JOIN {docs} d USING (doc_id)
  WHERE len(nouns) >= 1
    AND doc_id NOT IN (SELECT doc_id FROM {p}direct WHERE len(d) > 0)),
{p}trip AS (
  SELECT doc_id, CAST(n AS INTEGER) AS n, t.s AS subject, t.p AS predicate, t.o AS object
  FROM (SELECT doc_id, unnest(range(len(d))) AS n, unnest(d) AS t
        FROM (SELECT * FROM {p}direct UNION ALL SELECT * FROM {p}backup)))"""


@query(
    "extract_triplets",
    f"""WITH {sql_triplets("documents")}
        SELECT doc_id, n, subject, predicate, object FROM trip""",
)
def extract_triplets(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return triplets.triplet_rows(triplets.extract_triplets(docs), "doc_id")


@query(
    "extract_triplets_per_line",
    f"""WITH {_LINES},
        units AS (SELECT doc_id || '/' || line AS doc_id, text FROM lines),
        {sql_triplets("units")}
        SELECT doc_id AS unit, n, subject, predicate, object FROM trip""",
)
def extract_triplets_per_line(spark, sf_dir):
    """Every line its own text: short ones reach both fallbacks."""
    unit = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("line").cast("string"))
    lines = document_lines(spark, sf_dir).select(unit.alias("unit"), "text")
    return triplets.triplet_rows(triplets.extract_triplets(spread(lines)), "unit")


@query(
    "triplets_from_tokens",
    f"""WITH {_LINES},
        units AS (SELECT doc_id || '/' || line AS doc_id, text FROM lines),
        {sql_triplets("units")}
        SELECT doc_id AS unit, subject, predicate, object, count(*) AS times
        FROM trip GROUP BY ALL""",
)
def triplets_from_tokens(spark, sf_dir):
    """The same triplets from a token table instead of texts."""
    unit = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("line").cast("string"))
    lines = document_lines(spark, sf_dir).select(unit.alias("doc_id"), "text")
    tokens = triplets.token_table(spread_by_size(lines))
    return (
        triplets.triplets_from_tokens(tokens, lines)
        .groupBy(F.col("doc_id").alias("unit"), "subject", "predicate", "object")
        .agg(F.count(F.lit(1)).alias("times"))
    )


@query(
    "triplets_extracted",
    f"""WITH {sql_triplets("documents")}
        SELECT d.doc_id, CAST(count(t.n) AS INTEGER) AS triplets_extracted
        FROM documents d LEFT JOIN trip t ON t.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def triplets_extracted(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return triplets.triplets_extracted(triplets.extract_triplets(docs), "doc_id")


@query(
    "embed_documents",
    f"""WITH {REQ} SELECT id, entity_id, {DIMENSION} AS dimension, true AS unit_length,
        CAST(NULL AS VARCHAR) AS message FROM req""",
)
def embed(spark, sf_dir):
    docs = spread(document_requests(spark, sf_dir))
    return embed_documents(docs, hashing_encoder(DIMENSION)).select(
        "id",
        "entity_id",
        F.size("vector").alias("dimension"),
        (F.abs(l2_norm(F.col("vector")) - 1) < 1e-3).alias("unit_length"),
        "message",
    )


@query(
    "l2_normalise",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, scaled,
         round(sqrt(list_reduce(list_transform(embedding,
             lambda x: (x::DOUBLE) * scaled * (x::DOUBLE) * scaled), lambda a, b: a + b)), 4)
           AS length_before, true AS unit_length
       FROM (SELECT *, label + 1 AS scaled FROM embeddings)""",
)
def normalise(spark, sf_dir):
    """Vectors stretched by their label, brought back to unit length."""
    rows = table(spark, sf_dir, "embeddings").withColumn("scaled", F.col("label") + 1)
    stretched = F.transform("embedding", lambda x: x.cast("double") * F.col("scaled"))
    unit = l2_normalise(F.col("stretched"))
    return rows.withColumn("stretched", stretched).select(
        "vec_id",
        F.size("embedding").alias("dimension"),
        "scaled",
        F.round(l2_norm(F.col("stretched")), 4).alias("length_before"),
        (F.abs(l2_norm(unit) - 1) < 1e-3).alias("unit_length"),
    )


@query(
    "embed_and_extract_batch",
    f"""WITH {_LINES},
        units AS (SELECT doc_id || '/' || line AS doc_id, text FROM lines WHERE doc_id IN (
          SELECT doc_id FROM lines GROUP BY doc_id
          HAVING bool_and(regexp_matches(text, '{_BLANK}')))),
        {sql_triplets("units")}
        SELECT u.doc_id AS id, {DIMENSION} AS dimension, count(t.n)::INTEGER AS triplets
        FROM units u LEFT JOIN trip t ON t.doc_id = u.doc_id GROUP BY u.doc_id""",
)
def embed_and_extract(spark, sf_dir):
    """Each document is a batch of its lines; a blank line fails the batch."""
    items = document_lines(spark, sf_dir).select(
        text_of("doc_", F.col("doc_id")).alias("batch_id"),
        F.col("line").alias("seq"),
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias(
            "id"
        ),
        text_of("doc_", F.col("doc_id")).alias("entity_id"),
        "text",
    )
    return embed_and_extract_batch(spread(items), hashing_encoder(DIMENSION)).select(
        "id", F.size("vector").alias("dimension"), F.size("triplets").alias("triplets")
    )
