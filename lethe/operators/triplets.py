"""Subject-predicate-object extraction from annotated text or from token tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe import messages, schemas
from lethe.functions.annotate import SentenceAnnotator, let, rule_annotate
from lethe.functions.text import has_content, strip
from lethe.session import materialise, ship_package

_TRIPLETS = f"array<{schemas.TRIPLET.simpleString()}>"


def _is_noun(token: Column) -> Column:
    return token["pos"].isin("NOUN", "PROPN")


def _is_verb(token: Column) -> Column:
    return token["pos"].isin("VERB", "AUX")


def _triplet(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.struct(
        subject.alias("subject"), F.upper(predicate).alias("predicate"), obj.alias("object")
    )


def _role(token: Column) -> Column:
    """Which register a token sets, and to what; null if none. Subject wins over verb, verb
    over object."""
    dep = token["dep"]

    def register(role: str, value: Column) -> Column:
        return F.struct(
            F.lit(role).alias("role"), F.coalesce(value, F.lit("")).alias("value")
        )

    return (
        F.when(F.contains(dep, F.lit("subj")), register("s", token["text"]))
        .when(_is_verb(token), register("p", token["lemma"]))
        .when(
            F.contains(dep, F.lit("obj")) | F.contains(dep, F.lit("attr")) | F.contains(dep, F.lit("oprd")),
            register("o", token["text"]),
        )
    )


def sentence_triplets(tokens: Column) -> Column:
    """Triplets of one sentence given its tokens in order.

    Each token with a role overwrites that register; once all three are set they are emitted
    and cleared, so a sentence can give several triplets in any order of roles.
    """
    return fold_roles(F.filter(F.transform(tokens, _role), lambda r: r.isNotNull()))


def fold_roles(roles: Column) -> Column:
    """Triplets of one sentence from what its tokens set, as :func:`sentence_triplets`."""

    def step(acc: Column, token: Column) -> Column:
        role, value = token["role"], token["value"]
        now = {k: F.when(role == k, value).otherwise(acc[k]) for k in "spo"}
        # The registers are never all set before a token: it is the last one that was missing.
        s, p, o = (acc[k] != "" for k in "spo")
        others = F.when(role == "s", p & o).when(role == "p", s & o).otherwise(s & p)
        emitted = F.array(_triplet(now["s"], now["p"], now["o"]))
        return F.when(
            (value != "") & others,
            F.struct(
                *[F.lit("").alias(k) for k in "spo"],
                F.concat(acc["done"], emitted).alias("done"),
            ),
        ).otherwise(F.struct(*[v.alias(k) for k, v in now.items()], acc["done"].alias("done")))

    start = F.struct(
        *[F.lit("").alias(k) for k in "spo"], F.array().cast(_TRIPLETS).alias("done")
    )
    return F.aggregate(roles, start, step, lambda acc: acc["done"])


def fallback_triplets(nouns: Column, verbs: Column, text: Column) -> Column:
    """For a text without any triplet: noun-verb-noun, else the first noun alone, else none.

    ``nouns`` holds noun texts and ``verbs`` verb lemmas, in order; only the first two and the
    first are looked at.
    """
    pair = _triplet(F.get(nouns, F.lit(0)), F.get(verbs, F.lit(0)), F.get(nouns, F.lit(1)))
    single = _triplet(
        F.get(nouns, F.lit(0)),
        F.lit(messages.ASSOCIATED_WITH),
        strip(F.substring(text, 1, 30)),
    )
    return (
        F.when((F.size(nouns) >= 2) & (F.size(verbs) >= 1), F.array(pair))
        .when(F.size(nouns) >= 1, F.array(single))
        .otherwise(F.array().cast(_TRIPLETS))
    )


def _heads(tokens: Column) -> Column:
    """What the fallback may need of a sentence: two nouns and a verb at most."""
    nouns = F.transform(F.slice(F.filter(tokens, _is_noun), 1, 2), lambda t: t["text"])
    verbs = F.transform(F.slice(F.filter(tokens, _is_verb), 1, 1), lambda t: t["lemma"])
    return F.struct(nouns.alias("nouns"), verbs.alias("verbs"))


_HEADS = "struct<nouns: array<string>, verbs: array<string>>"


def _fallback(heads: Column, text: Column) -> Column:
    """Fallback triplets of a text from the heads of its sentences, in order."""
    return let(
        F.flatten(heads["nouns"]),
        _TRIPLETS,
        lambda nouns: fallback_triplets(nouns, F.flatten(heads["verbs"]), text),
    )


_LEADING = 3  # sentences that mostly hold the two nouns of a fallback


def _in_passes(annotator: SentenceAnnotator, sentences: Column, text: Column) -> Column:
    """Triplets of a text from its sentences. Those that may hold a verb are read first, as no
    triplet is without one. If that gave none, the leading sentences are tagged for the fallback,
    with those that may hold its verb; if they have not two nouns, all are.

    The passes are one fold, so that each expression stands in the plan once and a later pass is
    computed for the texts that need it only. Sentences are tested once for all passes.
    """
    read = f"struct<found: {_TRIPLETS}, heads: {_HEADS}>"
    none = F.array().cast(_TRIPLETS)

    def step(done: Column, at: Column, verbal: Column) -> Column:
        direct, leading = at == 0, at == 1

        def parts(found: Column, tokens: Column) -> Column:
            return F.struct(
                F.when(direct, found).otherwise(none).alias("found"),
                F.when(~direct, _heads(tokens)).alias("heads"),
            )

        def sentence(s: Column) -> Column:
            if annotator.read is None:
                tokens = annotator.tag(s, ~direct)
                return let(tokens, read, lambda t: parts(sentence_triplets(t), t))
            both = annotator.read(s, direct)
            return let(both, read, lambda x: parts(fold_roles(x["roles"]), x["tokens"]))

        def result(p: Column) -> Column:
            nouns = F.flatten(F.slice(p, 1, _LEADING)["heads"]["nouns"])
            more = leading & (F.size(sentences) > _LEADING) & (F.size(nouns) < 2)
            return (
                F.when(direct, F.flatten(p["found"]))
                .when(more, none)
                .otherwise(_fallback(p["heads"], text))
            )

        chosen = F.filter(
            sentences,
            lambda s, i: (at == 2) | (leading & (i < _LEADING)) | F.get(verbal, i),
        )
        tagged = F.transform(chosen, sentence)
        return F.when(F.size(done) > 0, done).otherwise(let(tagged, _TRIPLETS, result))

    def passes(verbal: Column) -> Column:
        at = F.array(F.lit(0), F.lit(1), F.lit(2))
        return F.aggregate(at, none, lambda done, x: step(done, x, verbal))

    return let(F.transform(sentences, annotator.may_hold_verb), _TRIPLETS, passes)


def extract_triplets(
    documents: DataFrame,
    annotator: Callable[[Column], Column] = rule_annotate,
    text: str = "text",
) -> DataFrame:
    """Adds ``triplets`` to rows with a text column: one projection, no shuffle.

    The text is annotated and folded where it is read; documents are independent, so a corpus
    of any size and any skew in its keys splits like its files do. An annotator that can tag
    sentences one by one is asked for those without a verb only where these matter.
    """
    filled = has_content(F.col(text))
    none = F.array().cast(_TRIPLETS)
    if isinstance(annotator, SentenceAnnotator):
        split = documents.withColumn("_sentences", F.when(filled, annotator.split(F.col(text))))
        triplets = _in_passes(annotator, F.col("_sentences"), F.col(text))
        return split.withColumn(
            "triplets", F.when(F.col("_sentences").isNull(), none).otherwise(triplets)
        ).drop("_sentences")
    annotated = documents.withColumn("_sentences", F.when(filled, annotator(F.col(text))))
    found = annotated.withColumn(
        "_found", F.flatten(F.transform("_sentences", sentence_triplets))
    )
    triplets = (
        F.when(F.col("_sentences").isNull(), none)
        .when(F.size("_found") > 0, F.col("_found"))
        .otherwise(_fallback(F.transform("_sentences", _heads), F.col(text)))
    )
    return found.withColumn("triplets", triplets).drop("_sentences", "_found")


def unnest(df: DataFrame, array: Column, position: str, element: str, *keep: str) -> DataFrame:
    """Rows of an array column, without those of empty or null arrays.

    For an inner explode the optimizer adds a filter on the array's size and pushes it below
    the projections that compute the array, where it is computed again. The outer form has no
    such filter, so a costly array is computed once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, element))
    return rows.where(F.col(position).isNotNull())


def triplet_rows(extracted: DataFrame, *keep: str) -> DataFrame:
    """One row per triplet; ``n`` is its position in the document."""
    rows = unnest(extracted, F.col("triplets"), "n", "t", *keep)
    return rows.select(*keep, "n", "t.subject", "t.predicate", "t.object")


def triplets_extracted(extracted: DataFrame, *keep: str) -> DataFrame:
    return extracted.select(*keep, F.size("triplets").alias("triplets_extracted"))


def token_table(
    documents: DataFrame,
    doc_id: str = "doc_id",
    annotator: Callable[[Column], Column] = rule_annotate,
) -> DataFrame:
    """Annotated text as rows ``(doc_id, sent_id, tok_id, text, lemma, pos, dep)``."""
    filled = documents.where(has_content(F.col("text"))).withColumnRenamed(doc_id, "doc_id")
    sentences = unnest(filled, annotator(F.col("text")), "sent_id", "tokens", "doc_id")
    rows = unnest(sentences, F.col("tokens"), "_at", "t", "doc_id", "sent_id")
    return rows.select("doc_id", "sent_id", "t.*")


_TOKEN = ("tok_id", "text", "lemma", "pos", "dep")


def _begins(column: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before; a null does from any."""
    same = pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False)
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])


def _spare_nouns(batch: pa.RecordBatch, document: np.ndarray) -> np.ndarray:
    """Nouns with two others before them in the same document: no fallback needs them."""
    known = pc.and_(pc.is_valid(batch["sent_id"]), pc.is_valid(batch["tok_id"]))
    nouns = np.flatnonzero(pc.and_(batch["noun"], known).to_numpy(zero_copy_only=False))
    sent, tok = (pc.fill_null(batch[c], 0).to_numpy()[nouns] for c in ("sent_id", "tok_id"))
    document = document[nouns]
    order = np.lexsort((tok, sent, document))
    nouns, sent, tok, document = nouns[order], sent[order], tok[order], document[order]
    first = np.searchsorted(document, document)
    third = np.flatnonzero(np.arange(len(nouns)) - first >= 2)
    second = first[third] + 1
    # What stands in one place with the second stays: its text decides.
    after = (sent[third] != sent[second]) | (tok[third] != tok[second])
    spare = np.zeros(batch.num_rows, bool)
    spare[nouns[third[after]]] = True
    return spare


def _sentence_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, sent_id, tokens)`` from neighbouring tokens of a sentence, so that a
    sentence that lies together travels as one row, and without nouns that nothing reads."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new_document = _begins(batch["doc_id"])
        sentence = np.cumsum(new_document | _begins(batch["sent_id"]))
        read = batch["read"].to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(read | ~_spare_nouns(batch, np.cumsum(new_document)))
        starts = np.flatnonzero(np.diff(sentence[kept], prepend=0))
        tokens = batch.select(_TOKEN).take(pa.array(kept))
        runs = pa.ListArray.from_arrays(
            pa.array(np.append(starts, len(kept)), pa.int32()),
            pa.StructArray.from_arrays(tokens.columns, fields=list(tokens.schema)),
        )
        keys = batch.select(["doc_id", "sent_id"]).take(pa.array(kept[starts]))
        yield pa.RecordBatch.from_arrays([*keys.columns, runs], ["doc_id", "sent_id", "tokens"])


def triplets_from_tokens(tokens: DataFrame, documents: DataFrame) -> DataFrame:
    """Triplet rows ``(doc_id, sent_id, n, subject, predicate, object)`` from a token table.

    The unit collected into one row is a sentence, never a document, so one document may hold
    any share of the tokens. ``documents`` (doc_id, text) supplies the text of the last
    fallback; fallback rows have sentence -1.
    """
    ship_package(tokens.sparkSession)
    # Only tokens that the fold or the fallback reads travel.
    token = F.struct("text", "lemma", "pos", "dep")
    noun = F.coalesce(_is_noun(token), F.lit(False))
    read = _role(token).isNotNull() | F.coalesce(_is_verb(token), F.lit(False))
    needed = tokens.select("doc_id", "sent_id", *_TOKEN, noun.alias("noun"), read.alias("read"))
    needed = needed.where(F.col("noun") | F.col("read"))
    kinds = dict(needed.dtypes)
    row = f"struct<{', '.join(f'{c}: {kinds[c]}' for c in _TOKEN)}>"
    runs = needed.mapInArrow(
        _sentence_runs,
        f"doc_id {kinds['doc_id']}, sent_id {kinds['sent_id']}, tokens array<{row}>",
    )
    # Sentences mostly are whole already: dealing them out first spares sorting them to combine
    # them before they travel.
    whole = (
        runs.repartition("doc_id", "sent_id")
        .groupBy("doc_id", "sent_id")
        .agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    )
    # Written once: four steps read what becomes of a sentence, which is less than its tokens.
    # A document with a triplet needs no heads.
    found = whole.select(
        "doc_id", "sent_id", "tokens", sentence_triplets(F.col("tokens")).alias("found")
    )
    heads = F.when(F.size("found") == 0, _heads(F.col("tokens")))
    sentences = materialise(
        found.select("doc_id", "sent_id", "found", heads.alias("heads")), "sentences"
    )
    direct = unnest(sentences, F.col("found"), "n", "t", "doc_id", "sent_id").select(
        "doc_id", "sent_id", "n", "t.*"
    )

    # Documents without a triplet: two nouns and a verb are enough, so each sentence passes on
    # at most two nouns and one verb and each document is reduced with mergeable minima.
    heads = sentences.select(
        "doc_id",
        "sent_id",
        F.size("found").alias("n_found"),
        "heads.nouns",
        F.get("heads.verbs", F.lit(0)).alias("verb"),
    )
    with_noun = F.size("nouns") > 0
    empty = (
        heads.groupBy("doc_id")
        .agg(
            F.sum("n_found").alias("n_found"),
            F.min(F.when(with_noun, F.struct("sent_id", "nouns"))).alias("first"),
            F.min(F.when(F.col("verb").isNotNull(), F.struct("sent_id", "verb"))).alias("v"),
        )
        .where((F.col("n_found") == 0) & F.col("first").isNotNull())
        .select("doc_id", "first", F.col("v.verb").alias("verb"))
    )
    one_noun = empty.where(F.size("first.nouns") == 1).select(
        "doc_id", F.col("first.sent_id").alias("after")
    )
    second = (
        heads.where(with_noun)
        .join(one_noun, "doc_id")
        .where(F.col("sent_id") > F.col("after"))
        .groupBy("doc_id")
        .agg(F.min(F.struct("sent_id", "nouns")).alias("next"))
        .select("doc_id", F.slice("next.nouns", 1, 1).alias("next"))
    )
    joined = (
        empty.join(second, "doc_id", "left")
        .join(documents.select("doc_id", F.substring("text", 1, 30).alias("text")), "doc_id")
        .withColumn(
            "nouns",
            F.when(F.col("next").isNull(), F.col("first.nouns")).otherwise(
                F.concat("first.nouns", "next")
            ),
        )
        .withColumn(
            "verbs",
            F.when(F.col("verb").isNull(), F.array().cast("array<string>")).otherwise(
                F.array("verb")
            ),
        )
    )
    found = fallback_triplets(F.col("nouns"), F.col("verbs"), F.col("text"))
    backup = unnest(joined, found, "n", "t", "doc_id").select(
        "doc_id", F.lit(-1).alias("sent_id"), "n", "t.*"
    )
    return direct.unionByName(backup)
