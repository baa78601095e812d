"""Default annotator: text to sentences of tokens, as one column expression.

An annotator is any function from a text column to a column of
``array<array<struct<tok_id, text, lemma, pos, dep>>>`` (sentences of tokens), for instance a
pandas UDF around a neural parser. This default needs no model. It keeps the content words, tags them by short word lists and suffixes and
reads roles off the position relative to the verbs, enough for plain subject-verb-object
sentences. Function words never fill a role and are left out of the token table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?\n]+"
WORD = r"[\p{L}\p{N}]+"

# Forms of the copula, in the languages of the corpus.
COPULA = "is are was were be been am est sont ist sind".split()
# Verbs the suffix rule cannot reach.
VERBS = {
    "computes": "compute",
    "holds": "hold",
    "lives": "live",
    "made": "make",
    "owns": "own",
    "works": "work",
    "wrote": "write",
}
FUNCTION_WORDS = (
    "a an and as at by for from he in it of on or that the this to with not but "
    "au avec dans de des du en et la le les par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für im mit nicht sich und von zu "
    "al con del el las lo los no para por se su una y"
).split()


# Found in every sentence with a verb, and in some others: a listed form as a whole word or the
# suffix. The test of the first letter spares most places the others. No letter but K has a
# lower case of one ASCII letter and is not ASCII (U+212A).
_LISTED = [*COPULA, *VERBS]
MAY_HOLD_VERB = (
    rf"(?i)(?=[{''.join(sorted({w[0] for w in _LISTED}))}])(?<![\p{{L}}\p{{N}}])"
    rf"(?:{'|'.join(_LISTED).replace('k', '[k\u212a]')})(?![\p{{L}}\p{{N}}])|ed(?![\p{{L}}\p{{N}}])"
)

_TOKENS = "array<struct<tok_id: int, text: string, lemma: string, pos: string, dep: string>>"
_ROLES = "array<struct<role: string, value: string>>"


def let(value: Column, kind: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; ``kind`` is the body's type. A fold of one step, as it
    copies nothing, where every level of a transform copies all that lies below it."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


def _verb_lemma(word: Column) -> Column:
    """Lemma if the lower-case word is a verb, else the empty string.

    The common word is no verb, so it meets one hash lookup and one suffix test.
    """
    length = F.length(word)
    listed = F.lit("")
    for form, base in VERBS.items():
        listed = F.when(word == form, F.lit(base)).otherwise(listed)
    stem = (
        F.when(length < 5, F.lit(""))
        .when(
            F.endswith(word, F.lit("ied")),
            F.concat(F.substr(word, F.lit(1), length - 3), F.lit("y")),
        )
        .otherwise(F.substr(word, F.lit(1), length - 2))
    )
    return (
        F.when(
            word.isin(_LISTED),
            F.when(word.isin(COPULA), F.lit("be")).otherwise(listed),
        )
        .when(F.endswith(word, F.lit("ed")), stem)
        .otherwise(F.lit(""))
    )


def _before_verb(verbs: Column, i: Column) -> Column:
    """Whether one of the two words after the ``i``-th is a verb."""
    return F.coalesce(F.get(verbs, i + 1), F.lit(False)) | F.coalesce(
        F.get(verbs, i + 2), F.lit(False)
    )


def _tag(words: Column, lowers: Column, lemmas: Column, verbs: Column, first: Column) -> Column:
    """Tokens of one sentence from its words, their lower-case forms and verb lemmas, whether
    each is a verb, the place (from one) and lemma of the first verb, and which to give."""

    def token(word: Column, i: Column) -> Column:
        lower, lemma = F.get(lowers, i), F.get(lemmas, i)
        verb_tag = F.when(lemma == "be", "AUX").otherwise("VERB")
        noun_tag = F.when(lower != word, "PROPN").otherwise("NOUN")
        noun_dep = (
            F.when(first["at"] == 0, "dep")
            .when(_before_verb(verbs, i), "nsubj")
            .when(i < first["at"], "dep")
            .when(first["lemma"] == "be", "attr")
            .otherwise("dobj")
        )

        def row(lemma: Column, pos: Column, dep: Column) -> Column:
            return F.struct(
                i.alias("tok_id"),
                word.alias("text"),
                lemma.alias("lemma"),
                pos.alias("pos"),
                dep.alias("dep"),
            )

        return (
            F.when(lemma != "", row(lemma, verb_tag, F.lit("ROOT")))
            .when(word < "A", row(lower, F.lit("NUM"), F.lit("dep")))
            .otherwise(row(lower, noun_tag, noun_dep))
        )

    places = F.when(first["to"] > first["from"], F.sequence(first["from"], first["to"] - 1))
    return F.coalesce(
        F.transform(places, lambda i: token(F.get(words, i), i)), F.array().cast(_TOKENS)
    )


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(WORD))


def _in_sentence(sentence: Column, kind: str, body: Callable[..., Column]) -> Column:
    """``body`` of the content words of a sentence, their lower-case forms, their verb lemmas and
    whether each is a verb."""
    content = F.filter(
        F.regexp_extract_all(sentence, F.lit(WORD), F.lit(0)),
        lambda w: ~F.lower(w).isin(FUNCTION_WORDS),
    )
    return let(
        content,
        kind,
        lambda words: let(
            F.transform(words, F.lower),
            kind,
            lambda lowers: let(
                F.transform(lowers, _verb_lemma),
                kind,
                lambda lemmas: let(
                    F.transform(lemmas, lambda x: x != ""),
                    kind,
                    lambda verbs: body(words, lowers, lemmas, verbs),
                ),
            ),
        ),
    )


def _last_verb(verbs: Column) -> Column:
    """Place from one of the last verb of a sentence that has one."""
    return F.size(verbs) + 1 - F.array_position(F.reverse(verbs), F.lit(True)).cast("int")


def _reach(words: Column, at: Column, last: Column) -> tuple[Column, Column]:
    """Of a sentence with a verb the places, from zero and to before, that its triplets may depend
    on. Of nouns only the two before each verb and those after the first verb have a role. After
    the last verb the first noun is the last that can complete a triplet."""
    after = F.slice(words, last + 1, F.size(words))
    noun = F.array_position(F.transform(after, lambda w: w >= "A"), F.lit(True)).cast("int")
    end = F.when(noun == 0, F.size(words)).otherwise(last + noun)
    return F.greatest(at - 3, F.lit(0)), end


def tag_sentence(sentence: Column, whole: Column | None = None) -> Column:
    """Tokens of one sentence; where ``whole`` is false, only those that a triplet may depend on."""
    whole = F.lit(True) if whole is None else whole
    return _in_sentence(sentence, _TOKENS, lambda *parts: _tagged(*parts, whole))


def _tagged(
    words: Column, lowers: Column, lemmas: Column, verbs: Column, whole: Column
) -> Column:
    at = F.array_position(verbs, F.lit(True)).cast("int")
    start, end = _reach(words, at, _last_verb(verbs))
    first = F.when(
        at > 0,
        F.struct(
            at.alias("at"),
            F.get(lemmas, at - 1).alias("lemma"),
            F.when(whole, 0).otherwise(start).alias("from"),
            F.when(whole, F.size(words)).otherwise(end).alias("to"),
        ),
    ).otherwise(
        F.struct(
            F.lit(0).alias("at"),
            F.lit("").alias("lemma"),
            F.lit(0).alias("from"),
            F.when(whole, F.size(words)).otherwise(0).alias("to"),
        )
    )
    return let(first, _TOKENS, lambda x: _tag(words, lowers, lemmas, verbs, x))


def sentence_roles(sentence: Column) -> Column:
    """What the tokens of one sentence set, in order, as far as its triplets depend on it: verbs
    their lemma (p), nouns up to two places before a verb (s) and others after the first (o).

    Around a single verb there is one triplet at most, of the noun before it and the next one
    after it; a sentence without one of them gives nothing.
    """
    return _in_sentence(sentence, _ROLES, _roles)


def _roles(words: Column, _: Column, lemmas: Column, verbs: Column) -> Column:
    none = F.array().cast(_ROLES)

    def sets(register: str, value: Column) -> Column:
        return F.struct(F.lit(register).alias("role"), value.alias("value"))

    def noun(word: Column) -> Column:
        return F.when(word >= "A", word)

    def single(x: Column) -> Column:
        subject = F.coalesce(*[noun(F.get(words, x["at"] - back)) for back in (2, 3)])
        after = F.slice(words, x["at"] + 1, F.size(words))
        obj = F.get(F.filter(after, lambda w: w >= "A"), F.lit(0))
        found = F.array(
            sets("s", subject), sets("p", F.get(lemmas, x["at"] - 1)), sets("o", obj)
        )
        return F.when(subject.isNotNull() & obj.isNotNull(), found).otherwise(none)

    def several(x: Column) -> Column:
        start, end = _reach(words, x["at"], x["last"])

        def role(i: Column) -> Column:
            word = F.get(words, i)
            return (
                F.when(F.get(verbs, i), sets("p", F.get(lemmas, i)))
                .when(word < "A", None)
                .when(_before_verb(verbs, i), sets("s", word))
                .when(i >= x["at"], sets("o", word))
            )

        set_by = F.transform(F.sequence(start, end - 1), role)
        return F.filter(set_by, lambda r: r.isNotNull())

    def found(x: Column) -> Column:
        return (
            F.when(x["at"] == 0, none)
            .when(x["at"] == x["last"], single(x))
            .otherwise(several(x))
        )

    at = F.array_position(verbs, F.lit(True)).cast("int")
    return let(F.struct(at.alias("at"), _last_verb(verbs).alias("last")), _ROLES, found)


def _leading(words: Column, _: Column, lemmas: Column, verbs: Column) -> Column:
    """The first two nouns and the first verb of a sentence, without place and role."""

    def token(text: Column, lemma: Column, pos: str) -> Column:
        return F.struct(
            F.lit(None).cast("int").alias("tok_id"),
            text.alias("text"),
            lemma.alias("lemma"),
            F.lit(pos).alias("pos"),
            F.lit(None).cast("string").alias("dep"),
        )

    none = F.lit(None).cast("string")
    nouns = F.slice(F.filter(words, lambda w, i: (w >= "A") & ~F.get(verbs, i)), 1, 2)
    verb = F.slice(F.filter(lemmas, lambda x: x != ""), 1, 1)
    return F.concat(
        F.transform(nouns, lambda w: token(w, none, "NOUN")),
        F.transform(verb, lambda x: token(none, x, "VERB")),
    )


def read_sentence(sentence: Column, direct: Column) -> Column:
    """What a sentence's tokens set where ``direct`` is true, else the tokens that the fallback
    looks at; the words are taken out of it in one place for both."""

    def read(*parts: Column) -> Column:
        return F.struct(
            F.when(~direct, _leading(*parts)).alias("tokens"),
            F.when(direct, _roles(*parts)).alias("roles"),
        )

    return _in_sentence(sentence, f"struct<tokens: {_TOKENS}, roles: {_ROLES}>", read)


@dataclass(frozen=True)
class SentenceAnnotator:
    """An annotator that tags each sentence by itself, so that a reader may have some tagged only.

    ``split`` gives the sentences of a text and ``tag`` the tokens of one, or only those that its
    triplets depend on where its second argument is false. ``may_hold_verb`` is a cheap test that
    holds for every sentence with a token that is a verb. ``read``, if given, is a shorter way to
    what the triplets of a sentence depend on: a struct of ``tokens``, at least its first two nouns
    and its first verb with text, lemma and kind, or where the second argument is true of
    ``roles``, what its subjects (s), verbs (p) and objects (o) set, in order, as
    ``array<struct<role, value>>``.
    """

    split: Callable[[Column], Column]
    may_hold_verb: Callable[[Column], Column]
    tag: Callable[..., Column]
    read: Callable[[Column, Column], Column] | None = None

    def __call__(self, text: Column) -> Column:
        return F.transform(self.split(text), lambda s: self.tag(s))


rule_annotate = SentenceAnnotator(
    split_sentences,
    lambda sentence: sentence.rlike(MAY_HOLD_VERB),
    tag_sentence,
    read_sentence,
)
