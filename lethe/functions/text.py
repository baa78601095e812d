"""Identifier and blank-text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# \z and not $: the latter would let a trailing newline through.
IDENTIFIER = r"\A[a-zA-Z0-9_-]{3,64}\z"
# Unicode White_Space; the worker's notion of blank adds the four ASCII separators.
NOT_SPACE = r"(?U)\S"
NOT_SPACE_OR_SEPARATOR = r"(?U)[^\s\x1c-\x1f]"
_STRIP = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def valid_identifier(value: Column) -> Column:
    """3 to 64 ASCII letters, digits, ``_`` or ``-``; null is invalid."""
    return F.coalesce(value.rlike(IDENTIFIER), F.lit(False))


def _holds(value: Column, pattern: str) -> Column:
    """Whether some character of a value matches; null has none. Most have one near their start,
    and a search takes all that it is given out of UTF-8 first, so the rest is looked at last."""
    start = F.substring(value, 1, 32)
    return F.coalesce(start.rlike(pattern) | value.rlike(pattern), F.lit(False))


def non_blank(value: Column) -> Column:
    """At least one character outside Unicode White_Space; null is blank."""
    return _holds(value, NOT_SPACE)


def has_content(value: Column) -> Column:
    """As :func:`non_blank` for the encoder and annotator, where U+001C..U+001F are blank."""
    return _holds(value, NOT_SPACE_OR_SEPARATOR)


def strip(value: Column) -> Column:
    """Trim on both sides what :func:`has_content` counts as blank."""
    return F.regexp_replace(value, _STRIP, "")


def short_hash(value: Column, placeholder: str) -> Column:
    """First ten and last eight characters, or the placeholder for an empty hash."""
    return F.when(
        F.coalesce(F.length(value), F.lit(0)) > 0,
        F.concat(F.substring(value, 1, 10), F.lit("..."), F.right(value, F.lit(8))),
    ).otherwise(F.lit(placeholder))


def contains_folded(value: Column, query: str) -> Column:
    """Case-insensitive literal substring test (``%`` and ``_`` have no meaning)."""
    return F.coalesce(F.contains(F.lower(value), F.lit(query.lower())), F.lit(False))


def error_message(body: Column, fallback: str) -> Column:
    """What to show of an error response: the ``message`` text of a JSON body, else the body as
    it is, or the fallback if there is none."""
    message = F.try_variant_get(F.try_parse_json(body), "$.message", "variant")
    is_text = F.schema_of_variant(message) == "STRING"
    text = F.when(is_text, F.try_variant_get(message, "$", "string"))
    return (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit(fallback))
        .when(non_blank(text), text)
        .otherwise(body)
    )
