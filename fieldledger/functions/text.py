"""Text rules: word capitals, full names, trimming and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Private-use character that marks a word break set by word_caps.
_BREAK = "\ue000"
# What counts as white space at the ends of a form field.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def word_caps(value: Column | str) -> Column:
    """Capitals at the start of every run of letters, digits and marks; lower case elsewhere.

    Spark's ``initcap`` starts words at blanks only. A marker and a blank after each other
    separator make it start words there too; both are taken out again. A marker character already
    in the text gets a marker of its own, so the removal never touches the text itself.
    """
    opened = F.regexp_replace(_column(value), r"([^\p{L}\p{N}\p{M} ])", "$1" + _BREAK + " ")
    return F.replace(F.initcap(opened), F.lit(_BREAK + " "), F.lit(""))


def full_name(first: Column, last: Column) -> Column:
    """``first last`` with a missing part as empty text; the blank stays."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def strip_space(value: Column | str) -> Column:
    """White space of any kind removed from both ends."""
    return F.regexp_replace(_column(value), rf"^{_SPACE}+|{_SPACE}+\z", "")


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_column(value), F.lit(""))


def or_default(value: Column | str, default: str) -> Column:
    """``value``, or ``default`` where it is missing or empty."""
    return F.coalesce(blank_to_null(value), F.lit(default))
