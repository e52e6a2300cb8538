"""Text helpers. Every helper takes and returns Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(value: Column) -> Column:
    """`value`, null where it is the empty string. Also for texts with a collation, which `nullif` cannot take."""
    return F.when(value != F.lit(""), value)


def or_default(value: Column, default: Column) -> Column:
    """`value`, or `default` where it is null or the empty string."""
    return F.coalesce(filled(value), default)


def yn(flag: Column) -> Column:
    """Y/N flag with null and blank read as N."""
    return or_default(flag, F.lit("N"))


def is_blank(value: Column) -> Column:
    return F.coalesce(F.length(value), F.lit(0)) < 1


def shown(value: Column) -> Column:
    """Text of a value as it appears in messages and text exports: null prints as `null`."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def zero_pad(value: Column, width: int) -> Column:
    """Left-pad with zeros and keep the right-most characters of longer input.

    `lpad` would keep the left-most ones.
    """
    return F.right(F.concat(F.lit("0" * width), F.coalesce(value.cast("string"), F.lit(""))), F.lit(width))


def strip_whitespace(value: Column) -> Column:
    """Trim every kind of white space; `trim` removes spaces only."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def color_tail(color: Column) -> Column:
    """Part after the last underscore, untrimmed (the whole text when there is none)."""
    return F.substring_index(color, "_", -1)


def color_tail_trimmed(color: Column) -> Column:
    """Part after the last underscore, spaces trimmed."""
    return F.trim(color_tail(color))


def color_after_first(color: Column) -> Column:
    """Part after the first underscore, spaces trimmed: `A_B_RED` gives `B_RED`."""
    return F.trim(F.substr(color, F.instr(color, "_") + 1))


def strict_name(first: Column, last: Column) -> Column:
    """Full name, null as soon as either part is null."""
    return F.concat(first, F.lit(" "), last)


def lenient_name(first: Column, last: Column) -> Column:
    """Full name in which missing parts are skipped."""
    return F.trim(F.concat(F.coalesce(first, F.lit(" ")), F.lit(" "), F.coalesce(last, F.lit(""))))


def label_case(text: Column) -> Column:
    """Each space-separated word capitalised and preceded by one space, as printed on labels."""
    words = F.split(F.lower(text), " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.lit(" "), F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))),
        "",
    )
