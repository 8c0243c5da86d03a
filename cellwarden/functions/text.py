"""String expressions shared by profiling and detection."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwarden import constants as C

LONG_VALUE = 64


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def shape(c) -> Column:
    """Character-class shape: runs of upper, lower, digit and space collapse.

    One ``translate`` maps each character to its class, one regex collapses
    the runs, so a value is walked twice instead of four times.
    """
    source = string.ascii_uppercase + string.ascii_lowercase + string.digits + C.WHITESPACE
    target = "A" * 26 + "a" * 26 + "9" * 10 + " " * len(C.WHITESPACE)
    classes = F.translate(as_col(c), source, target)
    return F.regexp_replace(classes, r"([Aa9 ])\1+", "$1")


def strip(c) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(as_col(c), F.lit(C.WHITESPACE))


def normalized(c) -> Column:
    return F.lower(strip(c))


def is_null_token(c, tokens=C.DETECTOR_NULL_TOKENS) -> Column:
    return normalized(c).isin(*tokens)


def has_outer_whitespace(c) -> Column:
    """The value changes when stripped, and something is left."""
    s = strip(c)
    return (as_col(c) != s) & (s != "")


def matches(c, semantic_type: str) -> Column:
    return as_col(c).rlike(C.SEMANTIC_PATTERNS[semantic_type])


def is_integer_text(c) -> Column:
    return strip(c).rlike(C.INTEGER_PATTERN)


def is_float_text(c) -> Column:
    return strip(c).rlike(C.FLOAT_PATTERN)


def name_has(name: str, keywords) -> bool:
    """A keyword occurs anywhere in the lower-cased column name."""
    low = name.lower().strip()
    return any(k in low for k in keywords)


def name_contains(c, keywords) -> Column:
    """The same test over a DataFrame of column names."""
    low = normalized(c)
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k)
    return hit


def value_key(c) -> Column:
    """Grouping key of a string: itself when short, a SHA-256 digest when long.

    Keeps the rows of a shuffle on whole documents small. A digest key is
    longer than any short value, so the two kinds never meet.
    """
    v = as_col(c)
    digest = F.concat(F.lit("sha256:"), F.sha2(v.cast("binary"), 256))
    return F.when(F.length(v) <= LONG_VALUE, v).otherwise(digest)
