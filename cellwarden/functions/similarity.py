"""Indel similarity of two strings: ``2 * LCS / (len(a) + len(b))``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellwarden.functions.text import as_col

# Longest shorter side for which the match row fits in one BIGINT.
WORD_BITS = 62


def _bit(i) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _chars(c) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def _lcs(a: Column, b: Column) -> Column:
    """LCS length, with the positions of ``a`` kept as bits of one BIGINT.

    Each character of ``b`` updates the row once; a cleared bit is a matched
    position. The row never carries past bit 62, so nothing overflows.
    """
    ca = _chars(a)

    def positions(ch):
        hits = F.transform(ca, lambda x, i: F.when(x == ch, _bit(i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(hits, F.lit(0).cast("bigint"), lambda s, x: s + x)

    table = F.map_from_entries(F.transform(F.array_distinct(ca), lambda ch: F.struct(ch, positions(ch))))
    ones = _bit(F.length(a)) - F.lit(1).cast("bigint")
    # Masks of b's characters first, so the table is built once per pair.
    masks = F.transform(
        F.arrays_zip(F.array_repeat(table, 1).alias("t")),
        lambda z: F.transform(_chars(b), lambda ch: F.coalesce(z["t"][ch], F.lit(0).cast("bigint"))),
    )[0]
    row = F.aggregate(
        masks,
        ones,
        lambda r, m: (r + r.bitwiseAND(m)).bitwiseOR(r.bitwiseAND(F.bitwise_not(m))).bitwiseAND(ones),
    )
    return F.length(a) - F.bit_count(row)


def indel_ratio(a, b) -> Column:
    """Case-insensitive similarity in built-ins, for a shorter side up to 62.

    Null when both sides are longer; ``indel_ratio_long`` covers those.
    """
    la, lb = F.lower(as_col(a)), F.lower(as_col(b))
    total = F.length(la) + F.length(lb)
    a_first = F.length(la) <= F.length(lb)
    short = F.when(a_first, la).otherwise(lb)
    other = F.when(a_first, lb).otherwise(la)
    return (
        F.when(total == 0, F.lit(1.0))
        .when(F.length(short) == 0, F.lit(0.0))
        .when(F.length(short) <= WORD_BITS, 2.0 * _lcs(short, other) / total)
    )


@F.pandas_udf(DoubleType())
def indel_ratio_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same similarity for whole texts of any length, per Arrow batch."""

    def one(x, y):
        x, y = x.lower(), y.lower()
        if not x or not y:
            return float(x == y)
        table: dict[str, int] = {}
        for i, ch in enumerate(x):
            table[ch] = table.get(ch, 0) | 1 << i
        ones = row = (1 << len(x)) - 1
        for ch in y:
            m = table.get(ch, 0)
            row = (row + (row & m) | row & ~m) & ones
        return 2.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)])
