"""Detectors that look at one cell and the fitted statistics of its column.

All of them together are one projection over the table: each row yields an
array of the evidence found in it, so a single scan serves every column and
nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.functions import text as X
from cellwarden.functions.dates import date_format_label, to_iso_date
from cellwarden.operators.cells import is_numeric, is_string, text_of
from cellwarden.operators.evidence import found
from cellwarden.operators.stats import ColumnStats, TableStats

ROW_DETECTORS = (
    "null_detector", "disguised_null_detector", "whitespace_detector",
    "date_format_detector", "outlier_detector", "type_mismatch_detector",
    "high_value_data_detector",
)


def nulls(s: ColumnStats, kind) -> list[Column]:
    if not s.has_null:
        return []
    hit = found("null_detector", s.name, 0.8, None, reasons=["explicit_null"])
    return [F.when(F.col(s.name).isNull(), hit)]


def disguised_nulls(s: ColumnStats, kind) -> list[Column]:
    if not is_string(kind) or not s.null_tokens:
        return []
    share = s.null_tokens / s.n_values
    if share > 0.5:
        return []
    hit = found(
        "disguised_null_detector", s.name, round(1.0 - share, 4), F.col(s.name),
        reasons=["disguised_null"],
        details={"null_token_match": X.normalized(s.name), "null_fraction": round(share, 4)},
    )
    return [F.when(X.is_null_token(s.name), hit)]


def whitespace(s: ColumnStats, kind) -> list[Column]:
    if not is_string(kind):
        return []
    hit = found(
        "whitespace_detector", s.name, 0.95, F.col(s.name), X.strip(s.name),
        reasons=["leading_trailing_whitespace"], repairable=True,
    )
    return [F.when(X.has_outer_whitespace(s.name), hit)]


def dominant_date_format(s: ColumnStats) -> tuple[str, float] | None:
    """Most frequent format and its share; the one seen first wins a tie."""
    if s.n_values < 3 or len(s.dates) < 2:
        return None
    label, (count, _) = min(s.dates.items(), key=lambda kv: (-kv[1][0], kv[1][1]))
    return label, count / sum(n for n, _ in s.dates.values())


def date_formats(s: ColumnStats, kind, iso_values: bool = True) -> list[Column]:
    best = dominant_date_format(s) if is_string(kind) else None
    if best is None:
        return []
    label = date_format_label(s.name)
    hit = found(
        "date_format_detector", s.name, round(best[1], 4), X.strip(s.name),
        to_iso_date(s.name) if iso_values else None,
        reasons=["inconsistent_date_format"], repairable=True,
        details={"observed_format": label, "expected_format": best[0]},
    )
    return [F.when(label != best[0], hit)]


def outlier_bounds(s: ColumnStats) -> tuple[float, float] | None:
    """Quartile fences, or nothing when the rule does not apply."""
    if s.n_values < 5 or s.q1 is None or s.mean is None or s.mean != s.mean:
        return None
    spread = s.q3 - s.q1
    if spread == 0:
        return None
    return s.q1 - C.IQR_FACTOR * spread, s.q3 + C.IQR_FACTOR * spread


def outliers(s: ColumnStats, kind) -> list[Column]:
    fences = outlier_bounds(s) if is_numeric(kind) else None
    if fences is None:
        return []
    v = F.col(s.name).cast("double")
    outside = (v < fences[0]) | (v > fences[1])
    z = F.abs(v - s.mean) / s.std if s.std > 0 else F.lit(0.0)
    far = z > C.Z_LIMIT
    score = F.round(F.least(F.lit(1.0), z / (2 * C.Z_LIMIT)), 4) if s.std > 0 else F.lit(0.7)
    hit = found(
        "outlier_detector", s.name, score, F.col(s.name).cast("string"),
        reasons=F.array(F.when(outside, "iqr_outlier"), F.when(far, "zscore_outlier")),
        details={
            "mean": round(s.mean, 2), "std": round(s.std, 2), "z_score": F.round(z, 2),
            "lower_bound": round(fences[0], 2), "upper_bound": round(fences[1], 2),
            "q1": round(s.q1, 2), "q3": round(s.q3, 2),
        },
    )
    return [F.when(outside | far, hit)]


def dominant_type(s: ColumnStats) -> str | None:
    if s.n_values < 5:
        return None
    if s.integer_hits / s.n_values > C.DOMINANT_TYPE_SHARE:
        return "integer"
    if s.float_hits / s.n_values > C.DOMINANT_TYPE_SHARE:
        return "numeric"
    return None


def type_mismatches(s: ColumnStats, kind) -> list[Column]:
    expected = dominant_type(s) if is_string(kind) else None
    if expected is None:
        return []
    fits = X.is_integer_text(s.name) if expected == "integer" else X.is_float_text(s.name)
    hit = found(
        "type_mismatch_detector", s.name, 0.85, X.strip(s.name),
        reasons=["type_mismatch"], details={"expected_type": expected},
    )
    return [F.when((X.strip(s.name) != "") & ~fits, hit)]


def high_value_columns(types: dict) -> list[tuple[str, int]]:
    """(column, seq) of the columns whose cells need authority.

    A column named in both keyword lists is listed twice. A table that is
    financial by its joined column names, but has no such column, lists its
    numeric ones.
    """
    names = list(types)
    financial = [c for c in names if X.name_has(c, C.FINANCIAL_KEYWORDS)]
    sensitive = [c for c in names if X.name_has(c, C.SENSITIVE_KEYWORDS)]
    chosen = [(c, 0) for c in financial] + [(c, int(c in financial)) for c in sensitive]
    joined = " ".join(names).lower()
    if not chosen and any(k in joined for k in C.FINANCIAL_TABLE_KEYWORDS):
        chosen = [(c, 0) for c in names if is_numeric(types[c])]
    return chosen


def high_values(types: dict) -> list[Column]:
    return [
        F.when(
            F.col(c).isNotNull(),
            found("high_value_data_detector", c, 0.6, text_of(c, types[c]), seq=seq,
                  reasons=["high_value_data", "requires_authority"]),
        )
        for c, seq in high_value_columns(types)
    ]


_PER_COLUMN = {
    "null_detector": nulls,
    "disguised_null_detector": disguised_nulls,
    "whitespace_detector": whitespace,
    "date_format_detector": date_formats,
    "outlier_detector": outliers,
    "type_mismatch_detector": type_mismatches,
}


def row_evidence(df: DataFrame, stats: TableStats, detectors=ROW_DETECTORS,
                 iso_values: bool = True) -> DataFrame | None:
    """Evidence of the row-wise detectors in one scan; none when no rule applies."""
    checks: list[Column] = []
    for name, rule in _PER_COLUMN.items():
        if name in detectors:
            extra = {"iso_values": iso_values} if rule is date_formats else {}
            for s in stats.columns.values():
                checks += rule(s, stats.types[s.name], **extra)
    if "high_value_data_detector" in detectors:
        checks += high_values({c: stats.types[c] for c in stats.columns})
    if not checks:
        return None
    return df.select("row_id", F.inline(F.array_compact(F.array(*checks))))
