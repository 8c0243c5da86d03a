"""The evidence table: its columns and the constants of each detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden import constants as C

ORD = {name: i for i, name in enumerate(C.DETECTORS)}

# --- Fixed values: per detector (source, claim, action); the last entry, what
# speaks against the finding, is free text ---
TRAITS = {
    "null_detector": (
        "deterministic", "possible_error", None,
        ["the column may be optional"]),
    "disguised_null_detector": (
        "deterministic", "possible_error", None,
        ["the word may be meant, such as a dash for a question that was not put"]),
    "whitespace_detector": (
        "deterministic", "possible_error", "normalize_whitespace",
        ["fixed-width sources pad their values"]),
    "date_format_detector": (
        "deterministic", "possible_error", "normalize_date",
        ["day and month can be read both ways round"]),
    "pattern_rarity_detector": (
        "deterministic", "possible_error", None,
        ["a rare shape can be a correct value"]),
    "outlier_detector": (
        "statistical", "possible_error", None,
        ["some quantities spread widely by nature"]),
    "type_mismatch_detector": (
        "deterministic", "possible_error", "flag_for_review",
        ["a word can stand for a number that is still open"]),
    "near_duplicate_detector": (
        "deterministic", "possible_error", "normalize",
        ["two different names can be spelt alike"]),
    "duplicate_key_detector": (
        "deterministic", "possible_error", None,
        ["the column may refer to another table, where repeats are normal"]),
    "fd_violation_detector": (
        "deterministic", "possible_error", None,
        ["the rarer value can be the right one", "the rule may have true exceptions"]),
    "high_value_data_detector": (
        "deterministic", "uncertain", "verify_authority",
        ["the name may mislead: the column may hold no money", "it may be a trial value"]),
}
REQUIRED_AUTHORITY = {"high_value_data_detector": 2}

# What a detector itself emits; everything else follows from the detector.
FOUND_SCHEMA = (
    "row_id bigint, column string, detector_ord int, seq int, score double, "
    "observed_value string, expected_value string, reason_codes array<string>, "
    "repairable boolean, details map<string,string>"
)


def found(detector: str, column, score, observed, expected=None, reasons=(),
          repairable=False, details=None, seq=0, **keys) -> Column:
    """Struct of one evidence row, without the row id unless given in ``keys``."""
    text = lambda v: F.lit(None).cast("string") if v is None else v
    pairs = [x for k, v in (details or {}).items()
             for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))]
    detail = F.create_map(*pairs) if pairs else F.lit(None)
    flag = repairable if isinstance(repairable, Column) else F.lit(repairable)
    codes = reasons if isinstance(reasons, Column) else F.array(*[F.lit(r) for r in reasons])
    fields = {
        **keys,
        "column": column if isinstance(column, Column) else F.lit(column),
        "detector_ord": F.lit(ORD[detector]),
        "seq": seq if isinstance(seq, Column) else F.lit(seq),
        "score": (score if isinstance(score, Column) else F.lit(score)).cast("double"),
        "observed_value": text(observed),
        "expected_value": text(expected),
        "reason_codes": codes.cast("array<string>"),
        "repairable": flag,
        "details": detail.cast("map<string,string>"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _sql(value) -> str:
    """SQL literal of a constant; one parsed text is far cheaper to build than
    a call per element."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, list):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def _by_detector(values: list) -> Column:
    """The entry of the row's detector in a list with one value per detector."""
    return F.expr(f"element_at({_sql(values)}, detector_ord + 1)")


def describe(evidence: DataFrame, dataset_id: str = "") -> DataFrame:
    """Complete evidence rows from what the detectors found."""
    trait = lambda i: _by_detector([TRAITS[d][i] for d in C.DETECTORS])
    counter = trait(3)
    authority = _by_detector([REQUIRED_AUTHORITY.get(d, 0) for d in C.DETECTORS])
    detector = _by_detector(list(C.DETECTORS))
    evidence_id = F.sha2(
        F.concat_ws("|", F.lit(dataset_id), "row_id", "column", detector, "seq"), 256)
    return evidence.select(
        evidence_id.alias("evidence_id"),
        F.lit(dataset_id).alias("dataset_id"),
        "row_id", "column",
        detector.alias("detector"), "detector_ord", "seq",
        F.split_part(detector, F.lit("_"), F.lit(1)).alias("family"),
        trait(0).alias("source_type"),
        trait(1).alias("claim"),
        "score", "observed_value", "expected_value", "reason_codes",
        trait(2).alias("action"),
        F.col("repairable").alias("repair_deterministic"),
        F.col("repairable").alias("repair_reversible"),
        authority.alias("required_authority"),
        F.lit(True).alias("reference_verified"),
        counter.alias("counterevidence"),
        "details",
    )
