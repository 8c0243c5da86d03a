"""The whole analysis of one table as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cellwarden import constants as C
from cellwarden.operators import calibrate as K
from cellwarden.operators import decide as D
from cellwarden.operators import relate as R
from cellwarden.operators.cells import data_columns, with_row_id
from cellwarden.operators.detect import row_evidence
from cellwarden.operators.drift import drifted_columns, with_drift
from cellwarden.operators.evidence import FOUND_SCHEMA, describe
from cellwarden.operators.profile import name_hint
from cellwarden.operators.repair import apply_repairs, auto_edits
from cellwarden.operators.stats import TableStats, fit
from cellwarden.sources.files import spread

UNSAFE_KINDS = ("email", "date", "phone", "identifier", "url")


@dataclass
class Analysis:
    """Results of ``analyze``; the frames run when an action is called."""

    dataset_id: str
    table: DataFrame  # the input with row_id
    columns: list[str]
    stats: TableStats
    fds: list
    evidence: DataFrame
    decisions: DataFrame

    def summary(self) -> DataFrame:
        return D.summarize(self.decisions)

    def close(self) -> None:
        """Release the cached copy of a small input."""
        self.table.unpersist()

    def repaired(self) -> DataFrame:
        return apply_repairs(self.table, auto_edits(self.decisions), self.columns)


def safe_repair_columns(stats: TableStats) -> list[str]:
    """Columns in which one value close to another is likely a typo.

    Emails, dates, phone numbers, identifiers and links differ by little on
    purpose, so they are left to review.
    """
    return [c for c, s in stats.columns.items()
            if name_hint(c) not in UNSAFE_KINDS
            and sum(n for n, _ in s.dates.values()) * 2 < max(s.n_values, 1)]


def find_evidence(df: DataFrame, stats: TableStats, fds: list, parity: bool = False,
                  near_duplicate_distinct: int | None = None) -> DataFrame:
    """What all eleven detectors find in a table that carries ``row_id``."""
    if parity and near_duplicate_distinct is None:
        near_duplicate_distinct = C.NEAR_DUP_MAX_DISTINCT
    parts = [
        row_evidence(df, stats, iso_values=not parity),
        R.rare_patterns(df, stats),
        R.near_duplicates(df, stats, None if parity else safe_repair_columns(stats),
                          max_distinct=near_duplicate_distinct),
        R.duplicate_keys(df, stats),
        R.fd_violations(df, stats, fds),
    ]
    if all(p is None for p in parts):
        return df.sparkSession.createDataFrame([], FOUND_SCHEMA)
    return R.union_all(parts)


def analyze(df: DataFrame, key: str, dataset_id: str = "dataset", columns=None,
            parity: bool = False, near_duplicate_distinct: int | None = None,
            baseline: DataFrame | None = None, limits: DataFrame | None = None, policies=()) -> Analysis:
    """Profile, detect, fuse and decide.

    ``key`` is a unique numeric column used as the row id, checked over all
    rows with the statistics: repeated, null or text keys are refused. Two small jobs run
    at once: column statistics, and the mined dependencies (at most one per
    pair of columns). Everything after that is lazy.

    ``parity`` keeps three behaviours that the safe default avoids: near
    duplicates of identifiers and the like are repaired automatically,
    automatic date decisions carry no value, and near duplicates are searched
    only in columns of up to ``NEAR_DUP_MAX_DISTINCT`` values.
    ``near_duplicate_distinct`` sets that number; None, the default without
    ``parity``, searches every string column.

    ``baseline`` is an earlier ``drift.profile``: cells of drifted columns are
    out of distribution (rule 7). ``limits`` are ``calibrate.thresholds`` of
    reviewed decisions: cells without a single answer abstain (rule 8).
    ``policies`` names detector families whose findings have a policy, so that
    rule 6 lets them pass.
    """
    table = spread(with_row_id(df, key))
    names = data_columns(table, key, columns)
    stats = fit(table, names, check_row_id=True)
    mined = R.mine_fds(table, stats)
    fds = [] if mined is None else sorted(
        ((r["x"], r["y"], r["confidence"]) for r in mined.collect()),
        key=lambda t: (names.index(t[0]), names.index(t[1])))
    evidence = describe(find_evidence(table, stats, fds, parity, near_duplicate_distinct), dataset_id)
    context = D.gate_context(evidence)
    if baseline is not None:
        context = with_drift(context, drifted_columns(table, baseline))
    if limits is not None:
        context = K.with_conformal(context, limits)
    if policies:
        context = K.with_policies(context, policies)
    decisions = D.decide(context, blank_unknown_repairs=parity)
    return Analysis(dataset_id, table, names, stats, fds, evidence, decisions)
