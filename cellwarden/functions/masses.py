"""Dempster-Shafer masses on the frame {error, clean} as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwarden.constants import MASS_EPSILON
from cellwarden.functions.text import as_col


def weight(score) -> Column:
    """Weight of evidence ``-ln(1 - s)``, with s held below one."""
    s = F.least(F.greatest(F.abs(as_col(score)), F.lit(0.0)), F.lit(1.0 - MASS_EPSILON))
    return -F.log1p(-s)


def masses(w_error, w_clean) -> dict[str, Column]:
    """Beliefs, ignorance, conflict and score from two summed weights."""
    wp, wn = as_col(w_error), as_col(w_clean)
    doubt_error, doubt_clean = F.exp(-wp), F.exp(-wn)
    for_error, for_clean = 1.0 - doubt_error, 1.0 - doubt_clean
    conflict = for_error * for_clean
    rest = F.greatest(1.0 - conflict, F.lit(MASS_EPSILON))
    return {
        "belief_error": for_error * doubt_clean / rest,
        "belief_clean": for_clean * doubt_error / rest,
        "ignorance": doubt_error * doubt_clean / rest,
        "conflict": conflict,
        "score": 1.0 / (1.0 + F.exp(wn - wp)),
    }
