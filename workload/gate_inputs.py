"""Drift and conformal inputs of the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.operators import calibrate as K
from cellwarden.operators import decide as D
from cellwarden.operators import drift as DR
from cellwarden.operators import review as RV
from workload import oracle as O
from workload.context import analysis
from workload.registry import query
from workload.review_queries import _REV, _submissions

# --- drift: the orders of the two lower priorities, and those without, against the rest ---

_NAMES = list(O.COLUMNS["dq_orders"])
_EARLIER = "coalesce(trim(priority) < '4', false)"
_EDGES = "[" + ", ".join(str(p) for p in DR.TENTHS) + "]"
_BIN = f"""CASE WHEN c.val IS NULL THEN 'missing'
 WHEN c.kind <> 's' THEN concat('tenth ', CAST(len(list_filter(e.edges, lambda x: x <= c.num)) AS VARCHAR))
 WHEN t.val IS NOT NULL THEN concat('value ', c.val) ELSE concat('length ', CAST(length(bin(length(c.val))) AS VARCHAR)) END"""


def _bin_ctes(baseline: str) -> str:
    """After ``cells``: every cell of dq_orders with its bin and whether its row is of the baseline."""
    return f"""old AS (SELECT row_id FROM dq_orders WHERE {baseline}),
edge AS (SELECT col, quantile_cont(num, {_EDGES}) AS edges FROM cells JOIN old USING (row_id) WHERE kind <> 's' GROUP BY col),
topv AS (SELECT col, val FROM cells JOIN old USING (row_id) WHERE kind = 's' AND length(val) <= {DR.LONGEST_VALUE} GROUP BY col, val
 QUALIFY row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, val) <= {DR.TOP_VALUES}),
binned AS (SELECT c.col, {_BIN} AS bin, old.row_id IS NOT NULL AS is_old FROM cells c LEFT JOIN old USING (row_id)
 LEFT JOIN edge e ON e.col = c.col LEFT JOIN topv t ON t.col = c.col AND t.val = c.val)"""


_PSI = f"""cnt AS (SELECT col, bin, count_if(is_old) AS was, count_if(NOT is_old) AS cur FROM binned GROUP BY col, bin),
tot AS (SELECT *, count(*) OVER w AS n_bins, sum(was) OVER w AS all_was, sum(cur) OVER w AS all_cur FROM cnt WINDOW w AS (PARTITION BY col)),
shr AS (SELECT *, (was + {DR.HALF}) / CAST(all_was + {DR.HALF} * n_bins AS DOUBLE) AS p,
 (cur + {DR.HALF}) / CAST(all_cur + {DR.HALF} * n_bins AS DOUBLE) AS q FROM tot),
psi AS (SELECT col, n_bins, CAST(all_was AS BIGINT) AS baseline_rows, CAST(all_cur AS BIGINT) AS batch_rows,
 round(sum((q - p) * ln(q / p)), 6) AS psi FROM shr GROUP BY ALL)"""


def _halves(a):
    earlier = F.expr(_EARLIER)
    return a.table.where(earlier), a.table.where(~earlier)


@query("pr14_bin_profile", O.cells_cte("dq_orders") + f", {_bin_ctes('true')} SELECT col, bin, count(*) AS n FROM binned GROUP BY col, bin")
def bin_profile(spark, d):
    a = analysis(spark, d, "dq_orders")
    return DR.profile(a.table, _NAMES).select(F.col("column").alias("col"), "bin", "n")


@query("de8_drift", O.cells_cte("dq_orders") + f", {_bin_ctes(_EARLIER)}, {_PSI} SELECT * FROM psi")
def drift(spark, d):
    old, new = _halves(analysis(spark, d, "dq_orders"))
    return DR.drift(new, DR.profile(old, _NAMES)).withColumnRenamed("column", "col")


# The gate over the fused cells ``m``, with both inputs; rules as in the gate.
def _gated(out_of_distribution: str, abstain: str, active: str, source: str = "m") -> str:
    return f"""SELECT row_id, col, CASE WHEN 0 < auth OR action_type = 'verify_authority' THEN 3
 WHEN rep AND NOT ({out_of_distribution}) AND k < {C.MAX_CONFLICT} THEN 5 WHEN NOT (rep OR {active}) THEN 6
 WHEN {out_of_distribution} THEN 7 WHEN {abstain} THEN 8 WHEN k >= {C.MAX_CONFLICT} THEN 9
 WHEN (1 - s) * (1 - t) / d >= {C.MAX_IGNORANCE} THEN 10 WHEN rep THEN 12 ELSE 14 END AS rule FROM {source}"""


@query("de8_drift_decisions", O.decided("dq_orders") + f", {_bin_ctes(_EARLIER)}, {_PSI}, far AS (SELECT col FROM psi WHERE psi > {DR.MAX_DRIFT}), moved AS (SELECT m.*, far.col IS NOT NULL AS ood FROM m LEFT JOIN far USING (col)) "
       + _gated("ood", "false", "false", "moved"))
def drift_decisions(spark, d):
    a = analysis(spark, d, "dq_orders")
    old, new = _halves(a)
    context = DR.with_drift(D.gate_context(a.evidence), DR.drifted_columns(new, DR.profile(old, _NAMES)))
    return D.decide(context).select("row_id", F.col("column").alias("col"), "rule")


# --- conformal: reviews of the customers' cells ---

_FAMILY = "[" + ", ".join(O.q(n.split("_")[0]) for n in C.DETECTORS) + "]"
_REVIEWED = f"""{_REV}, fam AS (SELECT row_id, col, {_FAMILY}[1 + first(det ORDER BY det <> 10 DESC, round(score, 6) DESC, det)] AS family FROM ev GROUP BY row_id, col),
seen AS (SELECT row_id, col, family, belief_error AS be, last.action <> 'REJECT' AS is_error FROM last JOIN dec USING (row_id, col) JOIN fam USING (row_id, col))"""


def _limits_sql(where: str = "true") -> str:
    return f"""sc AS (SELECT family, is_error, round(CASE WHEN is_error THEN 1 - be ELSE be END, 4) AS score FROM seen WHERE {where}),
rk AS (SELECT *, row_number() OVER (PARTITION BY family, is_error ORDER BY score) AS r, count(*) OVER (PARTITION BY family, is_error) AS n FROM sc),
lim AS (SELECT family, is_error, n, min(CASE WHEN r >= ceil(round((n + 1) * CAST({1 - K.ALPHA} AS DOUBLE), 9)) THEN score END) AS threshold FROM rk GROUP BY ALL)"""


_SETS = """wide AS (SELECT family, max(CASE WHEN is_error THEN threshold END) AS te, max(CASE WHEN NOT is_error THEN threshold END) AS tc FROM lim GROUP BY family)"""
_IN_ERROR, _IN_CLEAN = "coalesce(round(1 - {b}, 4) <= te, true)", "coalesce(round({b}, 4) <= tc, true)"


def _reviewed(spark, d):
    a = analysis(spark, d, "dq_customer")
    context = D.gate_context(a.evidence)
    return context, K.outcomes(context, RV.submit(_submissions(a.decisions)))


@query("rv3_conformal_limits", O.decided("dq_customer") + f", {_REVIEWED}, {_limits_sql()} SELECT * FROM lim")
def conformal_limits(spark, d):
    return K.thresholds(_reviewed(spark, d)[1])


@query("rv3_conformal_coverage", O.decided("dq_customer") + f", {_REVIEWED}, {_limits_sql('row_id % 4 = 0')}, {_SETS} "
       f"SELECT family, is_error, count(*) AS n, count_if(CASE WHEN is_error THEN {_IN_ERROR.format(b='be')} ELSE {_IN_CLEAN.format(b='be')} END) AS covered "
       "FROM seen LEFT JOIN wide USING (family) WHERE row_id % 4 <> 0 GROUP BY family, is_error")
def conformal_coverage(spark, d):
    reviewed = _reviewed(spark, d)[1]
    return K.coverage(reviewed.where("row_id % 4 <> 0"), K.thresholds(reviewed.where("row_id % 4 = 0")))


@query("de9_conformal_decisions", O.decided("dq_customer") + f", {_REVIEWED}, {_limits_sql()}, {_SETS}, "
       "open AS (SELECT m.*, family, te, tc, belief_error AS be FROM m JOIN dec USING (row_id, col) JOIN fam USING (row_id, col) LEFT JOIN wide USING (family)) "
       + _gated("false", f"{_IN_ERROR.format(b='be')} = {_IN_CLEAN.format(b='be')}", "family IN ('pattern', 'fd')", "open"))
def conformal_decisions(spark, d):
    context, reviewed = _reviewed(spark, d)
    context = K.with_policies(K.with_conformal(context, K.thresholds(reviewed)), ["pattern", "fd"])
    return D.decide(context).select("row_id", F.col("column").alias("col"), "rule")
