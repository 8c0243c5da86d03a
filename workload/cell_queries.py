"""Detectors, fusion and decisions over the dirty views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.functions import masses as M
from cellwarden.functions.gate import gate
from cellwarden.operators import decide as D
from cellwarden.operators import fusion as FU
from cellwarden.operators import relate as R
from cellwarden.operators import report as RP
from cellwarden.operators.cells import with_row_id
from cellwarden.operators.detect import row_evidence
from cellwarden.operators.profile import table_semantics
from cellwarden.operators.stats import fit
from cellwarden.plans.analyze import analyze
from cellwarden.sources.files import number_rows
from workload import oracle as O
from workload.context import all_decisions, analysis, table
from workload.registry import ORACLES, query

_OBS = "CASE WHEN col IN {} THEN obs END AS observed_value"


def _string_cols(view):
    return [c for c, k in O.COLUMNS[view].items() if k == "s"]


def _ev_sql(view, ctes, i, extra=""):
    names = O.in_list(_string_cols(view))
    return (O.cells_cte(view) + ", " + O.STATS + ", " + ctes +
            f" SELECT row_id, col, round(score, 4) AS score, {_OBS.format(names)}, exp AS expected_value{extra} FROM e{i}")


def _shown(found, view):
    return found.select(
        "row_id", F.col("column").alias("col"), F.round("score", 4).alias("score"),
        F.when(F.col("column").isin(*_string_cols(view)), F.col("observed_value")).alias("observed_value"),
        "expected_value")


def _row_query(name, view, detector, ctes, i):
    @query(name, _ev_sql(view, ctes, i))
    def run(spark, d):
        a = analysis(spark, d, view)
        return _shown(row_evidence(a.table, a.stats, (detector,)), view)


_row_query("det0_null", "dq_orders", "null_detector", O.NULLS, 0)
_row_query("det1_disguised_null", "dq_orders", "disguised_null_detector", O.DISGUISED, 1)
_row_query("det2_whitespace", "dq_orders", "whitespace_detector", O.WHITESPACE, 2)
_row_query("det3_date_format", "dq_orders", "date_format_detector", O.DATES, 3)
_row_query("det5_outlier", "dq_orders", "outlier_detector", O.OUTLIERS, 5)
_row_query("det6_type_mismatch", "dq_orders", "type_mismatch_detector", O.TYPES, 6)
_row_query("det10_high_value", "dq_orders", "high_value_data_detector", O.high_value("dq_orders"), 10)


@query("det4_pattern_rarity", _ev_sql("dq_orders", O.RARE, 4))
def det4(spark, d):
    a = analysis(spark, d, "dq_orders")
    return _shown(R.rare_patterns(a.table, a.stats), "dq_orders")


@query("det7_near_duplicate", _ev_sql("dq_customer", O.near().lstrip(), 7))
def det7(spark, d):
    a = analysis(spark, d, "dq_customer")
    return _shown(R.near_duplicates(a.table, a.stats), "dq_customer")


_PART_LABELS = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN concat(left(t, 4), substring(t, 6)) ELSE t END AS label
FROM (SELECT p_partkey, concat(p_brand, ' ', p_name) AS t FROM part)"""


def _part_labels(spark, d):
    """A column of more than 500 distinct values, with a letter dropped in every fifth row."""
    t = F.concat_ws(" ", "p_brand", "p_name")
    typo = F.concat(F.substring(t, 1, 4), F.substring(t, 6, 1000))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 5 == 0, typo).otherwise(t).alias("label"))


@query("det7b_near_duplicate_text", f"""WITH RECURSIVE l AS ({_PART_LABELS}),
v AS (SELECT label AS val, count(*) AS c, min(p_partkey) AS row_id FROM l GROUP BY 1),
cand AS (SELECT s.val, s.row_id, r.val AS canon, r.row_id AS cf, lower(s.val) AS a, lower(r.val) AS b FROM v s JOIN v r ON s.c = 1 AND r.c > 1
  WHERE levenshtein(lower(s.val), lower(r.val)) <= 0.15 * (length(s.val) + length(r.val)) + 0.000001),
lcs AS (SELECT *, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM cand
  UNION ALL
  SELECT val, row_id, canon, cf, a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(
    range(1, j + 1), lambda m: greatest(r[m + 1], r[m] + CASE WHEN b[m] = a[i + 1] THEN 1 ELSE 0 END))))) FROM lcs WHERE i < length(a)),
sim AS (SELECT *, 2.0 * r[length(b) + 1] / (length(a) + length(b)) AS ratio FROM lcs WHERE i = length(a))
SELECT row_id, val, arg_min(canon, cf) AS canon, round(arg_min(ratio, cf), 4) AS score FROM sim WHERE ratio >= 0.85 AND ratio < 1 GROUP BY 1, 2""")
def det7b(spark, d):
    df = _part_labels(spark, d)
    return R.near_duplicates(df, fit(df, ["label"])).select(
        "row_id", F.col("observed_value").alias("val"), F.col("expected_value").alias("canon"), "score")


@query("det8_duplicate_key", _ev_sql("dq_customer", O.DUPLICATES, 8))
def det8(spark, d):
    a = analysis(spark, d, "dq_customer")
    return _shown(R.duplicate_keys(a.table, a.stats), "dq_customer")


@query("det8b_duplicate_text", """WITH g AS (SELECT text, count(*) AS c FROM documents GROUP BY 1),
n AS (SELECT count(*) AS n, count(DISTINCT text) AS d FROM documents)
SELECT doc_id, 0.9 AS score, c AS copies, md5(text) AS text_md5 FROM documents JOIN g USING (text), n WHERE c > 1 AND d >= 0.9 * n""")
def det8b(spark, d):
    """Documents whose whole text occurs more than once."""
    df = with_row_id(table(spark, d, "documents"), "doc_id")
    found = R.duplicate_keys(df, fit(df, ["text"]))
    return found.select(
        F.col("row_id").alias("doc_id"), "score",
        F.col("details")["duplicate_count"].cast("bigint").alias("copies"),
        F.md5(F.col("observed_value").cast("binary")).alias("text_md5"))


@query("det9_fd_mining", O.cells_cte("dq_customer") + ", " + O.STATS + ", " + O.fd_ctes("dq_customer").lstrip() +
       " SELECT x, y, round(conf, 4) AS confidence FROM fds")
def det9_mine(spark, d):
    a = analysis(spark, d, "dq_customer")
    return R.mine_fds(a.table, a.stats, first_share=None).select("x", "y", F.round("confidence", 4).alias("confidence"))


# A text column that depends on the quantity, except in some rows.
_BAND_SQL = "CASE WHEN l_partkey % 50 = 0 THEN concat('part ', l_suppkey) ELSE concat('band ', CAST(floor(l_quantity / 10) AS BIGINT)) END"


@query("det9_fd_mining_lineitem", f"WITH lines AS MATERIALIZED (SELECT *, row_number() OVER () AS row_id, {_BAND_SQL} AS band FROM lineitem), "
       f"cells AS ({O.cells('lineitem', source='lines')}), " + O.STATS + ", " + O.fd_ctes("lineitem").lstrip() +
       " SELECT x, y, round(conf, 4) AS confidence FROM fds")
def det9_mine_lines(spark, d):
    """Large enough for the first step on a part of the rows."""
    df = number_rows(table(spark, d, "lineitem")).withColumn("band", F.expr(_BAND_SQL))
    found = R.mine_fds(df, fit(df, list(O.COLUMNS["lineitem"])))
    if found is None:
        return spark.createDataFrame([], "x string, y string, confidence double")
    return found.select("x", "y", F.round("confidence", 4).alias("confidence"))


@query("det9_fd_violation", O.cells_cte("dq_customer") + ", " + O.STATS + ", " + O.fd_ctes("dq_customer").lstrip() +
       " SELECT row_id, col, round(score, 4) AS score, obs AS observed_value, exp AS expected_value, rule AS fd_rule FROM e9")
def det9(spark, d):
    a = analysis(spark, d, "dq_customer")
    return R.fd_violations(a.table, a.stats, a.fds).select(
        "row_id", F.col("column").alias("col"), F.round("score", 4).alias("score"),
        "observed_value", "expected_value", F.col("details")["fd_rule"].alias("fd_rule"))


@query("det5b_outlier_events", """WITH s AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(least(1.0, abs(value - mean) / sd / 6), 4) AS score,
       (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outlier, abs(value - mean) / sd > 3 AS zscore_outlier
FROM events, s WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) OR abs(value - mean) / sd > 3""")
def det5b(spark, d):
    df = with_row_id(table(spark, d, "events"), "event_id")
    found = row_evidence(df, fit(df, ["value"]), ("outlier_detector",))
    return found.select(
        F.col("row_id").alias("event_id"), F.round("score", 4).alias("score"),
        F.col("reason_codes")[0].isNotNull().alias("iqr_outlier"),
        F.col("reason_codes")[1].isNotNull().alias("zscore_outlier"))


# --- fusion -----------------------------------------------------------------

_W = "-ln(1 - least(greatest({}, 0), 1 - 1e-6))"


@query("fu1_weight", f"SELECT l_discount, l_tax, round({_W.format('l_discount * 10')}, 6) AS w_discount, "
       f"round({_W.format('l_tax')}, 6) AS w_tax, count(*) AS n FROM lineitem GROUP BY 1, 2")
def fu1(spark, d):
    return table(spark, d, "lineitem").groupBy("l_discount", "l_tax").agg(F.count("*").alias("n")).select(
        "l_discount", "l_tax", F.round(M.weight(F.col("l_discount") * 10), 6).alias("w_discount"),
        F.round(M.weight("l_tax"), 6).alias("w_tax"), "n")


_MASS_SQL = """SELECT {keys}, round(s * (1 - t) / d, 4) AS belief_error, round(t * (1 - s) / d, 4) AS belief_clean,
 round((1 - s) * (1 - t) / d, 4) AS ignorance, round(s * t, 4) AS conflict, round(1 / (1 + exp(wn - wp)), 4) AS score
FROM (SELECT *, 1 - exp(-wp) AS s, 1 - exp(-wn) AS t, greatest(1 - (1 - exp(-wp)) * (1 - exp(-wn)), 1e-6) AS d FROM {src})"""
_MASSES = ("belief_error", "belief_clean", "ignorance", "conflict", "score")


def _round_masses(df, *keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in _MASSES])


@query("fu2_masses", _MASS_SQL.format(keys="l_orderkey, l_linenumber", src=f"""(SELECT l_orderkey, l_linenumber,
 {_W.format('l_discount * 8')} AS wp, {_W.format('l_tax * 8')} AS wn FROM lineitem)"""))
def fu2(spark, d):
    w = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", M.weight(F.col("l_discount") * 8).alias("wp"),
        M.weight(F.col("l_tax") * 8).alias("wn"))
    return _round_masses(w.withColumns(M.masses("wp", "wn")), "l_orderkey", "l_linenumber")


_COMBINE = {
    "family": "(SELECT row_id, col, sgn, sum(w) AS w FROM (SELECT row_id, col, sgn, det, max(w) AS w FROM sw GROUP BY ALL) GROUP BY ALL)",
    "dempster": "(SELECT row_id, col, sgn, sum(w) AS w FROM sw GROUP BY ALL)",
    "cautious": "(SELECT row_id, col, sgn, max(w) AS w FROM sw GROUP BY ALL)",
}


def _fuse_sql(view, rule):
    return O.evidence(view) + f""", sw AS (SELECT row_id, col, det, CASE WHEN det = 10 THEN -1 ELSE 1 END AS sgn,
  -ln(1 - least(score, 1 - 1e-6)) AS w FROM ev WHERE score <> 0),
c AS (SELECT row_id, col, coalesce(sum(CASE WHEN sgn > 0 THEN w END), 0) AS wp,
             coalesce(sum(CASE WHEN sgn < 0 THEN w END), 0) AS wn FROM {_COMBINE[rule]} GROUP BY ALL)
""" + _MASS_SQL.format(keys="row_id, col", src="c")


def _fuse_query(name, view, rule):
    @query(name, _fuse_sql(view, rule))
    def run(spark, d):
        fused = FU.fuse_cells(analysis(spark, d, view).evidence, rule)
        return _round_masses(fused.withColumnRenamed("column", "col"), "row_id", "col")


_fuse_query("fu3_family", "dq_customer", "family")
_fuse_query("fu3_dempster", "dq_customer", "dempster")
_fuse_query("fu3_cautious", "dq_customer", "cautious")
_fuse_query("fu4_cell_fusion", "dq_orders", "family")


# Verdicts of an outside assessor, derived from the order table.
_VERDICT_SQL = """verdicts AS (SELECT o_orderkey AS row_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'likely_error' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'likely_clean' ELSE 'clean' END AS assessment,
  (o_orderkey % 9 + 1) / 10.0 AS confidence FROM orders)"""


def _verdicts(spark, d):
    k = F.col("o_orderkey") % 5
    word = (F.when(k == 0, "error").when(k == 1, "likely_error").when(k == 2, "uncertain")
            .when(k == 3, "likely_clean").otherwise("clean"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.lit("o_totalprice").alias("column"),
        word.alias("assessment"), ((F.col("o_orderkey") % 9 + 1) / 10.0).alias("confidence"))


_VERDICT_SCORE = """CASE WHEN assessment IN ('error', 'clean') THEN confidence
 WHEN assessment = 'uncertain' THEN 0.5 ELSE 0.8 * confidence END"""
_VERDICT_CLAIM = """CASE WHEN assessment IN ('error', 'likely_error') THEN 'possible_error'
 WHEN assessment = 'uncertain' THEN 'uncertain' ELSE 'likely_clean' END"""


def _table_sql(rule, part):
    """Cells of dq_orders, with row verdicts by order key."""
    agg = "sum" if rule == "dempster" else "max"
    total = "greatest(coalesce(w, 0), coalesce(ve, 0))" if rule == "cautious" else "coalesce(w, 0) + coalesce(ve, 0)"
    comb = {"family": "sum(w)", "dempster": "sum(w)", "cautious": "max(w)"}[rule]
    inner = "max(w)" if rule != "dempster" else "sum(w)"
    return O.evidence("dq_orders") + f""", {_VERDICT_SQL},
w0 AS (SELECT row_id, col, det, {inner} AS w FROM (SELECT row_id, col, det, -ln(1 - least(score, 1 - 1e-6)) AS w FROM ev WHERE det <> 10) GROUP BY ALL),
cw AS (SELECT row_id, col, {comb} AS w FROM w0 GROUP BY ALL),
rv AS (SELECT row_id, {agg}(CASE WHEN {_VERDICT_CLAIM} = 'possible_error' THEN -ln(1 - least(confidence, 1 - 1e-6)) ELSE 0 END) AS ve,
  {agg}(CASE WHEN {_VERDICT_CLAIM} = 'likely_clean' THEN -ln(1 - least(confidence, 1 - 1e-6)) ELSE 0 END) AS vc FROM verdicts GROUP BY 1),
cells_m AS (SELECT row_id, col, w AS wp, coalesce(vc, 0) AS wn FROM cw LEFT JOIN rv USING (row_id)),
rows_m AS (SELECT row_id, {total} AS wp, coalesce(vc, 0) AS wn FROM (SELECT row_id, max(w) AS w FROM cw GROUP BY 1) FULL JOIN rv USING (row_id))
""" + _MASS_SQL.format(keys="row_id, col" if part == "cells_m" else "row_id", src=part)


def _fused_table(spark, d, rule):
    ev = analysis(spark, d, "dq_orders").evidence.where("detector_ord <> 10")
    v = FU.verdicts_to_evidence(_verdicts(spark, d)).select("row_id", "claim").join(
        _verdicts(spark, d).select("row_id", "confidence"), "row_id")
    w = M.weight("confidence")
    rows = v.select(
        "row_id", F.lit(None).cast("string").alias("column"), F.lit("auditor").alias("agent"),
        F.when(F.col("claim") == "possible_error", w).otherwise(0.0).alias("w_error"),
        F.when(F.col("claim") == "likely_clean", w).otherwise(0.0).alias("w_clean"))
    return FU.fuse_table(ev, rows, rule)


@query("fu5_table_cells", _table_sql("family", "cells_m"))
def fu5_cells(spark, d):
    cells, _ = _fused_table(spark, d, "family")
    return _round_masses(cells.withColumnRenamed("column", "col"), "row_id", "col")


def _rows_query(rule):
    @query(f"fu5_table_rows_{rule}", _table_sql(rule, "rows_m"))
    def run(spark, d):
        _, rows = _fused_table(spark, d, rule)
        return _round_masses(rows, "row_id")


for _rule in FU.RULES:
    _rows_query(_rule)


@query("fu6_verdicts", f"""WITH {_VERDICT_SQL} SELECT row_id, {_VERDICT_CLAIM} AS claim, round({_VERDICT_SCORE}, 4) AS score,
 CASE WHEN {_VERDICT_CLAIM} = 'likely_clean' THEN -1 ELSE 1 END * round({_VERDICT_SCORE}, 4) AS signed_score FROM verdicts""")
def fu6(spark, d):
    return FU.verdicts_to_evidence(_verdicts(spark, d)).select("row_id", "claim", "score", "signed_score")


# --- decisions --------------------------------------------------------------

def _context_sql(view):
    return O.decided(view) + """ SELECT row_id, col, coalesce(round(k, 4), 0) AS conflict,
 round((1 - s) * (1 - t) / d, 4) AS ignorance, action_type, impact AS action_impact, auth AS required_authority,
 rep AS repair_deterministic, CASE WHEN rep THEN 'ACTIVE' ELSE 'MISSING' END AS policy_status, evidence_count FROM gated"""


@query("de1_gate_context", _context_sql("dq_orders"))
def de1(spark, d):
    return D.gate_context(analysis(spark, d, "dq_orders").evidence).select(
        "row_id", F.col("column").alias("col"), F.round("conflict", 4).alias("conflict"),
        F.round("ignorance", 4).alias("ignorance"), "action_type", "action_impact", "required_authority",
        "repair_deterministic", "policy_status", "evidence_count")


# A truth table of the gate with one context per line item.
_BITS = {"unsupported_input": 97, "security_violation": 89, "out_of_distribution": 7,
         "conformal_abstain": 11, "validated_autonomy": 2}
_CTX_SQL = f"""ctx AS (SELECT l_orderkey, l_linenumber,
 {", ".join(f"(l_orderkey + l_linenumber) % {m} = 0 AS {k}" for k, m in _BITS.items())},
 l_linenumber % 3 AS authority_level, l_partkey % 3 AS required_authority,
 CASE l_suppkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS action_impact,
 CASE WHEN l_partkey % 5 = 0 THEN 'MISSING' ELSE 'ACTIVE' END AS policy_status,
 l_discount * 4 AS conflict, l_tax * 6 AS ignorance, l_quantity > 20 AS reference_verified,
 l_returnflag = 'A' AS repair_deterministic, l_linestatus = 'F' AS repair_reversible FROM lineitem)"""
_GATE_SQL = """CASE WHEN unsupported_input THEN 1 WHEN security_violation THEN 2
 WHEN authority_level < required_authority THEN 3 WHEN action_impact = 'HIGH' THEN 4
 WHEN repair_deterministic AND repair_reversible AND action_impact = 'LOW' AND NOT out_of_distribution AND conflict < 0.3 THEN 5
 WHEN policy_status <> 'ACTIVE' THEN 6 WHEN out_of_distribution THEN 7 WHEN conformal_abstain THEN 8
 WHEN conflict >= 0.3 THEN 9 WHEN ignorance >= 0.4 THEN 10 WHEN NOT reference_verified THEN 11
 WHEN repair_deterministic AND repair_reversible THEN 12 WHEN validated_autonomy THEN 13 ELSE 14 END"""


@query("de2_gate", f"""WITH {_CTX_SQL}, g AS (SELECT l_orderkey, l_linenumber, {_GATE_SQL} AS rule FROM ctx)
SELECT l_orderkey, l_linenumber, rule, CASE WHEN rule < 3 THEN 'BLOCK' WHEN rule IN (5, 12, 13) THEN 'AUTO' ELSE 'ESCALATE' END AS decision,
 CASE WHEN rule IN (3, 4) THEN 'authority' WHEN rule = 6 THEN 'policy' WHEN rule IN (7, 8, 9, 10, 11, 14) THEN 'factual' END AS uncertainty_type FROM g""")
def de2(spark, d):
    lines = table(spark, d, "lineitem")
    at = F.col("l_orderkey") + F.col("l_linenumber")
    supplier = F.col("l_suppkey") % 4
    ctx = lines.select(
        "l_orderkey", "l_linenumber", *[(at % m == 0).alias(k) for k, m in _BITS.items()],
        (F.col("l_linenumber") % 3).alias("authority_level"), (F.col("l_partkey") % 3).alias("required_authority"),
        F.when(supplier == 0, "HIGH").when(supplier == 1, "MEDIUM").otherwise("LOW").alias("action_impact"),
        F.when(F.col("l_partkey") % 5 == 0, "MISSING").otherwise("ACTIVE").alias("policy_status"),
        (F.col("l_discount") * 4).alias("conflict"), (F.col("l_tax") * 6).alias("ignorance"),
        (F.col("l_quantity") > 20).alias("reference_verified"),
        (F.col("l_returnflag") == "A").alias("repair_deterministic"),
        (F.col("l_linestatus") == "F").alias("repair_reversible"))
    return ctx.withColumn("g", gate(ctx.columns)).select("l_orderkey", "l_linenumber", "g.*")


_DEC_COLS = """row_id, col, CASE WHEN col IN {s} THEN obs END AS old_value, new_value, decision, uncertainty_type, risk_level,
 belief_error, belief_clean, ignorance, conflict_k, action_type, reversible, evidence_count"""


def _dec_sql(view):
    return O.decided(view) + f" SELECT {_DEC_COLS.format(s=O.in_list(_string_cols(view)))} FROM dec"


def _decisions_query(name, view):
    @query(name, _dec_sql(view))
    def run(spark, d):
        return analysis(spark, d, view).decisions.select(
            "row_id", F.col("column").alias("col"),
            F.when(F.col("column").isin(*_string_cols(view)), F.col("old_value")).alias("old_value"),
            "new_value", "decision", "uncertainty_type", "risk_level", "belief_error", "belief_clean",
            "ignorance", "conflict_k", "action_type", "reversible", "evidence_count")


_decisions_query("de3_decisions_orders", "dq_orders")
_decisions_query("de3_decisions_customer", "dq_customer")


@query("de4_question")
def de4(spark, d):
    escalated = analysis(spark, d, "dq_customer").decisions.where("decision = 'ESCALATE'")
    return escalated.select("row_id", F.col("column").alias("col"), D.question().alias("question"))


_SUMMARY = """ SELECT {ds} AS dataset_id, sum(evidence_count) AS total_evidence, count(*) AS total_decisions,
 count_if(decision = 'AUTO') AS auto_count, count_if(decision = 'ESCALATE') AS escalate_count, count_if(decision = 'BLOCK') AS block_count,
 round(count_if(decision = 'AUTO') / count(*), 4) AS automation_rate, round(count_if(decision = 'ESCALATE') / count(*), 4) AS escalation_rate FROM dec"""


@query("de5_summary", O.decided("dq_customer") + _SUMMARY.format(ds="'dq_customer'"))
def de5(spark, d):
    return analysis(spark, d, "dq_customer").summary()


_ISSUE_SQL = f"""CASE WHEN contains(action_type, 'whitespace') OR starts_with(old, ' ') OR ends_with(old, ' ') THEN 'surrounding_whitespace'
 WHEN contains(lower(col), 'date') OR contains(old, '/') OR contains(old, '-') THEN 'date_format_mismatch'
 WHEN {O.strip('upper(old)')} IN {O.in_list(C.ISSUE_NULL_WORDS)} THEN 'disguised_missing_value'
 WHEN has_outlier OR (belief_error > 0.4 AND (contains(lower(col), 'salary') OR contains(lower(col), 'luong') OR contains(lower(col), 'price') OR contains(lower(col), 'amount'))) THEN 'statistical_outlier'
 WHEN contains(action_type, 'duplicate') OR contains(lower(col), 'id') THEN 'duplicate_entity'
 WHEN contains(action_type, 'authority') THEN 'authority_guard' ELSE 'quality_suspicion' END"""


@query("de6_issue_class", O.decided("dq_orders") + f""", o AS (SELECT DISTINCT row_id, col, true AS has_outlier FROM ev WHERE det = 5),
i AS (SELECT row_id, col, {_ISSUE_SQL} AS issue_class FROM (SELECT dec.*, coalesce(obs, 'None') AS old, coalesce(has_outlier, false) AS has_outlier FROM dec LEFT JOIN o USING (row_id, col)))
SELECT issue_class, col, count(*) AS n FROM i GROUP BY ALL""")
def de6(spark, d):
    return D.classify_issues(analysis(spark, d, "dq_orders").decisions).groupBy(
        "issue_class", F.col("column").alias("col")).agg(F.count("*").alias("n"))


@query("de7_report", O.decided("dq_orders") + """, t AS (SELECT count(*) AS n FROM orders)
SELECT 'dq_orders' AS dataset_id, 'ecommerce_sales' AS domain_id, max(n) AS n_rows, 6 AS n_columns, count(*) AS total_decisions,
 greatest(0, least(100, round((1 - count(*) / (max(n) * 6)) * 100, 1))) AS cleanliness_score, 'amber' AS status_color FROM dec, t""")
def de7(spark, d):
    a = analysis(spark, d, "dq_orders")
    datasets = a.table.agg(F.lit("dq_orders").alias("dataset_id"), F.count("*").alias("n_rows"),
                           F.lit(len(a.columns)).alias("n_columns"))
    catalog = spark.createDataFrame([("dq_orders", c, i) for i, c in enumerate(a.columns)],
                                    "dataset_id string, column string, position int")
    out = RP.report(a.summary(), datasets, table_semantics(catalog))
    return out.select("dataset_id", "domain_id", "n_rows", "n_columns", "total_decisions",
                      "cleanliness_score", "status_color")


@query("pl1_summary", O.decided("dq_orders") + _SUMMARY.format(ds="'dq_orders'"))
def pl1(spark, d):
    from cellwarden.plans.views import dirty_view

    return analyze(dirty_view(spark, d, "dq_orders"), "row_id", "dq_orders").summary()


@query("det7c_near_duplicate_numbers", O.cells_cte("dq_orders") + ", " + O.STATS + "," + O.near(O.SAFE["dq_orders"])
       + """SELECT row_id, col, obs, exp, score, rep FROM e7 WHERE col = 'units'""")
def det7c(spark, d):
    """Numbers held as text, by the defaults of the analysis: found, and left to review where digits differ."""
    return analysis(spark, d, "dq_orders").evidence.where(
        "detector = 'near_duplicate_detector' and column = 'units'").select(
        "row_id", F.col("column").alias("col"), F.col("observed_value").alias("obs"), F.col("expected_value").alias("exp"),
        "score", F.col("repair_deterministic").alias("rep"))


@query("pl1b_near_duplicate_text", ORACLES["det7b_near_duplicate_text"])
def pl1b(spark, d):
    """The whole analysis by its defaults on a column of any number of distinct values."""
    a = analyze(_part_labels(spark, d), "row_id", "part_labels")
    return a.evidence.where("detector = 'near_duplicate_detector'").select(
        "row_id", F.col("observed_value").alias("val"), F.col("expected_value").alias("canon"), "score")


@query("rp1_stats", f"""SELECT count(DISTINCT ds) AS datasets_count, count(*) AS total_decisions, count_if(decision = 'AUTO') AS auto_count,
 count_if(decision = 'ESCALATE') AS escalate_count, round(count_if(decision = 'AUTO') / count(*), 4) AS automation_rate FROM (
 SELECT 'o' AS ds, decision FROM ({O.decided('dq_orders')} SELECT decision FROM dec) UNION ALL
 SELECT 'c', decision FROM ({O.decided('dq_customer')} SELECT decision FROM dec))""")
def rp1(spark, d):
    return RP.stats(all_decisions(spark, d))


_CASES = [("V1", "dq_orders", "AUTO"), ("V2", "dq_customer", "AUTO"), ("V3", "dq_customer", "AUTO,BLOCK"),
          ("V4", "dq_orders", "ESCALATE"), ("V5", "dq_customer", "ESCALATE")]


@query("rp2_verify_cases", f"""WITH cases(case_id, ds, accepted) AS (VALUES {', '.join(str(c) for c in _CASES)}),
dec2 AS (SELECT 'dq_orders' AS ds, decision, count(*) AS n FROM ({O.decided('dq_orders')} SELECT decision FROM dec) GROUP BY ALL UNION ALL
 SELECT 'dq_customer', decision, count(*) FROM ({O.decided('dq_customer')} SELECT decision FROM dec) GROUP BY ALL)
SELECT case_id, ds AS dataset_id, accepted, string_agg(decision, ',' ORDER BY decision) AS actual,
 bool_or(list_contains(string_split(accepted, ','), decision)) AS passed FROM cases LEFT JOIN dec2 USING (ds) GROUP BY ALL""")
def rp2(spark, d):
    cases = spark.createDataFrame(_CASES, "case_id string, dataset_id string, accepted string")
    return RP.verify_cases(cases, all_decisions(spark, d))


@query("rp3_decision_filter", O.decided("dq_orders") + " SELECT row_id, col, action_type FROM dec WHERE decision = 'AUTO'")
def rp3(spark, d):
    return RP.filter_decisions(analysis(spark, d, "dq_orders").decisions, "AUTO").select(
        "row_id", F.col("column").alias("col"), "action_type")


_TRUTH = """truth AS (SELECT o_orderkey AS row_id, 'priority' AS col FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 OR o_orderkey % 107 = 0
 UNION ALL SELECT o_orderkey, 'ordered_date' FROM orders WHERE o_orderkey % 53 = 0
 UNION ALL SELECT o_orderkey, 'total_price' FROM orders WHERE o_orderkey % 997 = 0
 UNION ALL SELECT o_orderkey, 'units' FROM orders WHERE o_orderkey % 211 = 0)"""


@query("rp4_detection_quality", O.evidence("dq_orders") + f""", {_TRUTH}, f AS (SELECT DISTINCT row_id, col FROM ev WHERE det <> 10),
j AS (SELECT count_if(f.row_id IS NOT NULL AND t.row_id IS NOT NULL) AS true_positives, count_if(t.row_id IS NULL) AS false_positives,
 count_if(f.row_id IS NULL) AS false_negatives FROM f FULL JOIN truth t ON f.row_id = t.row_id AND f.col = t.col)
SELECT *, round(true_positives / (true_positives + false_positives), 4) AS precision,
 round(true_positives / (true_positives + false_negatives), 4) AS recall,
 round(2 * true_positives / (2 * true_positives + false_positives + false_negatives), 4) AS f1 FROM j""")
def rp4(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    wrong = {"priority": (k % 101 == 0) | (k % 103 == 0) | (k % 107 == 0), "ordered_date": k % 53 == 0,
             "total_price": k % 997 == 0, "units": k % 211 == 0}
    truth = orders.select(k.alias("row_id"), F.explode(F.array_compact(F.array(*[
        F.when(c, F.lit(name)) for name, c in wrong.items()]))).alias("column"))
    return RP.detection_quality(
        analysis(spark, d, "dq_orders").evidence.where("detector_ord <> 10"), truth)
