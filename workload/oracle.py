"""SQL building blocks for the counterpart queries (DuckDB dialect)."""

from __future__ import annotations

from cellwarden import constants as C
from cellwarden.plans.views import duckdb_sql

# Kinds of the checked columns: i integer, f float, s string.
COLUMNS = {
    "dq_orders": {"customer": "i", "order_state": "s", "total_price": "f",
                  "ordered_date": "s", "priority": "s", "units": "s"},
    "dq_customer": {"customer_code": "i", "full_name": "s", "nation_no": "i", "nation_name": "s",
                    "region_name": "s", "segment": "s", "contact": "s", "balance": "f"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "f",
                 "l_extendedprice": "f", "l_discount": "f", "l_tax": "f", "l_returnflag": "s", "l_linestatus": "s",
                 "l_shipdate": "s", "band": "s"},
}

SPACES = " || ".join(f"chr({ord(c)})" for c in C.WHITESPACE)
SPACE_CLASS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in C.WHITESPACE) + "]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {SPACES})"


def shape(e: str) -> str:
    for pattern, mark in (("[A-Z]+", "A"), ("[a-z]+", "a"), ("[0-9]+", "9"), (SPACE_CLASS + "+", " ")):
        e = f"regexp_replace({e}, {q(pattern)}, {q(mark)}, 'g')"
    return e


def is_token(e: str, tokens=C.DETECTOR_NULL_TOKENS) -> str:
    return f"lower({strip(e)}) IN {in_list(tokens)}"


def rlike(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(pattern)})"


def date_label(e: str) -> str:
    s = strip(e)
    return "CASE " + " ".join(f"WHEN {rlike(s, p)} THEN {q(n)}" for n, p in C.DATE_FORMATS) + " END"


def iso_date(e: str) -> str:
    s, lab = strip(e), date_label(e)
    n = [name for name, _ in C.DATE_FORMATS]
    strp = lambda fmt: f"strftime(try_strptime({s}, {q(fmt)}), '%Y-%m-%d')"
    second = f"CAST(split_part({s}, '/', 2) AS INTEGER)"
    return (
        f"CASE {lab} WHEN {q(n[0])} THEN CASE WHEN {second} > 12 THEN {strp('%m/%d/%Y')} ELSE {strp('%d/%m/%Y')} END "
        f"WHEN {q(n[1])} THEN {strp('%d-%m-%Y')} WHEN {q(n[2])} THEN {strp('%d.%m.%Y')} "
        f"WHEN {q(n[3])} THEN {strp('%Y-%m-%d')} WHEN {q(n[4])} THEN {strp('%Y/%m/%d')} END"
    )


def cells(view: str, names=None, source: str | None = None) -> str:
    """Long cells (row_id, col, kind, val, num) of a view or CTE."""
    kinds = COLUMNS[view] if names is None else {c: COLUMNS[view][c] for c in names}
    parts = []
    for i, (c, k) in enumerate(kinds.items()):
        num = f"CAST({c} AS DOUBLE)" if k in "if" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT row_id, {i} AS ord, {q(c)} AS col, {q(k)} AS kind, "
                     f"CAST({c} AS VARCHAR) AS val, {num} AS num FROM {source or view}")
    return " UNION ALL ".join(parts)


def view_cte(view: str) -> str:
    return f"{view} AS ({duckdb_sql(view)})"


def cells_cte(view: str) -> str:
    return f"WITH RECURSIVE {view_cte(view)}, cells AS ({cells(view)})"


# --- one CTE per detector: row_id, col, det, score, obs, exp, rep -----------

def _ev(det: int, score: str, where: str, obs="val", exp="CAST(NULL AS VARCHAR)", rep="false",
        source="cells", rule="CAST(NULL AS VARCHAR)") -> str:
    return (f"SELECT row_id, col, {det} AS det, CAST({score} AS DOUBLE) AS score, {obs} AS obs, "
            f"{exp} AS exp, {rep} AS rep, {rule} AS rule FROM {source} WHERE {where}")


STATS = f"""col_stats AS (
  SELECT col, kind, count(*) AS n, count(val) AS nv, count(DISTINCT val) AS nd,
         count(DISTINCT val) + max(CASE WHEN val IS NULL THEN 1 ELSE 0 END) AS nd0,
         avg(CASE WHEN {is_token('val')} THEN 1.0 WHEN val IS NOT NULL THEN 0.0 END) AS tok,
         avg(CASE WHEN {rlike(strip('val'), C.INTEGER_PATTERN)} THEN 1.0 WHEN val IS NOT NULL THEN 0.0 END) AS ints,
         avg(CASE WHEN {rlike(strip('val'), C.FLOAT_PATTERN)} THEN 1.0 WHEN val IS NOT NULL THEN 0.0 END) AS floats,
         avg(num) AS mean, stddev_pop(num) AS sd,
         quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.75) AS q3
  FROM cells GROUP BY col, kind),
val_counts AS (SELECT col, kind, val, count(*) AS c, min(row_id) AS first_row
               FROM cells WHERE val IS NOT NULL GROUP BY col, kind, val)"""

NULLS = "e0 AS (" + _ev(0, "0.8", "val IS NULL", obs="CAST(NULL AS VARCHAR)") + ")"
DISGUISED = "e1 AS (" + _ev(
    1, "round(1 - tok, 4)", f"kind = 's' AND tok <= 0.5 AND {is_token('val')}",
    source="cells JOIN col_stats USING (col, kind)") + ")"
WHITESPACE = "e2 AS (" + _ev(
    2, "0.95", f"kind = 's' AND val <> {strip('val')} AND {strip('val')} <> ''",
    exp=strip("val"), rep="true") + ")"
DATES = f"""labels_d AS (SELECT row_id, col, {strip('val')} AS val, {date_label('val')} AS lab,
             {iso_date('val')} AS iso FROM cells WHERE kind = 's' AND val IS NOT NULL),
lab_counts AS (SELECT col, lab, count(*) AS c, min(row_id) AS f FROM labels_d WHERE lab IS NOT NULL GROUP BY col, lab),
lab_best AS (SELECT l.col, arg_min(lab, (-c * 1e12 + f)) AS best, max(c) / sum(c) AS share, count(*) AS k
             FROM lab_counts l JOIN col_stats s ON l.col = s.col AND s.nv >= 3 GROUP BY l.col),
e3 AS (""" + _ev(3, "round(share, 4)", "k >= 2 AND lab <> best", exp="iso", rep="true",
                 source="labels_d JOIN lab_best USING (col)") + ")"
RARE = f"""shapes AS (SELECT row_id, col, val, {shape('val')} AS sh FROM cells WHERE kind = 's' AND val IS NOT NULL),
shape_c AS (SELECT col, sh, count(*) AS c FROM shapes GROUP BY col, sh),
shape_n AS (SELECT col, sum(c) AS n, max(c) / sum(c) AS dom FROM shape_c GROUP BY col HAVING sum(c) >= 5),
e4 AS (""" + _ev(4, "round(dom * (1 - (c / n) / 0.05), 4)", "c / n < 0.05",
                 source="shapes JOIN shape_c USING (col, sh) JOIN shape_n USING (col)") + ")"
Z = "abs(num - mean) / sd"
OUTLIERS = "e5 AS (" + _ev(
    5, f"CASE WHEN sd > 0 THEN round(least(1.0, {Z} / 6), 4) ELSE 0.7 END",
    f"num IS NOT NULL AND nv >= 5 AND q3 > q1 AND (num < q1 - 1.5 * (q3 - q1) OR num > q3 + 1.5 * (q3 - q1) "
    f"OR (sd > 0 AND {Z} > 3))",
    source="cells JOIN col_stats USING (col, kind)") + ")"
TYPES = "e6 AS (" + _ev(
    6, "0.85",
    f"kind = 's' AND nv >= 5 AND {strip('val')} <> '' AND "
    f"((ints > 0.8 AND NOT {rlike(strip('val'), C.INTEGER_PATTERN)}) OR "
    f"(ints <= 0.8 AND floats > 0.8 AND NOT {rlike(strip('val'), C.FLOAT_PATTERN)}))",
    obs=strip("val"), source="cells JOIN col_stats USING (col, kind)") + ")"


def near(safe_columns=None) -> str:
    digits = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
    same = f"{digits('val')} = {digits('canon')}"
    rep = "true" if safe_columns is None else f"col IN {in_list(safe_columns)} AND {same}" if safe_columns else "false"
    return f"""
lens AS (SELECT s.col, s.val, s.first_row AS row_id, v.val AS canon, v.first_row AS cf,
                lower(s.val) AS a, lower(v.val) AS b, length(s.val) + length(v.val) AS t,
                CAST(floor(0.15 * (length(s.val) + length(v.val)) + 0.000001) AS INTEGER) AS edits
         FROM val_counts s JOIN val_counts v ON s.col = v.col AND s.c = 1 AND v.c > 1
         JOIN col_stats k ON k.col = s.col AND k.kind = 's' AND k.nv >= 5 AND k.nd >= 2
         WHERE abs(length(s.val) - length(v.val)) <= 0.15 * (length(s.val) + length(v.val)) + 0.000001),
cand AS (SELECT col, val, row_id, canon, cf, a, b FROM lens WHERE levenshtein(a, b) <= edits - (edits + t) % 2),
lcs AS (SELECT col, val, row_id, canon, cf, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM cand
        UNION ALL
        SELECT col, val, row_id, canon, cf, a, b, i + 1,
               list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(
                 range(1, j + 1), lambda m: greatest(r[m + 1], r[m] + CASE WHEN b[m] = a[i + 1] THEN 1 ELSE 0 END)))))
        FROM lcs WHERE i < length(a)),
sim AS (SELECT *, 2.0 * r[length(b) + 1] / (length(a) + length(b)) AS ratio FROM lcs WHERE i = length(a)),
near_best AS (SELECT col, row_id, val, arg_min(canon, cf) AS canon, arg_min(ratio, cf) AS ratio
              FROM sim WHERE ratio >= 0.85 AND ratio < 1 GROUP BY col, row_id, val),
e7 AS (""" + _ev(7, "round(ratio, 4)", "true", exp="canon", rep=rep, source="near_best") + ")"


KEY_NAME = " OR ".join(f"contains(lower(col), {q(k)})" for k in C.KEY_NAME_HINTS)
DUPLICATES = f"""key_cols AS (SELECT col FROM col_stats
   WHERE n >= 3 AND nd0 >= n * CASE WHEN {KEY_NAME} THEN 0.5 ELSE 0.9 END),
e8 AS (""" + _ev(8, "0.9", "c > 1",
                 source="cells JOIN key_cols USING (col) JOIN val_counts USING (col, kind, val)") + ")"


def fd_ctes(view: str) -> str:
    names = list(COLUMNS[view])
    order = "CASE col " + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(names)) + " END"
    tok = in_list(C.FD_NULL_TOKENS)
    return f"""
fd_x AS (SELECT s.col FROM col_stats s JOIN val_counts v USING (col)
         GROUP BY s.col, s.n, s.nd HAVING s.nd > 1 AND s.nd < 0.9 * s.n
         AND sum(CASE WHEN v.c >= 3 THEN v.c ELSE 0 END) >= 0.3 * s.n),
fd_y AS (SELECT s.col FROM col_stats s JOIN val_counts v USING (col)
         GROUP BY s.col, s.nd, s.nv HAVING s.nd > 1 AND max(v.c) < 0.9 * s.nv),
fd_cells AS (SELECT a.row_id, a.col AS x, b.col AS y, a.val AS xv,
               CASE WHEN b.val IS NULL OR lower({strip('b.val')}) IN {tok} THEN NULL ELSE b.val END AS yv
             FROM cells a JOIN fd_x ON a.col = fd_x.col
             JOIN cells b ON a.row_id = b.row_id AND a.col <> b.col
             JOIN fd_y ON b.col = fd_y.col WHERE a.val IS NOT NULL),
fd_cnt AS (SELECT x, y, xv, yv, count(*) AS c FROM fd_cells GROUP BY x, y, xv, yv),
fd_grp AS (SELECT x, y, xv, sum(c) AS size, sum(CASE WHEN yv IS NOT NULL THEN c END) AS kept,
                  max(CASE WHEN yv IS NOT NULL THEN c END) AS mode_c
           FROM fd_cnt GROUP BY x, y, xv HAVING sum(c) >= 3),
fds AS (SELECT x, y, sum(mode_c) / sum(kept) AS conf FROM fd_grp GROUP BY x, y
        HAVING sum(kept) >= 0.3 * (SELECT max(n) FROM col_stats) AND sum(mode_c) / sum(kept) >= 0.9),
fd_s AS (SELECT x, y, xv, {strip('yv')} AS yv, sum(c) AS c FROM fd_cnt JOIN fds USING (x, y)
         WHERE yv IS NOT NULL GROUP BY x, y, xv, {strip('yv')}),
fd_mode AS (SELECT s.x, s.y, s.xv, first(s.yv ORDER BY s.c DESC, s.yv) AS mode, max(s.c) AS mode_c, max(g.size) AS size
            FROM fd_s s JOIN fd_grp g USING (x, y, xv) GROUP BY s.x, s.y, s.xv),
fd_bad AS (SELECT f.row_id, f.y AS col, {strip('f.yv')} AS val, m.mode, d.conf, f.x || ' -> ' || f.y AS rule, m.size
           FROM fd_cells f JOIN fds d USING (x, y) JOIN fd_mode m USING (x, y, xv)
           JOIN fd_s s ON s.x = f.x AND s.y = f.y AND s.xv = f.xv AND s.yv = {strip('f.yv')}
           WHERE s.c < m.mode_c),
e9 AS (""" + _ev(9, "round(conf * 0.9, 4)", "true", exp="mode", source="fd_bad", rule="rule") + ")"


def high_value(view: str) -> str:
    hits = [c for c in COLUMNS[view] if any(k in c for k in C.FINANCIAL_KEYWORDS)]
    hits += [c for c in COLUMNS[view] if any(k in c for k in C.SENSITIVE_KEYWORDS)]
    parts = [_ev(10, "0.6", f"col = {q(c)} AND val IS NOT NULL") for c in hits] or [_ev(10, "0.6", "false")]
    return "e10 AS (" + " UNION ALL ".join(parts) + ")"


SAFE = {"dq_orders": ["order_state", "total_price", "priority", "units", "customer"],
        "dq_customer": ["customer_code", "full_name", "nation_no", "nation_name", "region_name",
                        "segment", "contact", "balance"]}


def evidence(view: str) -> str:
    """All detectors of a view up to the CTE ``ev``."""
    parts = [STATS, NULLS, DISGUISED, WHITESPACE, DATES, RARE, OUTLIERS, TYPES,
             near(SAFE[view]), DUPLICATES, fd_ctes(view), high_value(view)]
    union = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(11))
    return cells_cte(view) + ", " + ", ".join(parts) + f", ev AS ({union})"


FUSED = """
wts AS (SELECT row_id, col, det, CASE WHEN det = 10 THEN -1 ELSE 1 END AS sgn,
               max(-ln(1 - least(score, 1 - 1e-6))) AS w
        FROM ev WHERE score <> 0 GROUP BY row_id, col, det),
ctx AS (SELECT row_id, col,
          1 - exp(-coalesce(sum(CASE WHEN sgn > 0 THEN w END), 0)) AS s,
          1 - exp(-coalesce(sum(CASE WHEN sgn < 0 THEN w END), 0)) AS t
        FROM wts GROUP BY row_id, col),
cell AS (SELECT row_id, col, count(*) AS evidence_count, bool_or(rep) AS rep,
          max(CASE WHEN det = 10 THEN 2 ELSE 0 END) AS auth,
          coalesce(arg_min(CASE det WHEN 2 THEN 'normalize_whitespace' WHEN 3 THEN 'normalize_date'
             WHEN 6 THEN 'flag_for_review' WHEN 7 THEN 'normalize' WHEN 10 THEN 'verify_authority' END, det)
             FILTER (WHERE det IN (2, 3, 6, 7, 10)), 'unknown') AS action_type,
          arg_min(exp, det) FILTER (WHERE exp IS NOT NULL) AS exp,
          arg_min(obs, det) FILTER (WHERE obs IS NOT NULL) AS obs
        FROM ev GROUP BY row_id, col),
m AS (SELECT *, s * t AS k, greatest(1 - s * t, 1e-6) AS d FROM cell LEFT JOIN ctx USING (row_id, col)),
gated AS (SELECT *, CASE WHEN action_type = 'verify_authority' THEN 'HIGH' ELSE 'LOW' END AS impact,
   CASE WHEN 0 < auth OR action_type = 'verify_authority' THEN 'authority'
        WHEN rep AND k < 0.3 THEN 'AUTO'
        WHEN NOT rep THEN 'policy'
        WHEN k >= 0.3 OR (1 - s) * (1 - t) / d >= 0.4 THEN 'factual' ELSE 'AUTO' END AS outcome
   FROM m),
dec AS (SELECT row_id, col, obs, CASE WHEN outcome = 'AUTO' THEN exp END AS new_value,
   CASE WHEN outcome = 'AUTO' THEN 'AUTO' ELSE 'ESCALATE' END AS decision,
   CASE WHEN outcome <> 'AUTO' THEN outcome END AS uncertainty_type, impact AS risk_level,
   round(s * (1 - t) / d, 4) AS belief_error, round(t * (1 - s) / d, 4) AS belief_clean,
   round((1 - s) * (1 - t) / d, 4) AS ignorance, round(k, 4) AS conflict_k,
   action_type, rep AS reversible, evidence_count
   FROM gated)"""


def decided(view: str) -> str:
    """Everything up to the CTE ``dec``."""
    return evidence(view) + ", " + FUSED
