"""Repairs, edits, reviews, ledger and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwarden.operators import commands as CM
from cellwarden.operators import decide as D
from cellwarden.operators import ledger as L
from cellwarden.operators import repair as RE
from cellwarden.operators import review as RV
from cellwarden.operators.cells import with_row_id
from cellwarden.operators.stats import fit
from cellwarden.sources.catalog import Catalog, write_cleaned
from cellwarden.streaming import detect as ST
from cellwarden.streaming import late as LT
from workload import oracle as O
from workload.context import all_decisions, analysis, scratch, table
from workload.registry import query

TS = "2024-01-01 00:00:00"


def _ts():
    return F.lit(TS).cast("timestamp")


# --- repair -----------------------------------------------------------------

_ORDER_COLS = list(O.COLUMNS["dq_orders"])


def _repaired_sql(view, cols, fix="new_value", where="decision = 'AUTO'"):
    """Pivot the automatic values back onto the view."""
    kinds = O.COLUMNS[view]
    val = lambda c: f"max(CASE WHEN col = {O.q(c)} THEN {fix} END)"
    types = {"i": "BIGINT", "f": "DOUBLE", "s": "VARCHAR"}
    fixes = ", ".join(f"{val(c)} AS n_{c}" for c in cols)
    out = ", ".join(f"coalesce(TRY_CAST(n_{c} AS {types[kinds[c]]}), v.{c}) AS {c}" for c in cols)
    return (O.decided(view) + f", fx AS (SELECT row_id, {fixes} FROM dec WHERE {where} AND coalesce({fix}, '') <> '' GROUP BY 1) "
            f"SELECT v.row_id, {out} FROM {view} v LEFT JOIN fx USING (row_id)")


@query("re1_auto_repair", _repaired_sql("dq_orders", _ORDER_COLS))
def re1(spark, d):
    return analysis(spark, d, "dq_orders").repaired().select("row_id", *_ORDER_COLS)


@query("io6_cleaned_table", _repaired_sql("dq_customer", list(O.COLUMNS["dq_customer"])))
def io6(spark, d):
    path = write_cleaned(analysis(spark, d, "dq_customer").repaired(), scratch(spark, "clean"), "dq_customer", 1)
    return spark.read.parquet(path).select("row_id", *O.COLUMNS["dq_customer"])


# Reviewer commands derived from the decided cells of each row.
_CMD_SQL = """cmd AS (SELECT row_id AS command_id, row_id, CASE row_id % 4 WHEN 0 THEN 'priority' WHEN 1 THEN 'ngày đặt' WHEN 2 THEN NULL ELSE 'units' END AS spoken,
  concat('fixed', CAST(row_id % 10 AS VARCHAR)) AS new_value, CASE WHEN row_id % 10 = 9 THEN 'REJECT' ELSE 'EDIT' END AS action FROM dq_orders)"""


def _commands(a):
    k = F.col("row_id")
    spoken = F.when(k % 4 == 0, "priority").when(k % 4 == 1, "ngày đặt").when(k % 4 == 3, "units")
    return a.table.select(
        k.alias("command_id"), "row_id", spoken.alias("column"),
        F.concat(F.lit("fixed"), (k % 10).cast("string")).alias("new_value"),
        F.when(k % 10 == 9, "REJECT").otherwise("EDIT").alias("action"))


_COL_ORDER = "CASE col " + " ".join(f"WHEN {O.q(c)} THEN {i}" for i, c in enumerate(_ORDER_COLS)) + " END"
_RESOLVED = (f"{_CMD_SQL}, fd AS (SELECT row_id, arg_min(col, {_COL_ORDER}) AS decided FROM dec GROUP BY 1), "
             "res AS (SELECT command_id, row_id, coalesce(CASE WHEN spoken IN ('priority', 'units') THEN spoken END, decided) AS col, new_value, action "
             "FROM cmd LEFT JOIN fd USING (row_id))")


@query("re2_resolve_edits", O.decided("dq_orders") + f", {_RESOLVED} SELECT command_id, row_id, col, new_value, action FROM res WHERE col IS NOT NULL")
def re2(spark, d):
    a = analysis(spark, d, "dq_orders")
    return RE.resolve_edits(_commands(a), a.decisions, a.columns).withColumnRenamed("column", "col")



@query("re2_apply_edits", O.decided("dq_orders") + f""", {_RESOLVED},
fx AS (SELECT row_id, max(CASE WHEN col = 'units' THEN new_value END) AS nu, max(CASE WHEN col = 'priority' THEN new_value END) AS np
       FROM res WHERE action = 'EDIT' GROUP BY 1)
SELECT row_id, coalesce(nu, units) AS units, coalesce(np, priority) AS priority, customer FROM dq_orders LEFT JOIN fx USING (row_id)""")
def re2b(spark, d):
    a = analysis(spark, d, "dq_orders")
    edits = RE.resolve_edits(_commands(a), a.decisions, a.columns).where("action = 'EDIT'")
    return RE.apply_repairs(a.table, edits, a.columns).select("row_id", "units", "priority", "customer")


@query("re3_batch_edit", O.decided("dq_customer") + """, top AS (SELECT col FROM dec WHERE decision = 'ESCALATE' GROUP BY col ORDER BY count(*) DESC, col LIMIT 1)
SELECT row_id, col, '0' AS new_value FROM dec JOIN top USING (col)""")
def re3(spark, d):
    a = analysis(spark, d, "dq_customer")
    return RE.batch_edits(a.decisions, a.columns, "0").withColumnRenamed("column", "col")


@query("re3_batch_edit_named", O.decided("dq_customer") + " SELECT row_id, col, 'X' AS new_value FROM dec WHERE col = 'segment'")
def re3b(spark, d):
    a = analysis(spark, d, "dq_customer")
    return RE.batch_edits(a.decisions, a.columns, "X", "Segment").withColumnRenamed("column", "col")


# Every conversation turn becomes one message; the phrase depends on its key.
_K = "(conv_id * 7 + turn)"
_MESSAGES = f"""m AS (SELECT conv_id, turn, CASE {_K} % 9
 WHEN 0 THEN concat('Bác bỏ dòng ', CAST(turn AS VARCHAR(20)))
 WHEN 1 THEN concat('approve row ', CAST(conv_id AS VARCHAR(20)))
 WHEN 2 THEN concat('  Sửa dòng ', CAST(turn AS VARCHAR(20)), ' cột salary thành ', CAST(conv_id AS VARCHAR(20)), ' triệu')
 WHEN 3 THEN concat('dòng ', CAST(turn AS VARCHAR(20)), ' sửa lương = Giám Đốc, cảm ơn')
 WHEN 4 THEN concat('thay đổi các giá trị cột math score thành ', CAST(turn AS VARCHAR(20)), ' điểm cho tôi')
 WHEN 5 THEN concat('cập nhật salary thành ', CAST(turn AS VARCHAR(20)), '.5 triệu')
 WHEN 6 THEN 'Từ chối hàng 12'
 WHEN 7 THEN concat('update department = Sales', CAST(conv_id AS VARCHAR(20)))
 ELSE text END AS msg FROM conversations)"""


def _messages(spark, d):
    conv = table(spark, d, "conversations")
    sql = _MESSAGES.split("AS (", 1)[1].rsplit(")", 1)[0].replace("FROM conversations", "FROM {conv}")
    return spark.sql(sql, conv=conv)


_SP = O.SPACE_CLASS
_RE2 = lambda p: p.replace(r"[^\n\.,]", "[^\n.,]").replace(r"\s", _SP).replace(
    r"[\wÀ-ỹ]", r"[\p{L}\p{M}\p{N}\p{Pc}]").replace(r"[a-zA-Z0-9_" + _SP, "[a-zA-Z0-9_" + _SP[1:-1])


def _extract(p, i):
    return f"regexp_extract(t, {O.q(_RE2(p))}, {i})"


def _found(p):
    return O.rlike("t", _RE2(p))


def _million(v):
    digits = f"regexp_replace({v}, '[^0-9.]', '', 'g')"
    return (f"CASE WHEN (contains({v}, 'triệu') OR contains({v}, 'trieu')) AND {digits} <> '' "
            f"THEN CAST(CAST(CAST({digits} AS DECIMAL(30,9)) * 1000000 AS BIGINT) AS VARCHAR) ELSE {v} END")


_OR = lambda words: "(" + " OR ".join(f"contains(t, {O.q(w)})" for w in words) + ")"
_IS_BATCH = f"{_OR(CM.BATCH_VERBS)} AND {_OR(CM.BATCH_VALUE_WORDS)} AND {_found(CM.BATCH_VALUE)}"
_BATCH_VALUE = O.strip(f"regexp_replace({O.strip(_extract(CM.BATCH_VALUE, 1))}, {O.q(CM.BATCH_TAIL)}, '')")
_LISTED = "CASE " + " ".join(f"WHEN contains(t, {O.q(w)}) THEN {O.q(w)}" for w in CM.BATCH_COLUMN_WORDS) + " END"
_E1, _E2 = CM.EDIT_VERB_FIRST, CM.EDIT_ROW_FIRST


@query("re4_edit_commands", f"""WITH {_MESSAGES}, l AS (SELECT conv_id, turn, lower({O.strip('msg')}) AS t FROM m),
k AS (SELECT *, CASE WHEN {_found(CM.REJECT)} THEN 1 WHEN {_found(CM.APPROVE)} THEN 2 WHEN {_found(_E1)} THEN 3 WHEN {_found(_E2)} THEN 4
      WHEN {_IS_BATCH} THEN 5 END AS kind FROM l)
SELECT conv_id, turn, CASE kind WHEN 1 THEN 'REJECT' WHEN 2 THEN 'APPROVE' WHEN 5 THEN 'BATCH_EDIT' ELSE 'EDIT' END AS action,
 TRY_CAST(CASE kind WHEN 1 THEN {_extract(CM.REJECT, 1)} WHEN 2 THEN {_extract(CM.APPROVE, 1)} WHEN 3 THEN {_extract(_E1, 1)} WHEN 4 THEN {_extract(_E2, 1)} END AS BIGINT) AS row_id,
 nullif(CASE kind WHEN 3 THEN {_extract(_E1, 2)} WHEN 4 THEN {_extract(_E2, 2)} WHEN 5 THEN coalesce(nullif({O.strip(_extract(CM.BATCH_COLUMN, 1))}, ''), {_LISTED}) END, '') AS col,
 CASE kind WHEN 3 THEN {_million(O.strip(_extract(_E1, 3)))} WHEN 4 THEN {_million(O.strip(_extract(_E2, 3)))} WHEN 5 THEN {_million(_BATCH_VALUE)} END AS new_value
FROM k WHERE kind IS NOT NULL""")
def re4(spark, d):
    return CM.extract_edit_commands(_messages(spark, d), "msg").select(
        "conv_id", "turn", "action", "row_id", F.col("column").alias("col"), "new_value")


@query("re5_change_set", O.decided("dq_orders") + """, old AS (SELECT * FROM cells)
SELECT dec.row_id, dec.col, old.val AS old_value, new_value FROM dec JOIN old ON old.row_id = dec.row_id AND old.col = dec.col
WHERE decision = 'AUTO' AND coalesce(new_value, '') <> '' AND old.val IS DISTINCT FROM new_value""")
def re5(spark, d):
    a = analysis(spark, d, "dq_orders")
    return RE.change_set(a.table, RE.auto_edits(a.decisions), a.columns).withColumnRenamed("column", "col")


# --- reviews ----------------------------------------------------------------

# Every escalated decision gets two submissions. Those of odd rows are edits
# without a value, which do not count.
_REV = """rev AS (SELECT row_id, col, r, CASE WHEN row_id % 2 = 1 THEN 'EDIT' WHEN (row_id + r) % 3 = 0 THEN 'APPROVE'
  WHEN (row_id + r) % 3 = 1 THEN 'REJECT' ELSE 'EDIT' END AS action,
  CASE WHEN row_id % 2 = 0 AND (row_id + r) % 3 = 2 AND row_id % 4 = 0 THEN 'v' END AS edited_value
  FROM dec, (VALUES (1), (2)) x(r) WHERE decision = 'ESCALATE'),
val AS (SELECT * FROM rev WHERE action <> 'EDIT' OR edited_value IS NOT NULL),
last AS (SELECT row_id, col, max(r) AS r, arg_max(action, r) AS action FROM val GROUP BY 1, 2)"""


def _submissions(decisions):
    k = F.when(F.col("row_id") % 2 == 0, (F.col("row_id") + F.col("r")) % 3).otherwise(3)
    return decisions.where("decision = 'ESCALATE'").select(
        "decision_id", "row_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("r")
    ).select(
        "decision_id", F.when(k == 0, "APPROVE").when(k == 1, "REJECT").otherwise("EDIT").alias("action"),
        F.when((k == 2) & (F.col("row_id") % 4 == 0), "v").alias("edited_value"),
        F.lit("").alias("comment"), F.lit("reviewer").alias("reviewer"), F.lit(1.0).alias("confidence"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("r")).alias("ts"))


def _queue(spark, d, status=None):
    decisions = analysis(spark, d, "dq_customer").decisions
    return RV.review_queue(decisions, RV.submit(_submissions(decisions)), status)


@query("rv1_review_queue", O.decided("dq_customer") + f""", {_REV}
SELECT dec.row_id, dec.col, last.action IS NOT NULL AS reviewed, last.action AS review_action FROM dec LEFT JOIN last USING (row_id, col) WHERE decision = 'ESCALATE'""")
def rv1(spark, d):
    return _queue(spark, d).select("row_id", F.col("column").alias("col"), "reviewed", "review_action")


@query("rv1_pending", O.decided("dq_customer") + f""", {_REV}
SELECT dec.row_id, dec.col FROM dec LEFT JOIN last USING (row_id, col) WHERE decision = 'ESCALATE' AND last.action IS NULL""")
def rv1b(spark, d):
    return _queue(spark, d, "pending").select("row_id", F.col("column").alias("col"))


@query("rv1_queue_counts", O.decided("dq_customer") + f""", {_REV}
SELECT count(*) AS total, count_if(last.action IS NULL) AS pending, count_if(last.action IS NOT NULL) AS reviewed
FROM dec LEFT JOIN last USING (row_id, col) WHERE decision = 'ESCALATE'""")
def rv1c(spark, d):
    return RV.queue_counts(_queue(spark, d))


@query("rv2_latest_review", O.decided("dq_customer") + f""", {_REV}
SELECT row_id, col, action, r AS submission FROM last""")
def rv2(spark, d):
    decisions = analysis(spark, d, "dq_customer").decisions
    last = RV.latest_reviews(RV.submit(_submissions(decisions)))
    return last.join(decisions.select("decision_id", "row_id", "column"), "decision_id").select(
        "row_id", F.col("column").alias("col"), "action",
        (F.unix_seconds("ts") - 1704067200).alias("submission"))


# --- ledger -----------------------------------------------------------------

# Events of the stream table as ledger rows.
_LEDGER = """led AS (SELECT CAST(event_id AS VARCHAR) AS id, upper(event_type) AS event_type,
 concat('user:', CAST(user_id AS VARCHAR)) AS actor, concat('ds', CAST(user_id % 10 AS VARCHAR)) AS dataset_id, ts FROM events)"""


def _event_ledger(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.upper("event_type").alias("event_type"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor"),
        F.concat(F.lit("ds"), (F.col("user_id") % 10).cast("string")).alias("dataset_id"),
        F.lit(None).cast("string").alias("decision_id"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("details"),
        F.col("ts"))


@query("au1_ledger_append", O.decided("dq_customer") + " SELECT decision AS event_type, count(*) AS n FROM dec GROUP BY 1")
def au1(spark, d):
    path = scratch(spark, "ledger")
    L.append_events(L.decision_events(analysis(spark, d, "dq_customer").decisions, _ts()), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("au1_repair_events", O.decided("dq_orders") + """
SELECT 'AUTO_REPAIR' AS event_type, 'system_autonomy_gate' AS actor, CAST(dec.row_id AS VARCHAR) AS row_id, dec.col, cells.val AS old_value, new_value
FROM dec JOIN cells ON cells.row_id = dec.row_id AND cells.col = dec.col
WHERE decision = 'AUTO' AND coalesce(new_value, '') <> '' AND cells.val IS DISTINCT FROM new_value""")
def au1b(spark, d):
    a, path = analysis(spark, d, "dq_orders"), scratch(spark, "ledger")
    changes = RE.change_set(a.table, RE.auto_edits(a.decisions), a.columns)
    L.append_events(L.repair_events(changes, "dq_orders", _ts()), path)
    at = lambda key: F.try_element_at("details", F.lit(key))
    return spark.read.parquet(path).select(
        "event_type", "actor", at("row_id").alias("row_id"), at("column").alias("col"),
        at("old_value").alias("old_value"), at("new_value").alias("new_value"))


@query("au1_review_events", O.decided("dq_customer") + f""", {_REV}
SELECT 'REVIEW' AS event_type, 'user:reviewer' AS actor, row_id, col, action, '' AS comment, r AS submission FROM val""")
def au1c(spark, d):
    decisions, path = analysis(spark, d, "dq_customer").decisions, scratch(spark, "ledger")
    L.append_events(L.review_events(RV.submit(_submissions(decisions))), path)
    at = lambda key: F.try_element_at("details", F.lit(key))
    return spark.read.parquet(path).join(decisions.select("decision_id", "row_id", "column"), "decision_id").select(
        "event_type", "actor", "row_id", F.col("column").alias("col"), at("action").alias("action"),
        at("comment").alias("comment"), (F.unix_seconds("ts") - 1704067200).alias("submission"))


@query("au2_ledger_query", f"WITH {_LEDGER} SELECT id, event_type, actor FROM led WHERE dataset_id = 'ds3' AND event_type = 'CLICK' ORDER BY ts DESC, id LIMIT 100 OFFSET 20")
def au2(spark, d):
    return L.query_events(_event_ledger(spark, d), "ds3", "CLICK", limit=100, offset=20).select("id", "event_type", "actor")


@query("au3_timeline", f"WITH {_LEDGER} SELECT id, row_number() OVER (ORDER BY ts, id) AS place FROM led WHERE dataset_id = 'ds7'")
def au3(spark, d):
    return L.numbered_timeline(_event_ledger(spark, d), "ds7", scratch(spark, "timeline")).select("id", "place")


@query("au3_count", f"WITH {_LEDGER} SELECT count(*) AS events FROM led WHERE dataset_id = 'ds1'")
def au3b(spark, d):
    return L.count_events(_event_ledger(spark, d), "ds1")


@query("au3_get_event", f"WITH {_LEDGER} SELECT id, event_type, actor, dataset_id FROM led WHERE id = '42'")
def au3c(spark, d):
    return L.get_event(_event_ledger(spark, d), "42").select("id", "event_type", "actor", "dataset_id")


@query("au4_capped_events", f"""WITH a AS ({O.decided('dq_orders')} SELECT 'dq_orders' AS dataset_id, row_id, col, decision FROM dec),
b AS ({O.decided('dq_customer')} SELECT 'dq_customer' AS dataset_id, row_id, col, decision FROM dec),
u AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id, col) AS rk FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT dataset_id, decision AS event_type, CAST(row_id AS VARCHAR) AS row_id, col, CAST(NULL AS VARCHAR) AS total FROM u WHERE rk <= 1000
UNION ALL SELECT dataset_id, 'BATCH_DECISIONS', NULL, NULL, CAST(count(*) AS VARCHAR) FROM u GROUP BY 1 HAVING count(*) > 1000""")
def au4(spark, d):
    at = F.col("details")
    return L.capped_decision_events(all_decisions(spark, d), _ts()).select(
        "dataset_id", "event_type", F.try_element_at(at, F.lit("row_id")).alias("row_id"),
        F.try_element_at(at, F.lit("column")).alias("col"), F.try_element_at(at, F.lit("total_decisions")).alias("total"))


@query("au5_hash_batches", f"""WITH {_LEDGER}, l AS (SELECT sha256(id) AS hid, led.*, json_extract_string(props, '$.k') AS k
  FROM led JOIN events ON led.id = CAST(event_id AS VARCHAR)),
leaf AS (SELECT CAST(('0x' || substr(hid, 1, 8)) AS BIGINT) % (SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM events) AS block,
  sha256(CAST(json_object('id', hid, 'event_type', event_type, 'actor', actor, 'dataset_id', dataset_id, 'decision_id', NULL,
    'details', json_array(json_object('key', 'k', 'value', k)), 'ts', strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS VARCHAR)) AS leaf FROM l),
roots AS (SELECT block, count(*) AS events, sha256(string_agg(leaf, '' ORDER BY leaf)) AS block_root FROM leaf GROUP BY 1)
SELECT sum(events) AS events, sha256('genesis' || string_agg(block_root, '' ORDER BY block)) AS batch_root FROM roots""")
def au5(spark, d):
    ledger = _event_ledger(spark, d).withColumn("id", F.sha2("id", 256))
    blocks = L.block_count(ledger)
    return L.batch_root(L.block_roots(ledger, blocks), blocks, "genesis")


@query("au5b_altered_events", """SELECT sha256(CAST(event_id AS VARCHAR)) AS id, CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)
  % (SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM events) AS block, 'changed' AS change FROM events WHERE event_id % 5003 = 11
UNION ALL SELECT sha256(CAST(event_id AS VARCHAR)), CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)
  % (SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM events), 'lost' FROM events WHERE event_id % 5003 = 12""")
def au5b(spark, d):
    """Against the stored tree: some events were given another actor, some removed."""
    events = _event_ledger(spark, d)
    ledger = events.withColumn("id", F.sha2("id", 256))
    blocks, path = L.block_count(ledger), scratch(spark, "tree")
    L.hash_tree(ledger, blocks).write.parquet(path)
    number = F.col("id").cast("long") % 5003
    now = events.where(number != 12).withColumn("actor", F.when(number == 11, "someone").otherwise(F.col("actor")))
    return L.altered_events(spark.read.parquet(path), now.withColumn("id", F.sha2("id", 256)), blocks)


@query("au1b_repeated_append", f"""WITH {_LEDGER} SELECT event_type, count(*) AS events FROM led GROUP BY 1""")
def au1b(spark, d):
    """The same batch appended twice counts once."""
    path, events = scratch(spark, "ledger"), _event_ledger(spark, d)
    for _ in range(2):
        L.append_events(events, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("events"))


# --- catalog ----------------------------------------------------------------

@query("io7_catalog", O.decided("dq_orders") + """ SELECT 'dq_orders' AS dataset_id, count(*) AS stored_decisions, count_if(decision = 'AUTO') AS auto_count FROM dec""")
def io7(spark, d):
    """Two datasets are registered and one is deleted again."""
    catalog = Catalog(spark, scratch(spark, "catalog"))
    for view in ("dq_orders", "dq_customer"):
        a = analysis(spark, d, view)
        catalog.register(view, D.summarize, a.decisions, TS)
    catalog.delete("dq_customer", "2024-01-02 00:00:00")
    stored = catalog.decisions("dq_orders").groupBy("dataset_id").agg(F.count("*").alias("stored_decisions"))
    return catalog.datasets().join(stored, "dataset_id").select("dataset_id", "stored_decisions", "auto_count")


@query("io7b_catalog_versions", """SELECT 1 AS version, count(*) AS n_rows FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 2, count(*) FROM customer""")
def io7b(spark, d):
    """A table is registered twice; both versions can be loaded again."""
    catalog, customers = Catalog(spark, scratch(spark, "catalog")), table(spark, d, "customer")
    for part in (customers.where("c_custkey % 2 = 0"), customers):
        catalog.register("customer", part.agg(F.count("*").alias("n_rows")), part.select("c_custkey"), TS, table=part)
    return catalog.reload("customer", 1).agg(F.lit(1).alias("version"), F.count("*").alias("n_rows")).unionByName(
        catalog.reload("customer").agg(F.lit(2).alias("version"), F.count("*").alias("n_rows")))


# --- streaming --------------------------------------------------------------

# Rows in a file of a stream's input: files grow in number with the table, not in size.
FILE_ROWS = 250_000


def _quarters(events, folder, late_rows=False):
    """Writes events in four batches by time, in files of bounded size; the files of one batch.

    ``late_rows``: every 17th event comes a batch later, every 23rd comes once more in the last one.
    """
    t = F.col("ts").cast("timestamp").cast("double")
    lo, hi, n = events.agg(F.min(t), F.max(t), F.count("*")).first()
    part = F.coalesce(F.least(F.floor((t - F.lit(lo)) * 4 / F.lit(hi - lo or 1.0)), F.lit(3)), F.lit(0)).cast("int")
    rows = events.withColumn("_part", part)
    if late_rows:
        again = events.where("event_id % 23 = 0").withColumn("_part", F.lit(3))
        later = F.when(F.col("event_id") % 17 == 0, F.least(F.col("_part") + 1, F.lit(3))).otherwise(F.col("_part"))
        rows = rows.withColumn("_part", later).unionByName(again)
    files = max(1, -(-n // (4 * FILE_ROWS)))
    for i in range(4):  # one after the other, since a stream takes files by their times
        rows.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(folder)
    return files


def _event_stream(spark, d, late_rows=False):
    """All events as a stream of four batches in event order."""
    events, folder = table(spark, d, "events"), scratch(spark, "events")
    files = _quarters(events, folder, late_rows)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


_OUT = """WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_pop(value) AS sd FROM events) """
_OUTSIDE = "(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"


@query("st1_stream_detection", _OUT + f"""SELECT event_id AS row_id, 'ESCALATE' AS decision, round(least(1.0, abs(value - mean) / sd / 6), 4) AS belief_error
FROM events, s WHERE {_OUTSIDE} OR abs(value - mean) / sd > 3""")
def st1(spark, d):
    baseline = fit(with_row_id(table(spark, d, "events"), "event_id"), ["value"])
    out, checkpoint = scratch(spark, "decisions"), scratch(spark, "checkpoint")
    ST.run_detection(with_row_id(_event_stream(spark, d), "event_id"), baseline, "events", out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("row_id", "decision", "belief_error")


def _collect_stream(spark, stream, mode, keys=None):
    """Run a stream over the files at hand and read what it wrote; of updates the last row per key."""
    out, checkpoint = scratch(spark, "out"), scratch(spark, "checkpoint")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(out)
    if keys:
        names = [c for c in rows.columns if c != "batch"]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("last")).select("last.*")
    return rows.drop("batch")


@query("st2_stream_duplicate_keys", """SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01') AS window_start, user_id, count(*) AS copies
FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def st2(spark, d):
    events = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ST.stream_key_counts(events, "user_id", "ts", "1 day", "1 day")
    return _collect_stream(spark, counts, "update", ["window_start", "user_id"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("st2_stream_distinct", "SELECT event_id FROM events")
def st2b(spark, d):
    events = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _collect_stream(spark, ST.stream_distinct(events, ["event_id"], "ts", "1 hour"), "append").select("event_id")


@query("st3_window_quality", _OUT + f"""SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS window_start, count(*) AS n_rows,
 round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_rate, round(avg(CASE WHEN {_OUTSIDE} THEN 1.0 ELSE 0.0 END), 4) AS outlier_rate
FROM events, s GROUP BY 1""")
def st3(spark, d):
    baseline = fit(with_row_id(table(spark, d, "events"), "event_id"), ["value"])
    events = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    metrics = ST.quality_metrics(events, baseline, "value", "ts", "1 hour", "1 hour")
    return _collect_stream(spark, metrics, "update", ["window_start"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# The same arrival in SQL: batches, and each one's watermark an hour behind all earlier ones.
_ARRIVALS = """WITH b AS (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events),
p AS (SELECT events.*, CAST(least(floor((epoch(ts) - lo) * 4 / (hi - lo)), 3) AS INTEGER) AS part FROM events, b),
a AS (SELECT event_id, ts, value, CASE WHEN event_id % 17 = 0 THEN least(part + 1, 3) ELSE part END AS batch FROM p
      UNION ALL SELECT event_id, ts, value, 3 FROM p WHERE event_id % 23 = 0),
w AS (SELECT x.batch, max(y.ts) - INTERVAL '1 hour' AS mark FROM (SELECT DISTINCT batch FROM a) x LEFT JOIN a y ON y.batch < x.batch GROUP BY 1),
r AS (SELECT a.*, coalesce(ts < mark, false) AS late FROM a JOIN w USING (batch))
"""


def _late_stream(spark, d):
    return _event_stream(spark, d, late_rows=True).withColumn("ts", F.col("ts").cast("timestamp"))


def _run_distinct(spark, d):
    out = scratch(spark, "distinct")
    LT.run_distinct(_late_stream(spark, d), ["event_id"], "ts", "1 hour", out, scratch(spark, "checkpoint")).awaitTermination()
    return out


@query("st2c_stream_distinct_late", _ARRIVALS + """SELECT event_id, count(*) FILTER (WHERE late) AS late_copies, bool_or(NOT late) AS in_time
FROM r GROUP BY 1""")
def st2c(spark, d):
    """Every event is among the first arrivals or in the late sink, though files are out of order and events repeat."""
    out = _run_distinct(spark, d)
    late = LT.late_rows(spark, out).groupBy("event_id").agg(F.count("*").alias("late_copies"))
    first = spark.read.parquet(f"{out}/rows").select("event_id", F.lit(True).alias("in_time"))
    return first.join(late, "event_id", "full").select(
        "event_id", F.coalesce("late_copies", F.lit(0)).alias("late_copies"), F.coalesce("in_time", F.lit(False)).alias("in_time"))


@query("st2d_stream_late_count", _ARRIVALS + "SELECT batch, count(*) AS late FROM r WHERE late GROUP BY 1")
def st2d(spark, d):
    return LT.late_rows(spark, _run_distinct(spark, d)).groupBy(F.col("batch").cast("int").alias("batch")).agg(F.count("*").alias("late"))


def _run_windows(spark, d):
    baseline = fit(with_row_id(table(spark, d, "events"), "event_id"), ["value"])
    out = scratch(spark, "windows")
    ST.run_quality_log(_late_stream(spark, d), baseline, "value", "ts", "1 hour", "1 hour", out, scratch(spark, "checkpoint")).awaitTermination()
    return out


@query("st3b_corrected_windows", _ARRIVALS + ", s AS (" + _OUT.split("AS (", 1)[1].rstrip() + f""" SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS window_start,
 count(*) AS n_rows, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_rate,
 round(avg(CASE WHEN {_OUTSIDE} THEN 1.0 ELSE 0.0 END), 4) AS outlier_rate, max(batch)::BIGINT AS version FROM r, s GROUP BY 1""")
def st3b(spark, d):
    """Late rows change the published figures of closed windows."""
    return ST.quality_as_of(spark, _run_windows(spark, d)).drop("corrections").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


@query("st3c_window_corrections", _ARRIVALS + """SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS window_start, batch::BIGINT AS version,
 count(*)::BIGINT AS added FROM r JOIN w USING (batch)
WHERE time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') + INTERVAL '1 hour' <= w.mark GROUP BY 1, 2""")
def st3c(spark, d):
    """The corrections themselves: rows added to windows that the watermark had passed."""
    found = LT.changes(spark, _run_windows(spark, d), ["n_rows"]).where("closed")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "version",
                        (F.col("n_rows") - F.col("replaced_n_rows")).cast("long").alias("added"))
