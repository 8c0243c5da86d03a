"""Sources, scalar expressions and profiles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.functions import dates as DT
from cellwarden.functions import text as X
from cellwarden.operators import profile as P
from cellwarden.operators.cells import data_columns, observed_type
from cellwarden.operators.relate import blocked_pairs, shape_counts, similar_lengths, with_shapes, with_similarity
from cellwarden.plans.views import dirty_view
from cellwarden.sources import files
from workload import oracle as O
from workload.context import scratch, table
from workload.registry import query

PART_COLUMNS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
CSV_ROWS = 100_000  # in a file of the quoted example


@query("io1_csv_scan", f"SELECT {PART_COLUMNS} FROM part")
def io1(spark, d):
    path = scratch(spark, "csv") + "/part.csv"
    table(spark, d, "part").write.option("header", True).csv(path)
    return files.read_csv(spark, path).select(*PART_COLUMNS.split(", "))


def _quoted_csv(spark, d):
    """The documents as CSV files written by string functions: quotes, line breaks, a repeated header name."""
    docs, path = table(spark, d, "documents"), scratch(spark, "quoted") + "/docs.csv"
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.coalesce(quoted("text"), F.lit("")),
                       F.coalesce(quoted("lang"), F.lit("")))

    def with_header(batches):  # one for each file
        yield pa.RecordBatch.from_pydict({"value": ["doc_id,text,text"]})
        for b in batches:  # the same schema as the header's, whether the input can be null or not
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    pieces = max(4, spark.sparkContext.defaultParallelism, -(-docs.count() // CSV_ROWS))
    docs.select(line.alias("value")).repartition(pieces).mapInArrow(with_header, "value string").write.text(path)
    return path


@query("io1_quoted_csv", """SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars, lang FROM documents""")
def io1b(spark, d):
    df = files.read_csv(spark, _quoted_csv(spark, d))
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                     F.length("text").cast("bigint").alias("n_chars"), F.col("text_1").alias("lang"))


@query("io1c_quoted_csv_split", """SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars, lang FROM documents""")
def io1c(spark, d):
    """The same files, each in as many tasks as it has splits."""
    df = files.read_csv(spark, _quoted_csv(spark, d), splittable=True)
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                     F.length("text").cast("bigint").alias("n_chars"), F.col("text_1").alias("lang"))


@query("io5_load_warnings", """SELECT CASE WHEN count(*) > 0 THEN 'Duplicate column names detected' END AS warning,
 count(*) AS n_rows FROM documents HAVING count(*) > 0
UNION ALL SELECT 'Dataset is empty (0 rows)', count(*) FROM documents HAVING count(*) = 0""")
def io5b(spark, d):
    path = _quoted_csv(spark, d)
    df = files.read_csv(spark, path)
    found = files.warnings(df, files.header_names(spark, path, {"sep": ",", "escape": '"', "multiLine": True}))
    return df.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*[F.lit(w) for w in found])).alias("warning"), "n_rows")


@query("io2_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def io2(spark, d):
    return files.read_parquet(spark, f"{d}/lineitem.parquet").where("l_quantity > 45").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("io3_load_metadata",
       "SELECT 'parquet' AS file_format, 1 AS files, count(*) AS row_count, 6 AS column_count FROM orders")
def io3(spark, d):
    path = f"{d}/orders.parquet"
    return files.load_metadata(spark, path, files.read_table(spark, path)).select(
        "file_format", "files", "row_count", "column_count")


@query("io4_fingerprints")
def io4(spark, d):
    return files.fingerprints(spark, d).drop("path")


@query("io5_row_numbers",
       "SELECT count(*) AS n, min(i) AS lo, max(i) AS hi, count(DISTINCT i) AS d "
       "FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem)")
def io5(spark, d):
    ids = files.number_rows(table(spark, d, "lineitem"))
    return ids.agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"),
                   F.count_distinct("row_id").alias("d"))


@query("sc1_shape", f"SELECT doc_id, md5({O.shape('text')}) AS shape_md5 FROM documents")
def sc1(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(X.shape("text").cast("binary")).alias("shape_md5"))


@query("sc2_strip", f"""WITH {O.view_cte('dq_orders')}
SELECT row_id, {O.strip('priority')} AS stripped FROM dq_orders""")
def sc2(spark, d):
    return dirty_view(spark, d, "dq_orders").select("row_id", X.strip("priority").alias("stripped"))


@query("sc3_null_token", f"""WITH {O.view_cte('dq_orders')}
SELECT priority, {O.is_token('priority', C.PROFILE_NULL_TOKENS)} AS profile_token,
       {O.is_token('priority')} AS detector_token, {O.is_token('priority', C.FD_NULL_TOKENS)} AS fd_token,
       count(*) AS n FROM dq_orders GROUP BY ALL""")
def sc3(spark, d):
    sets = {"profile_token": C.PROFILE_NULL_TOKENS, "detector_token": C.DETECTOR_NULL_TOKENS,
            "fd_token": C.FD_NULL_TOKENS}
    flags = [X.is_null_token("priority", t).alias(k) for k, t in sets.items()]
    return dirty_view(spark, d, "dq_orders").groupBy("priority", *flags).agg(F.count("*").alias("n"))


_SEM_SOURCE = """SELECT url AS v FROM pages UNION ALL SELECT contact FROM dq_customer
UNION ALL SELECT ordered_date FROM dq_orders UNION ALL SELECT units FROM dq_orders"""


def _duck_pattern(p: str) -> str:
    return "(?i)" + p.replace("(?i)", "") if "(?i)" in p else p


@query("sc4_semantic_regex", f"""WITH {O.view_cte('dq_orders')}, {O.view_cte('dq_customer')}, s AS ({_SEM_SOURCE})
SELECT {", ".join(f"count_if({O.rlike('v', _duck_pattern(p))}) AS n_{k}" for k, p in C.SEMANTIC_PATTERNS.items())} FROM s""")
def sc4(spark, d):
    orders = dirty_view(spark, d, "dq_orders")
    values = (table(spark, d, "pages").select(F.col("url").alias("v"))
              .union(dirty_view(spark, d, "dq_customer").select("contact"))
              .union(orders.select("ordered_date")).union(orders.select("units")))
    return values.agg(*[F.count_if(X.matches("v", k)).alias(f"n_{k}") for k in C.SEMANTIC_PATTERNS])


@query("sc5_date_format", f"""WITH {O.view_cte('dq_orders')}
SELECT {O.date_label('ordered_date')} AS label, count(*) AS n FROM dq_orders GROUP BY 1""")
def sc5(spark, d):
    return dirty_view(spark, d, "dq_orders").groupBy(
        DT.date_format_label("ordered_date").alias("label")).agg(F.count("*").alias("n"))


@query("sc6_number_text", f"""WITH {O.view_cte('dq_orders')}
SELECT {O.rlike(O.strip('units'), C.INTEGER_PATTERN)} AS is_int,
       {O.rlike(O.strip('units'), C.FLOAT_PATTERN)} AS is_float, count(*) AS n FROM dq_orders GROUP BY 1, 2""")
def sc6(spark, d):
    return dirty_view(spark, d, "dq_orders").groupBy(
        X.is_integer_text("units").alias("is_int"), X.is_float_text("units").alias("is_float")
    ).agg(F.count("*").alias("n"))


@query("sc7_indel_similarity", """WITH RECURSIVE names AS (SELECT DISTINCT lower(p_name) AS v FROM part WHERE p_name IS NOT NULL),
p AS (SELECT x.v AS a, y.v AS b FROM names x JOIN names y ON x.v < y.v
      AND 2.0 * least(length(x.v), length(y.v)) / (length(x.v) + length(y.v)) >= 0.85),
lcs AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM p
        UNION ALL
        SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(
          range(1, j + 1), lambda m: greatest(r[m + 1], r[m] + CASE WHEN b[m] = a[i + 1] THEN 1 ELSE 0 END)))))
        FROM lcs WHERE i < length(a)),
sim AS (SELECT a, b, 2.0 * r[length(b) + 1] / (length(a) + length(b)) AS ratio FROM lcs WHERE i = length(a))
SELECT a, b, round(ratio, 6) AS ratio FROM sim WHERE ratio >= 0.85""")
def sc7(spark, d):
    """Pairs of similar names; they meet on a piece of text that the threshold makes them share."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("v")).where("v IS NOT NULL").distinct()
    one = names.select(F.lit("p_name").alias("column"), F.col("v").alias("value"), F.xxhash64("v").alias("row_id"),
                       F.explode(similar_lengths(F.col("v"))).alias("len")).withColumn("len", F.col("len").cast("int"))
    two = names.select(F.lit("p_name").alias("column"), F.col("v").alias("canonical"), F.length("v").alias("len"))
    pairs = blocked_pairs(one, two).where("value < canonical").select(F.col("value").alias("a"), F.col("canonical").alias("b"))
    longest = names.agg(F.max(F.length("v"))).first()[0] or 0
    return with_similarity(pairs, "a", "b", longest).where(F.col("ratio") >= C.SIMILARITY_MIN).select(
        "a", "b", F.round("ratio", 6).alias("ratio"))


_FIN = " OR ".join(f"contains(lower(event_type), {O.q(k)})" for k in C.FINANCIAL_KEYWORDS)


@query("sc8_keyword_in_name", f"""SELECT event_type, {_FIN} AS financial, count(*) AS n FROM events GROUP BY 1, 2""")
def sc8(spark, d):
    return table(spark, d, "events").groupBy(
        "event_type", X.name_contains("event_type", C.FINANCIAL_KEYWORDS).alias("financial")
    ).agg(F.count("*").alias("n"))


@query("sc9_iso_date", f"""WITH {O.view_cte('dq_orders')}
SELECT row_id, {O.iso_date('ordered_date')} AS iso FROM dq_orders""")
def sc9(spark, d):
    return dirty_view(spark, d, "dq_orders").select("row_id", DT.to_iso_date("ordered_date").alias("iso"))


# --- profiles ---------------------------------------------------------------

def _view(spark, d, name="dq_orders"):
    df = dirty_view(spark, d, name)
    return df, data_columns(df, "row_id")


def _strings(names, view):
    return [c for c in names if O.COLUMNS[view][c] == "s"]


def _numbers(names, view):
    return [c for c in names if O.COLUMNS[view][c] != "s"]



@query("pr1_observed_type", " UNION ALL ".join(
    f"SELECT {O.q(c)} AS col, CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' "
    f"WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' ELSE 'datetime' END AS observed_type, count({c}) AS n_values FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def pr1(spark, d):
    df = table(spark, d, "orders")
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    kinds = {f.name: observed_type(f.dataType) for f in df.schema.fields}
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col"), F.lit(kinds[c]).alias("observed_type"), F.col(c).alias("n_values"))
        for c in df.columns])))


def _name_hint_sql(e: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({e}, {O.q(w)}) THEN {O.q(k)}" for w, k in C.SEMANTIC_NAME_HINTS) + " END"


_ORDER_BY_RATE = "CASE k " + " ".join(f"WHEN {O.q(k)} THEN {i}" for i, k in enumerate(C.SEMANTIC_PATTERNS)) + " END"


def _rates_cte(view: str) -> str:
    rates = " UNION ALL ".join(
        f"SELECT col, {O.q(k)} AS k, avg(CASE WHEN {O.rlike('val', _duck_pattern(p))} THEN 1.0 ELSE 0.0 END) AS rate "
        f"FROM cells WHERE kind = 's' AND val IS NOT NULL GROUP BY col" for k, p in C.SEMANTIC_PATTERNS.items())
    return f"rates AS ({rates})"


@query("pr2_semantic_type", O.cells_cte("dq_customer") + f""", {_rates_cte('dq_customer')},
best AS (SELECT col, first(k ORDER BY rate DESC, {_ORDER_BY_RATE}) AS k, max(rate) AS rate FROM rates WHERE rate >= 0.5 GROUP BY col),
cols AS (SELECT DISTINCT col, {_name_hint_sql('col')} AS hint FROM cells)
SELECT col, coalesce(hint, k) AS semantic_type,
       round(CASE WHEN hint IS NOT NULL THEN 0.7 ELSE coalesce(rate, 0) END, 4) AS semantic_confidence
FROM cols LEFT JOIN best USING (col)""")
def pr2(spark, d):
    df, names = _view(spark, d, "dq_customer")
    return P.semantic_types(df, names).select(
        F.col("column").alias("col"), "semantic_type", F.round("semantic_confidence", 4).alias("semantic_confidence"))


_PII_NAME = " OR ".join(f"contains(col, {O.q(k)})" for k in C.PII_NAME_KEYWORDS)


@query("pr3_pii_likelihood", O.cells_cte("dq_customer") + f""", {_rates_cte('dq_customer')},
byval AS (SELECT col, max(0.5 + 0.5 * rate) AS s FROM rates
          WHERE rate >= 0.3 AND k IN {O.in_list(C.PII_PATTERN_NAMES)} GROUP BY col)
SELECT DISTINCT col, round(least(1.0, greatest(CASE WHEN {_PII_NAME} THEN 0.6 ELSE 0.0 END, coalesce(s, 0))), 4) AS pii_likelihood
FROM cells LEFT JOIN byval USING (col)""")
def pr3(spark, d):
    df, names = _view(spark, d, "dq_customer")
    return P.pii_likelihood(df, names).select(F.col("column").alias("col"), "pii_likelihood")


@query("pr4_numeric_stats", " UNION ALL ".join(
    f"SELECT {O.q(c)} AS col, count(*) - count({c}) AS null_count, count(*) AS total_count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.25), 4) AS q25, "
    f"round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")))
def pr4(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    s = P.numeric_statistics(table(spark, d, "lineitem"), names)
    r4 = [F.round(c, 4).alias(c) for c in ("mean", "std", "median", "q25", "q75")]
    return s.select(F.col("column").alias("col"), "null_count", "total_count", "min", "max", *r4)


@query("pr5_string_stats", " UNION ALL ".join(
    f"SELECT {O.q(c)} AS col, min(length({c})) AS min_length, max(length({c})) AS max_length, "
    f"round(avg(length({c})), 4) AS mean_length FROM documents" for c in ("text", "lang", "source")))
def pr5(spark, d):
    s = P.string_statistics(table(spark, d, "documents"), ["text", "lang", "source"])
    return s.select(F.col("column").alias("col"), "min_length", "max_length",
                    F.round("mean_length", 4).alias("mean_length"))


_PD_COLS = ("priority", "ordered_date", "units", "order_state")


@query("pr6_pattern_distribution", f"""WITH {O.view_cte('dq_orders')}, cells AS ({O.cells('dq_orders', _PD_COLS)}),
c AS (SELECT col, {O.shape('val')} AS sh, count(*) AS n FROM cells WHERE val IS NOT NULL GROUP BY ALL),
r AS (SELECT col, sh, n / sum(n) OVER (PARTITION BY col) AS share,
             row_number() OVER (PARTITION BY col ORDER BY n DESC, sh) AS rk FROM c)
SELECT col, rk AS rank, sh AS shape, round(share, 4) AS share FROM r WHERE rk <= 10""")
def pr6(spark, d):
    df, _ = _view(spark, d)
    return P.pattern_distribution(df, list(_PD_COLS)).withColumnRenamed("column", "col")


def _mu_sql(view: str) -> str:
    return O.cells_cte(view) + f"""
SELECT col, round((count(*) - count(val) + coalesce(sum(CASE WHEN kind = 's' AND {O.is_token('val', C.PROFILE_NULL_TOKENS)} THEN 1 ELSE 0 END), 0)) / count(*), 4) AS missing_rate,
       count(DISTINCT val) + max(CASE WHEN val IS NULL THEN 1 ELSE 0 END) AS cardinality,
       round((count(DISTINCT val) + max(CASE WHEN val IS NULL THEN 1 ELSE 0 END)) / count(*), 4) AS unique_rate
FROM cells GROUP BY col"""


@query("pr7_missing_rate", f"SELECT col, missing_rate FROM ({_mu_sql('dq_orders')})")
def pr7(spark, d):
    df, names = _view(spark, d)
    return P.missing_and_unique(df, names).select(F.col("column").alias("col"), "missing_rate")


@query("pr8_cardinality", f"SELECT col, cardinality, unique_rate FROM ({_mu_sql('dq_customer')})")
def pr8(spark, d):
    df, names = _view(spark, d, "dq_customer")
    return P.missing_and_unique(df, names).select(F.col("column").alias("col"), "cardinality", "unique_rate")


@query("pr9_examples", O.cells_cte("dq_orders") + """, r AS (
  SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS rk FROM cells WHERE val IS NOT NULL)
SELECT col, string_agg(val, '|' ORDER BY rk) AS examples FROM r WHERE rk <= 5 GROUP BY col""")
def pr9(spark, d):
    df, names = _view(spark, d)
    return P.examples(df, names).select(F.col("column").alias("col"), F.array_join("examples", "|").alias("examples"))


@query("pr10_date_likelihood", f"""WITH {O.view_cte('dq_orders')},
c AS (SELECT 'ordered_date' AS col, 0.7 AS date_likelihood, count(ordered_date) AS n FROM dq_orders
      UNION ALL SELECT 'priority', 0.0, count(priority) FROM dq_orders UNION ALL SELECT 'units', 0.0, count(units) FROM dq_orders)
SELECT * FROM c""")
def pr10(spark, d):
    df, _ = _view(spark, d)
    names = ["ordered_date", "priority", "units"]
    kinds = {f.name: observed_type(f.dataType) for f in df.schema.fields}
    sem = P.semantic_types(df, names).withColumn(
        "observed_type", F.create_map(*[F.lit(x) for c in names for x in (c, kinds[c])])[F.col("column")])
    counts = df.agg(*[F.count(c).alias(c) for c in names]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names])))
    return sem.join(F.broadcast(counts), "column").select(
        F.col("column").alias("col"), P.date_likelihood().alias("date_likelihood"), "n")


@query("pr11_table_profile", f"""SELECT a.col, missing_rate, cardinality, unique_rate, q50
FROM ({_mu_sql('dq_orders')}) a LEFT JOIN ({O.cells_cte('dq_orders')}
  SELECT col, round(quantile_cont(num, 0.5), 4) AS q50 FROM cells GROUP BY col) b ON a.col = b.col""")
def pr11(spark, d):
    df, names = _view(spark, d)
    return P.profile(df, names, "dq_orders").select(
        F.col("column").alias("col"), "missing_rate", "cardinality", "unique_rate", F.round("median", 4).alias("q50"))


_DOMAIN_SCORES = ", ".join("(" + " + ".join(f"CAST(contains(j, {O.q(k)}) AS INTEGER)" for k in kw) + f") AS s{i}"
                           for i, (_, _, _, kw) in enumerate(C.DOMAINS))
_DOMAIN_PICK = "CASE " + " ".join(
    f"WHEN s{i} > 0 AND s{i} = greatest({', '.join(f's{x}' for x in range(len(C.DOMAINS)))}) THEN {O.q(dom[0])}"
    for i, dom in enumerate(C.DOMAINS)) + f" ELSE {O.q(C.GENERAL_DOMAIN[0])} END"


@query("pr12_table_semantics", f"""WITH t AS (
  SELECT user_id, string_agg(DISTINCT event_type, ' ') AS j0, min(event_type) AS f FROM events GROUP BY user_id),
j AS (SELECT user_id, lower(array_to_string(list_sort(string_split(j0, ' ')), ' ')) AS j, list_sort(string_split(j0, ' ')) AS l FROM t),
s AS (SELECT user_id, l, {_DOMAIN_SCORES} FROM j)
SELECT CAST(user_id AS VARCHAR) AS dataset_id, {_DOMAIN_PICK} AS domain_id,
 coalesce(list_filter(l, lambda c: ends_with(c, '_id') OR c IN {O.in_list(C.PRIMARY_KEY_NAMES)})[1], {O.q(C.NOT_FOUND)}) AS primary_key_column,
 coalesce(list_filter(l, lambda c: {' OR '.join(f'contains(c, {O.q(k)})' for k in C.TIME_NAME_KEYWORDS)})[1], {O.q(C.NOT_FOUND)}) AS temporal_column
FROM s""")
def pr12(spark, d):
    """Each user's event types stand in for the column names of one table."""
    names = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("dataset_id"), F.col("event_type").alias("column"),
        F.col("event_type").alias("position")).distinct()
    return P.table_semantics(names).select("dataset_id", "domain_id", "primary_key_column", "temporal_column")


@query("pr6b_shapes_of_pages", f"""WITH c AS (SELECT {O.shape('url')} AS sh, count(*) AS n FROM pages GROUP BY 1)
SELECT sh AS shape, n AS n_shape FROM c WHERE sh IS NOT NULL""")
def pr6b(spark, d):
    pages = table(spark, d, "pages").withColumnRenamed("page_id", "row_id")
    return with_shapes(shape_counts(pages, ["url"]), pages, ["url"]).select("shape", "n_shape")


@query("pr6c_shapes_of_documents", f"""WITH c AS (SELECT col, {O.shape('val')} AS sh, count(*) AS n FROM (
  SELECT 'text' AS col, text AS val FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE val IS NOT NULL GROUP BY 1, 2)
SELECT col, md5(sh) AS shape_md5, length(sh) AS shape_length, n AS n_shape FROM c""")
def pr6c(spark, d):
    """Shapes of whole texts, mostly far above the length that is grouped by digest."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "row_id")
    names = ["text", "source"]
    return with_shapes(shape_counts(docs, names), docs, names).select(
        F.col("column").alias("col"), F.md5(F.col("shape").cast("binary")).alias("shape_md5"),
        F.length("shape").alias("shape_length"), "n_shape")
