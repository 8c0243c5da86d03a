"""Column profiles: types, semantics, statistics, shapes and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.functions import text as X
from cellwarden.operators.cells import is_numeric, is_string, observed_type, text_of, unpivot
from cellwarden.operators.relate import shape_counts, with_shapes
from cellwarden.operators.stats import distinct_counts, exact_quantiles, wide_aggregate


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}



def name_hint(name: str) -> str | None:
    low = name.lower().strip()
    return next((kind for word, kind in C.SEMANTIC_NAME_HINTS if word in low), None)


def string_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per string column: share of non-null values that match each pattern."""
    return wide_aggregate(df, columns, lambda c: {
        "n_values": F.count(c),
        **{k: F.coalesce(F.count_if(X.matches(c, k)) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0))
           for k in C.SEMANTIC_PATTERNS},
    })


def semantic_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Semantic type and confidence per column.

    A name hint settles it; otherwise the pattern most string values match,
    from one half on, the earlier pattern on a tie.
    """
    types = _types(df)
    strings = [c for c in columns if is_string(types[c])]
    hints = df.sparkSession.createDataFrame(
        [(i, c, name_hint(c)) for i, c in enumerate(columns)], "position int, column string, hint string")
    if strings:
        # The highest rate, then the earlier pattern.
        best = F.array_max(F.array_compact(F.array(*[
            F.when(F.col(k) >= C.SEMANTIC_MIN_RATE,
                   F.struct(F.col(k).alias("rate"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")))
            for i, k in enumerate(C.SEMANTIC_PATTERNS)])))
        found = string_rates(df, strings).select("column", best.alias("best"))
        hints = hints.join(F.broadcast(found), "column", "left")
    else:
        hints = hints.withColumn("best", F.lit(None).cast("struct<rate:double,rank:int,kind:string>"))
    named = F.col("hint").isNotNull()
    return hints.select(
        "column", "position",
        F.coalesce("hint", "best.kind").alias("semantic_type"),
        F.when(named, C.NAME_HINT_CONFIDENCE).otherwise(F.coalesce("best.rate", F.lit(0.0))).alias("semantic_confidence"),
    )


def pii_likelihood(df: DataFrame, columns: list[str]) -> DataFrame:
    """Likelihood of personal data from the name and the matched patterns."""
    types = _types(df)
    strings = [c for c in columns if is_string(types[c])]
    base = df.sparkSession.createDataFrame(
        [(c, C.PII_NAME_LIKELIHOOD if X.name_has(c, C.PII_NAME_KEYWORDS) else 0.0) for c in columns],
        "column string, by_name double")
    by_value = F.lit(0.0)
    if strings:
        base = base.join(F.broadcast(string_rates(df, strings)), "column", "left")
        by_value = F.greatest(*[
            F.when(F.col(k) >= C.PII_MIN_RATE, 0.5 + 0.5 * F.col(k)).otherwise(0.0)
            for k in C.PII_PATTERN_NAMES])
    return base.select("column", F.round(F.least(F.lit(1.0), F.greatest("by_name", by_value)), 4).alias("pii_likelihood"))


def numeric_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, moments, range and exact quartiles per numeric column."""
    v = lambda c: F.col(c).cast("double")
    base = wide_aggregate(df, columns, lambda c: {
        "null_count": F.count_if(F.col(c).isNull()), "total_count": F.count(F.lit(1)),
        "mean": F.avg(v(c)), "std": F.stddev_samp(v(c)), "min": F.min(v(c)), "max": F.max(v(c)),
    })
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75)).groupBy("column").agg(
        at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
    return base.join(F.broadcast(quartiles), "column", "left")


def string_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shortest, longest and mean length per string column."""
    return wide_aggregate(df, columns, lambda c: {
        "null_count": F.count_if(F.col(c).isNull()), "total_count": F.count(F.lit(1)),
        "min_length": F.min(F.length(c)), "max_length": F.max(F.length(c)),
        "mean_length": F.avg(F.length(c)),
    })


def pattern_distribution(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """The most frequent shapes per string column with their share.

    Counts first, long shapes by their digest; the rank then prunes to
    ``top`` rows per column in every task before the shuffle, and the shapes
    of the digests left are looked up.
    """
    counts = shape_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n_shape").alias("n"))
    rank = F.row_number().over(
        Window.partitionBy("column").orderBy(F.col("n_shape").desc(), "shape_key"))
    first = (
        counts.withColumn("rank", rank).where(F.col("rank") <= top)
        .join(F.broadcast(totals), "column")  # one row per column
        .select("column", "rank", "shape_key", F.round(F.col("n_shape") / F.col("n"), 4).alias("share"))
    )
    return with_shapes(first, df, columns).select("column", "rank", "shape", "share")


def missing_and_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing rate (with disguised nulls), cardinality and unique rate."""
    types = _types(df)

    def measures(c):
        disguised = (F.count_if(X.is_null_token(c, C.PROFILE_NULL_TOKENS))
                     if is_string(types[c]) else F.count_if(F.lit(False)))
        return {"n_rows": F.count(F.lit(1)), "n_values": F.count(c), "disguised": disguised}

    joined = wide_aggregate(df, columns, measures).join(
        F.broadcast(distinct_counts(df, columns)), "column", "left")
    n = F.nullif(F.col("n_rows"), F.lit(0))
    nulls = F.col("n_rows") - F.col("n_values")
    cardinality = F.coalesce("n_distinct", F.lit(0)) + (nulls > 0).cast("bigint")
    return joined.select(
        "column",
        F.coalesce(F.round((nulls + F.col("disguised")) / n, 4), F.lit(0.0)).alias("missing_rate"),
        cardinality.alias("cardinality"),
        F.coalesce(F.round(cardinality / n, 4), F.lit(0.0)).alias("unique_rate"),
    )


def examples(df: DataFrame, columns: list[str], size: int = 5) -> DataFrame:
    """A repeatable choice of non-null example values per column.

    Cells are ranked without their values, by the digest of the row id and
    pruned in every task; the values of the chosen ones are fetched after.
    """
    types = _types(df)
    filled = unpivot(df, columns, lambda c: F.col(c).isNotNull(), keep=["row_id"]).where("value")
    rank = F.row_number().over(
        Window.partitionBy("column").orderBy(F.md5(F.col("row_id").cast("string")), "row_id"))
    chosen = filled.select("column", "row_id").withColumn("rank", rank).where(F.col("rank") <= size)
    value = F.lit(None).cast("string")
    for c in columns:
        value = F.when(F.col("column") == c, text_of(c, types[c])).otherwise(value)
    # Broadcast: ``size`` rows per column.
    rows = df.select("row_id", *columns).join(F.broadcast(chosen), "row_id").select("column", "rank", value.alias("value"))
    return rows.groupBy("column").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]).alias("examples"))


def date_likelihood() -> Column:
    return (
        F.when(F.coalesce(F.col("semantic_type"), F.lit("")).contains("date"), F.round("semantic_confidence", 4))
        .when(F.col("observed_type") == "datetime", 1.0).otherwise(0.0)
    )


def profile(df: DataFrame, columns: list[str], dataset_id: str = "") -> DataFrame:
    """One profile row per column of a table that carries ``row_id``."""
    types = _types(df)
    numeric = [c for c in columns if is_numeric(types[c])]
    strings = [c for c in columns if is_string(types[c])]
    kinds = df.sparkSession.createDataFrame(
        [(c, observed_type(types[c])) for c in columns], "column string, observed_type string")
    out = semantic_types(df, columns)
    parts = [kinds, missing_and_unique(df, columns), pii_likelihood(df, columns), examples(df, columns)]
    if strings:
        shapes = pattern_distribution(df, strings).groupBy("column").agg(
            F.map_from_entries(F.collect_list(F.struct("shape", "share"))).alias("pattern_distribution"))
        parts += [shapes, string_statistics(df, strings).drop("null_count", "total_count")]
    if numeric:
        parts.append(numeric_statistics(df, numeric).drop("null_count", "total_count"))
    for p in parts:  # one row per column each
        out = out.join(F.broadcast(p), "column", "left")
    return out.withColumn("date_likelihood", date_likelihood()).withColumn(
        "dataset_id", F.lit(dataset_id))


# --- table semantics over a catalog of columns ------------------------------

def table_semantics(catalog: DataFrame) -> DataFrame:
    """Domain, key, time and sensitive columns of every dataset in a catalog.

    ``catalog`` has one row per (dataset_id, column, position); a dataset's
    rows are bounded by its number of columns.
    """
    columns = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda e: e["column"])
    tables = catalog.groupBy("dataset_id").agg(columns.alias("columns"))
    joined = F.lower(F.array_join("columns", " "))
    scores = [sum((joined.contains(k).cast("int") for k in words[1:]), joined.contains(words[0]).cast("int"))
              for _, _, _, words in C.DOMAINS]
    best = F.greatest(*scores)

    def pick(i):
        value = F.lit(C.GENERAL_DOMAIN[i])
        for score, domain in reversed(list(zip(scores, C.DOMAINS))):
            value = F.when((score == best) & (best > 0), F.lit(domain[i])).otherwise(value)
        return value

    def has(c, words):
        low, hit = F.lower(c), F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return hit

    first = lambda test: F.coalesce(F.try_element_at(F.filter("columns", test), F.lit(1)), F.lit(C.NOT_FOUND))
    return tables.select(
        "dataset_id",
        pick(0).alias("domain_id"), pick(1).alias("domain_name"), pick(2).alias("entity_concept"),
        F.when(best > 0, best).otherwise(0).alias("domain_hits"),
        first(lambda c: F.lower(c).endswith("_id") | F.lower(c).isin(*C.PRIMARY_KEY_NAMES)).alias("primary_key_column"),
        first(lambda c: has(c, C.TIME_NAME_KEYWORDS)).alias("temporal_column"),
        F.filter("columns", lambda c: has(c, C.SENSITIVE_NAME_KEYWORDS)).alias("sensitive_columns"),
    )
