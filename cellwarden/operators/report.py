"""Reports over decisions, datasets and verification cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleanliness(decisions: Column, rows: Column, columns: Column) -> Column:
    """Share of cells without a decision, in percent with one decimal."""
    cells = F.greatest(rows * columns, F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round((1.0 - decisions / cells) * 100.0, 1)))


def status_color(total: Column, escalated: Column) -> Column:
    return F.when((total > 0) & (escalated > 0), "amber").otherwise("emerald")


def report(summary: DataFrame, datasets: DataFrame, semantics: DataFrame) -> DataFrame:
    """One briefing row per dataset.

    ``datasets``: dataset_id, n_rows, n_columns. Datasets without decisions
    appear with zeros.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = datasets.join(summary, "dataset_id", "left").join(semantics, "dataset_id", "left")
    total, escalated = zero("total_decisions"), zero("escalate_count")
    return joined.select(
        "dataset_id", "domain_id", "primary_key_column", "temporal_column",
        F.array_join("sensitive_columns", ",").alias("sensitive_columns"),
        "n_rows", "n_columns",
        total.alias("total_decisions"), zero("auto_count").alias("auto_count"),
        escalated.alias("escalate_count"), zero("block_count").alias("block_count"),
        cleanliness(total, F.col("n_rows"), F.col("n_columns")).alias("cleanliness_score"),
        status_color(total, escalated).alias("status_color"),
    )


def stats(decisions: DataFrame) -> DataFrame:
    """Totals over all datasets."""
    is_ = lambda d: F.count_if(F.col("decision") == d)
    return decisions.agg(
        F.count_distinct("dataset_id").alias("datasets_count"),
        F.count("*").alias("total_decisions"),
        is_("AUTO").alias("auto_count"), is_("ESCALATE").alias("escalate_count"),
        F.round(F.coalesce(F.try_divide(is_("AUTO"), F.count("*")), F.lit(0.0)), 4).alias("automation_rate"),
    )


def verify_cases(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per case whether one of the accepted outcomes occurs in its dataset.

    ``cases``: case_id, dataset_id, accepted (comma list of decisions).
    """
    outcomes = decisions.groupBy("dataset_id").agg(
        F.array_sort(F.collect_set("decision")).alias("actual"))
    accepted = F.split("accepted", ",")
    return cases.join(outcomes, "dataset_id", "left").select(
        "case_id", "dataset_id", "accepted",
        F.coalesce(F.array_join("actual", ","), F.lit("")).alias("actual"),
        F.coalesce(F.arrays_overlap("actual", accepted), F.lit(False)).alias("passed"),
    )


def verify_summary(results: DataFrame, needed: int = 4) -> DataFrame:
    return results.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"),
        (F.count_if("passed") >= needed).alias("overall_pass"))


def filter_decisions(decisions: DataFrame, decision: str | None = None) -> DataFrame:
    return decisions if decision in (None, "ALL") else decisions.where(F.col("decision") == decision)


def detection_quality(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the decided cells against true error cells.

    Both hold (row_id, column); a full join lines them up.
    """
    a = decided.select("row_id", "column").distinct().withColumn("found", F.lit(True))
    b = truth.select("row_id", "column").distinct().withColumn("wrong", F.lit(True))
    both = a.join(b, ["row_id", "column"], "full")
    hit = F.count_if(F.col("found") & F.col("wrong"))
    total = both.agg(
        hit.alias("true_positives"),
        F.count_if(F.col("found") & F.col("wrong").isNull()).alias("false_positives"),
        F.count_if(F.col("wrong") & F.col("found").isNull()).alias("false_negatives"),
    )
    tp = F.col("true_positives")
    return total.select(
        "*",
        F.round(F.try_divide(tp, tp + F.col("false_positives")), 4).alias("precision"),
        F.round(F.try_divide(tp, tp + F.col("false_negatives")), 4).alias("recall"),
        F.round(F.try_divide(2 * tp, 2 * tp + F.col("false_positives") + F.col("false_negatives")), 4).alias("f1"),
    )
