"""Split-conformal thresholds from reviewed decisions, the input of gate rule 8.

A review says whether a suspicious cell was wrong (APPROVE, EDIT) or not
(REJECT). Per family of detectors and per answer, the threshold is the
quantile of nonconformity that covers a new cell of that family and answer
with probability 1 - alpha. A cell whose prediction set is not exactly one
answer is left to people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwarden.operators.review import latest_reviews, valid_reviews

ALPHA = 0.1


def main_family() -> Column:
    """Family of a cell's strongest finding: errors first, then score, then detector order."""
    ranked = F.transform("items", lambda e: F.struct(
        (e["claim"] == "possible_error").alias("error"), F.round(e["score"], 6).alias("score"),
        (-e["detector_ord"]).alias("ord"), e["family"].alias("family")))
    return F.array_max(ranked)["family"]


def nonconformity(is_error: Column, belief_error: Column) -> Column:
    """How ill an answer suits a cell, to four digits: disbelief for an error, belief for no error."""
    return F.round(F.when(is_error, F.lit(1.0) - belief_error).otherwise(belief_error), 4)


def outcomes(context: DataFrame, reviews: DataFrame) -> DataFrame:
    """(decision_id, row_id, column, family, belief_error, is_error) of every reviewed cell of ``gate_context``.

    The last valid review of a decision counts; reviews of unknown decisions are left out.
    """
    decision_id = F.sha2(F.concat_ws("|", "dataset_id", "row_id", "column"), 256)
    cells = context.select(decision_id.alias("decision_id"), "row_id", "column", main_family().alias("family"),
                           F.round("belief_error", 4).alias("belief_error"))
    last = latest_reviews(valid_reviews(reviews)).select("decision_id", (F.col("action") != "REJECT").alias("is_error"))
    return cells.join(last, "decision_id")


def thresholds(reviewed: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(family, is_error, n, threshold), from (family, belief_error, is_error).

    The threshold is the ceil((n + 1)(1 - alpha))-th smallest nonconformity;
    null, which admits everything, if n is too small for that. Equal scores
    are counted first, so a window holds at most 10,001 rows whatever n is.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    score = nonconformity(F.col("is_error"), F.col("belief_error"))
    counts = reviewed.where("is_error IS NOT NULL AND belief_error IS NOT NULL").groupBy(
        "family", "is_error", score.alias("score")).agg(F.count("*").alias("m"))
    group = Window.partitionBy("family", "is_error")
    upto = F.sum("m").over(group.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9))
    return (counts.withColumns({"upto": upto, "n": F.sum("m").over(group)})
            .groupBy("family", "is_error", "n")
            .agg(F.min(F.when(F.col("upto") >= rank, F.col("score"))).alias("threshold")))


def prediction_sets(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """``cells`` (family, belief_error) with admits_error, admits_clean and conformal_abstain.

    An answer without reviews in a family is admitted: nothing speaks against
    it. ``limits`` has two rows per family of detectors, so it is broadcast.
    """
    side = lambda error: F.max(F.when(F.col("is_error") == error, F.col("threshold")))
    wide = limits.groupBy(F.col("family").alias("k_family")).agg(side(True).alias("k_error"), side(False).alias("k_clean"))
    joined = cells.join(F.broadcast(wide), F.col("family") == F.col("k_family"), "left")
    admits = lambda error, limit: F.coalesce(nonconformity(F.lit(error), F.col("belief_error")) <= F.col(limit), F.lit(True))
    return (joined.withColumns({"admits_error": admits(True, "k_error"), "admits_clean": admits(False, "k_clean")})
            .withColumn("conformal_abstain", F.col("admits_error") == F.col("admits_clean"))
            .drop("k_family", "k_error", "k_clean"))


def with_conformal(context: DataFrame, limits: DataFrame) -> DataFrame:
    """Gate contexts with ``conformal_abstain``; all other columns as they were."""
    named = context.withColumns({"family": main_family(), "k_belief": F.col("belief_error"),
                                 "belief_error": F.round("belief_error", 4)})
    return (prediction_sets(named, limits).withColumn("belief_error", F.col("k_belief"))
            .drop("family", "k_belief", "admits_error", "admits_clean"))


def with_policies(context: DataFrame, families) -> DataFrame:
    """Gate contexts in which cells of the named families have an active policy, so rules after 6 are reached."""
    active = main_family().isin(*families) if families else F.lit(False)
    return context.withColumn("policy_status", F.when(active, "ACTIVE").otherwise(F.col("policy_status")))


def coverage(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """(family, is_error, n, covered): held-out reviewed cells and how many sets hold the reviewer's answer."""
    hit = F.when(F.col("is_error"), F.col("admits_error")).otherwise(F.col("admits_clean"))
    return prediction_sets(cells, limits).groupBy("family", "is_error").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("covered"))
