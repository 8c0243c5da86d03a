"""Review queue and submitted reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden import constants as C

_FIELDS = ("review_id", "action", "edited_value", "comment", "reviewer", "confidence", "ts")


def valid_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with a known action; an EDIT must bring a value."""
    edited = (F.col("action") != "EDIT") | (F.coalesce("edited_value", F.lit("")) != "")
    return reviews.where(F.col("action").isin(*C.REVIEW_ACTIONS) & edited)


def submit(reviews: DataFrame) -> DataFrame:
    """Valid submissions as review rows with a repeatable id."""
    rid = F.sha2(F.concat_ws("|", "decision_id", "action", "reviewer", F.col("ts").cast("string")), 256)
    return valid_reviews(reviews).withColumn("review_id", rid)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review per decision, by time then id."""
    fields = [f for f in _FIELDS if f in reviews.columns]
    return reviews.groupBy("decision_id").agg(
        F.max_by(F.struct(*fields), F.struct("ts", "review_id")).alias("review")
    ).select("decision_id", "review.*")


def review_queue(decisions: DataFrame, reviews: DataFrame, status: str | None = None) -> DataFrame:
    """Escalated decisions with their latest review, if any.

    ``status``: ``pending`` or ``reviewed`` keeps one side only.
    """
    escalated = decisions.where("decision = 'ESCALATE'")
    last = latest_reviews(reviews)
    renamed = last.select("decision_id", *[F.col(c).alias(f"review_{c}" if c != "review_id" else c)
                                           for c in last.columns if c != "decision_id"])
    if status == "pending":
        return escalated.join(renamed.select("decision_id"), "decision_id", "left_anti").withColumn(
            "reviewed", F.lit(False))
    queue = escalated.join(renamed, "decision_id", "inner" if status == "reviewed" else "left")
    return queue.withColumn("reviewed", F.col("review_id").isNotNull())


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("reviewed")).alias("pending"),
        F.count_if("reviewed").alias("reviewed"),
    )
