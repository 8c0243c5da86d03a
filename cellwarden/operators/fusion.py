"""Fusing the evidence of a cell, of a row and of outside verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.functions.masses import masses, weight

RULES = ("family", "dempster", "cautious")


def _check(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"Unknown combination rule: {rule}")


def combined_weight(items: Column, rule: str) -> Column:
    """One weight from an array of (family, w) structs; zero when empty.

    ``dempster`` adds all weights, ``cautious`` takes the largest, ``family``
    takes the largest within each family and adds across families.
    """
    _check(rule)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, w: a + w)
    if rule == "dempster":
        return total(items["w"])
    if rule == "cautious":
        return F.coalesce(F.array_max(items["w"]), F.lit(0.0))
    per_family = F.transform(
        F.array_distinct(items["family"]),
        lambda f: F.array_max(F.filter(items, lambda x: x["family"] == f)["w"]),
    )
    return total(per_family)


def signed_weights(evidence: DataFrame) -> DataFrame:
    """Add the weight ``w`` and whether it speaks for an error; drop zero scores."""
    return evidence.where(F.col("score") != 0).withColumns({
        "for_error": F.col("claim") == "possible_error", "w": weight("score"),
    })


def fuse_cells(evidence: DataFrame, rule: str = "family") -> DataFrame:
    """Masses per (row_id, column), in one shuffle.

    The evidence of a cell is a handful of rows (detectors plus rules), so
    its list is bounded.
    """
    pick = lambda want: F.filter("items", lambda x: x["for_error"] == want)
    fused = (
        signed_weights(evidence).groupBy("row_id", "column")
        .agg(F.collect_list(F.struct("family", "w", "for_error")).alias("items"))
        .select("row_id", "column",
                combined_weight(pick(True), rule).alias("w_error"),
                combined_weight(pick(False), rule).alias("w_clean"))
    )
    return fused.withColumns(masses("w_error", "w_clean"))


def verdicts_to_evidence(verdicts: DataFrame) -> DataFrame:
    """Outside assessments of cells as evidence rows.

    Needs row_id, column, assessment and confidence. Unknown words count as
    uncertain. ``signed_score`` is negative where the verdict says clean.
    """
    word, c = F.col("assessment"), F.coalesce(F.col("confidence"), F.lit(0.5))
    claim = (
        F.when(word.isin("error", "likely_error"), "possible_error")
        .when(word.isin("clean", "likely_clean"), "likely_clean")
        .otherwise("uncertain")
    )
    score = (
        F.when(word.isin("error", "clean"), c)
        .when(word.isin("likely_error", "likely_clean"), 0.8 * c)
        .otherwise(0.5)
    )
    return verdicts.select(
        "row_id", "column",
        F.lit("external_auditor").alias("detector"), F.lit("external").alias("family"),
        F.lit("semantic").alias("source_type"), claim.alias("claim"),
        F.round(score, 4).alias("score"),
        F.when(claim == "likely_clean", -F.round(score, 4)).otherwise(F.round(score, 4)).alias("signed_score"),
        F.lit(False).alias("reference_verified"),
    )


def fuse_table(evidence: DataFrame, verdicts: DataFrame | None = None,
               rule: str = "family") -> tuple[DataFrame, DataFrame]:
    """Cell masses and row masses, with optional outside verdicts.

    ``evidence``: row_id, column, family, score (support for an error).
    ``verdicts``: row_id, column (null for a verdict on the row), agent and
    the weights w_error / w_clean.

    A row's error weight is its strongest cell; row verdicts are added (or,
    for ``cautious``, compete). Clean verdicts on a row apply to every cell
    of it.
    """
    _check(rule)
    across = F.sum if rule == "dempster" else F.max
    items = evidence.select("row_id", "column", "family", weight("score").alias("w"))
    if verdicts is None:
        row_side = None
    else:
        cell_verdicts = verdicts.where(F.col("column").isNotNull()).select(
            "row_id", "column", F.lit("verdict").alias("family"), F.col("w_error").alias("w"))
        row_side = (
            verdicts.where(F.col("column").isNull()).groupBy("row_id")
            .agg(across("w_error").alias("v_error"), across("w_clean").alias("v_clean"))
        )
        items = items.withColumn("own", F.lit(True)).unionByName(
            cell_verdicts.withColumn("own", F.lit(False)))
    if "own" not in items.columns:
        items = items.withColumn("own", F.lit(True))
    # Both levels group by row_id, so the cells need not move again for rows.
    cells = (
        items.repartition("row_id").groupBy("row_id", "column")
        .agg(F.collect_list(F.struct("family", "w", "own")).alias("items"))
        .select("row_id", "column",
                combined_weight(F.col("items"), rule).alias("w_error"),
                combined_weight(F.filter("items", lambda x: x["own"]), rule).alias("w_own"))
    )
    rows = cells.groupBy("row_id").agg(F.max("w_own").alias("w_own"))
    zero = F.lit(0.0)
    if row_side is None:
        cells = cells.withColumn("w_clean", zero)
        rows = rows.select("row_id", F.col("w_own").alias("w_error"), zero.alias("w_clean"))
    else:
        cells = cells.join(row_side, "row_id", "left").withColumn(
            "w_clean", F.coalesce("v_clean", zero))
        own, verdict = F.coalesce("w_own", zero), F.coalesce("v_error", zero)
        total = F.greatest(own, verdict) if rule == "cautious" else own + verdict
        rows = rows.join(row_side, "row_id", "full").select(
            "row_id", total.alias("w_error"), F.coalesce("v_clean", zero).alias("w_clean"))
    names = ["belief_error", "belief_clean", "ignorance", "conflict", "score"]
    out_cells = cells.withColumns(masses("w_error", "w_clean")).select("row_id", "column", *names)
    out_rows = rows.withColumns(masses("w_error", "w_clean")).select("row_id", *names)
    return out_cells, out_rows
