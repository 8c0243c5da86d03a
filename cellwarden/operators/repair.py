"""Applying automatic repairs and human edits to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden import constants as C
from cellwarden.functions.text import normalized


def auto_edits(decisions: DataFrame) -> DataFrame:
    """(row_id, column, new_value) of the automatic decisions that know a value."""
    return decisions.where(
        (F.col("decision") == "AUTO") & (F.coalesce("new_value", F.lit("")) != "")
    ).select("row_id", "column", "new_value")


def apply_repairs(df: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """The table with edited cells replaced; every other cell is untouched.

    ``df`` carries ``row_id``. Edits to unknown rows or columns have no
    effect, and a text that does not fit the column's type leaves the cell as
    it is. Of several edits of a cell the one with the greatest ``command_id``
    counts, where the edits carry it. One left join: the edits of a row (bounded by its columns) become
    one map, and AQE broadcasts that side when it turns out small.
    """
    edits = edits.where(F.col("column").isin(*columns))
    per_row = (
        last_edit(edits, "command_id" if "command_id" in edits.columns else "new_value")
        .groupBy("row_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "new_value"))).alias("_edits"))
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    fixed = [
        F.coalesce(F.try_element_at("_edits", F.lit(c)).try_cast(types[c]), F.col(c)).alias(c)
        if c in columns and isinstance(types[c], T.AtomicType) else F.col(c)
        for c in df.columns
    ]
    return df.join(per_row, "row_id", "left").select(*fixed)


def change_set(df: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Old and new text of the edited cells that really change."""
    types = {f.name: f.dataType for f in df.schema.fields}
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old_value"),
                 F.col("new_value").try_cast(types[c]).cast("string").alias("new_value"))
        for c in columns
    ]
    by_row = df.select("row_id", *columns).join(
        edits.select("row_id", F.col("column").alias("target"), "new_value"), "row_id")
    cells = by_row.select("row_id", "target", F.inline(F.array(*entries)))
    return cells.where(
        (F.col("column") == F.col("target")) & F.col("new_value").isNotNull()
        & ~F.col("old_value").eqNullSafe(F.col("new_value"))
    ).select("row_id", "column", "old_value", "new_value")


def resolve_columns(commands: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``target``: the table column a command's spoken name means.

    Exact name first, then the alias list in order. The list is fixed, so the
    lookup is an expression; an unresolved name stays null.
    """
    spoken = normalized("column")
    target = F.lit(None).cast("string")
    for word, names in reversed(C.COLUMN_ALIASES):
        known = [n for n in names if n in columns]
        if known:
            hit = spoken.contains(word) | (F.lit(word).contains(spoken) & (spoken != ""))
            target = F.when(hit, F.lit(known[0])).otherwise(target)
    exact = F.when(F.col("column").isin(*columns), F.col("column"))
    return commands.withColumn("target", F.coalesce(exact, target))


def resolve_edits(commands: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """Reviewer commands as (command_id, row_id, column, new_value, action).

    A command without a known column takes the first decided column of its
    row; when there is none it is dropped rather than guessed.
    """
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    first = (
        decisions.where(F.col("column").isin(*columns)).groupBy("row_id")
        .agg(F.min_by("column", order[F.col("column")]).alias("decided"))
    )
    return (
        resolve_columns(commands, columns).join(first, "row_id", "left")
        .withColumn("column", F.coalesce("target", "decided"))
        .where(F.col("column").isNotNull())
        .select("command_id", "row_id", "column", "new_value", "action")
    )


def most_escalated_column(decisions: DataFrame) -> DataFrame:
    """One row: the column with most escalations, by name on a tie."""
    counts = decisions.where("decision = 'ESCALATE'").groupBy("column").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("column", F.struct(-F.col("n"), "column")).alias("column"))


def match_batch_column(name: str | None, columns: list[str]) -> str | None:
    """Exact, else the first column that contains the name or lies in it."""
    if not name or name in columns:
        return name or None
    low = name.lower()
    return next((c for c in columns if low in c.lower() or c.lower() in low), None)


def batch_edits(decisions: DataFrame, columns: list[str], new_value: str,
                column: str | None = None) -> DataFrame:
    """Edits of every decided cell of one column.

    Without a usable column name the most escalated one is taken.
    """
    target = match_batch_column(column, columns)
    if target is not None:
        cells = decisions.where(F.col("column") == target)
    else:
        cells = decisions.join(F.broadcast(most_escalated_column(decisions)), "column")
    return cells.select("row_id", "column", F.lit(new_value).alias("new_value")).distinct()


def last_edit(edits: DataFrame, order: str) -> DataFrame:
    """The latest edit per cell."""
    return edits.groupBy("row_id", "column").agg(F.max_by("new_value", order).alias("new_value"))
