"""Column statistics, the fitted state of the detectors.

``fit`` reads the table and returns a few numbers per column; the detectors
then turn them into literals of row-wise expressions. What reaches the driver
is bounded by the schema (a fixed number of values per column), never by the
rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.functions.dates import date_format_label
from cellwarden.functions.text import (
    LONG_VALUE, is_float_text, is_integer_text, is_null_token, shape, value_key,
)
from cellwarden.operators.cells import (
    fixed_width, identity_of, is_numeric, text_of, unpivot,
)

COLUMNS_PER_PASS = 40
BRACKET_ACCURACY = 10_000
BRACKET_ROWS = 5_000_000
BRACKET_STEPS = 1_000


@dataclass
class ColumnStats:
    name: str
    position: int
    n_rows: int = 0
    n_values: int = 0
    n_distinct: int = 0
    n_grouped: int = 0
    top_count: int = 0
    null_tokens: int = 0
    integer_hits: int = 0
    float_hits: int = 0
    max_length: int = 0
    dominant_shape: int = 0  # rows of the most frequent shape
    common_shapes: list = field(default_factory=list)  # keys of 5 % of the values and more
    common_rows: int = 0
    dates: dict = field(default_factory=dict)  # label -> (count, first row id)
    mean: float | None = None
    std: float | None = None
    q1: float | None = None
    q3: float | None = None

    @property
    def has_null(self) -> bool:
        return self.n_values < self.n_rows

    @property
    def unique_with_null(self) -> int:
        """Distinct values with null counted as one."""
        return self.n_distinct + int(self.has_null)


@dataclass
class TableStats:
    n_rows: int
    types: dict
    columns: dict[str, ColumnStats]


def fixed_groups(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value key) with its number of rows, for fixed-width columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = unpivot(df, names, lambda c: identity_of(c, types[c])).where(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def text_groups(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) of the other columns, with what the text rules need.

    Values are classified after grouping, once per distinct value. A long
    value travels as its digest, so its own class is taken before that.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = unpivot(df, names, lambda c: text_of(c, types[c]), keep=["row_id"]).where("value is not null")
    long = F.length("value") > LONG_VALUE  # a digest is longer than any short value
    classes = {
        "is_token": is_null_token("value"),
        "is_integer": is_integer_text("value"),
        "is_float": is_float_text("value"),
        "label": date_format_label("value"),
        "shape_key": value_key(shape("value")),
    }
    keyed = cells.select(
        "column", "row_id", value_key("value").alias("value"), F.length("value").alias("length"),
        *[F.when(long, v).alias(f"long_{k}") for k, v in classes.items()])
    grouped = keyed.groupBy("column", "value", "length", *[f"long_{k}" for k in classes]).agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    return grouped.withColumns({
        k: F.when(long, F.col(f"long_{k}")).otherwise(v) for k, v in classes.items()})


def group_measures() -> dict:
    """Aggregates over value groups."""
    return {
        "n_distinct": F.count("*"),
        "n_grouped": F.sum(F.when(F.col("n") >= C.FD_MIN_GROUP, F.col("n")).otherwise(0)),
        "top_count": F.max("n"),
    }


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: distinct values, rows in groups of three or more, top count.

    One scan and one shuffle per key kind; the partial aggregation collapses
    repeated values before the shuffle.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    measures = [e.alias(k) for k, e in group_measures().items()]
    parts = []
    for kind in (True, False):
        names = [c for c in columns if fixed_width(types[c]) is kind]
        if names:
            cells = unpivot(df, names, lambda c: identity_of(c, types[c]))
            groups = cells.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
            parts.append(groups.groupBy("column").agg(*measures))
    return reduce(DataFrame.unionByName, parts)


def _chunks(names):
    return [names[i : i + COLUMNS_PER_PASS] for i in range(0, len(names), COLUMNS_PER_PASS)]


def wide_aggregate(df: DataFrame, columns: list[str], measures) -> DataFrame:
    """Global aggregates of many columns in one scan, as one row per column.

    ``measures(name)`` gives the named aggregates of a column; all columns
    must give the same names and types. Very wide tables take several passes,
    each reading its own columns only.
    """
    parts = []
    for names in _chunks(columns):
        aggs = {c: measures(c) for c in names}
        row = df.agg(*[e.alias(f"{i}_{m}") for i, c in enumerate(names) for m, e in aggs[c].items()])
        entries = [
            F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{m}").alias(m) for m in aggs[c]])
            for i, c in enumerate(names)
        ]
        parts.append(row.select(F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, parts)


# Half widths of the brackets, and the number of values each is sure to work
# from: width * n must cover the rank error n / accuracy and two more ranks.
BRACKET_WIDTHS = tuple(
    (w, 2.0 / (w - 1.0 / BRACKET_ACCURACY)) for w in (2.0 / BRACKET_ACCURACY, 2e-3))


def bracket_points(probabilities) -> list[float]:
    """The ranks to sketch: the range, and pairs around each probability."""
    clip = lambda p: min(1.0, max(0.0, p))
    around = [clip(p + s) for w, _ in BRACKET_WIDTHS for p in probabilities for s in (-w, w)]
    return [0.0, 1.0, *around]


def sketch(c: str, probabilities):
    return F.percentile_approx(F.col(c).cast("double"), bracket_points(probabilities), BRACKET_ACCURACY)


def brackets_from(points: list[float], n: int, probabilities) -> dict:
    """p -> (low, high) values that are certain to enclose the exact quantile.

    The narrowest one the number of values allows; the whole range for a
    handful of values.
    """
    for i, (_, least) in enumerate(BRACKET_WIDTHS):
        if n >= least:
            at = 2 + 2 * i * len(probabilities)
            return {p: (points[at + 2 * j], points[at + 2 * j + 1]) for j, p in enumerate(probabilities)}
    return {p: (points[0], points[1]) for p in probabilities}


def quantile_brackets(df: DataFrame, columns: list[str], probabilities) -> dict:
    """(column, p) -> bracket of every column that has values."""
    return brackets_and_counts(df, columns, probabilities)[0]


def brackets_and_counts(df: DataFrame, columns: list[str], probabilities) -> tuple[dict, dict]:
    """The brackets, and the number of values per column."""
    row = df.agg(*[e for i, c in enumerate(columns) for e in (
        sketch(c, probabilities).alias(f"q{i}"), F.count(c).alias(f"n{i}"))]).first()
    brackets = {
        (c, p): bracket
        for i, c in enumerate(columns) if row[f"q{i}"] is not None
        for p, bracket in brackets_from(row[f"q{i}"], row[f"n{i}"], probabilities).items()
    }
    n_values = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    return narrow_brackets(df, brackets, n_values), n_values


def narrow_brackets(df: DataFrame, brackets: dict, n_values: dict) -> dict:
    """Tighter brackets where one may hold more rows than a task should sort.

    One more pass sketches the values inside such a bracket at a thousand
    even ranks; the two steps around the wanted rank are kept.
    """
    width = 2 * BRACKET_WIDTHS[0][0]
    wide = {cp: b for cp, b in brackets.items()
            if b[0] < b[1] and n_values[cp[0]] * width > BRACKET_ROWS}
    if not wide:
        return brackets
    points = [i / BRACKET_STEPS for i in range(BRACKET_STEPS + 1)]
    aggs = []
    for i, ((c, _), (low, high)) in enumerate(wide.items()):
        v = F.col(c).cast("double")
        inside = F.when(v.between(low, high), v)
        aggs += [F.count_if(v < low).alias(f"b{i}"), F.count(inside).alias(f"n{i}"),
                 F.percentile_approx(inside, points, BRACKET_ACCURACY).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    out = dict(brackets)
    for i, (c, p) in enumerate(wide):
        if row[f"n{i}"] < 10 * BRACKET_STEPS:
            continue  # a step must hold several rows to be a safe margin
        rank = p * (n_values[c] - 1) - row[f"b{i}"]
        at = int(rank / row[f"n{i}"] * BRACKET_STEPS)
        steps = row[f"q{i}"]
        out[c, p] = (steps[max(0, at - 1)], steps[min(BRACKET_STEPS, at + 2)])
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probabilities,
                    brackets: dict | None = None, n_values: dict | None = None) -> DataFrame:
    """Exact linear quantiles, one row per (column, p), at any table size.

    A sketch first brackets each quantile. The second pass counts the rows
    below the bracket and the values inside it, a tiny share of the rows, so
    no task ever holds a whole column as ``percentile`` would. ``brackets``
    and ``n_values`` (per column) come together, from an earlier pass.
    """
    if brackets is None:
        brackets, n_values = brackets_and_counts(df, columns, probabilities)
    schema = "column string, p double, value double"
    if not brackets:
        return df.sparkSession.createDataFrame([], schema)
    ids = {cp: i for i, cp in enumerate(brackets)}
    position = []
    for (c, p), i in ids.items():
        v = F.col(c).cast("double")
        low, high = brackets[c, p]
        position.append(
            F.when(v.between(low, high), F.struct(F.lit(i).alias("id"), v.alias("value")))
            .when(v < low, F.struct(F.lit(i).alias("id"), F.lit(None).cast("double").alias("value")))
        )
    # Rows below a bracket share one null value: the partial aggregation
    # leaves one record of them per task.
    counts = (
        df.select(F.inline(F.array_compact(F.array(*position))))
        .groupBy("id", "value").agg(F.count("*").alias("n"))
    )
    names = df.sparkSession.createDataFrame(
        [(i, c, float(p), n_values[c]) for (c, p), i in ids.items()],
        "id int, column string, p double, n_values bigint")
    # At most the bracket's distinct values meet in one window.
    running = F.sum("n").over(
        Window.partitionBy("id").orderBy(F.col("value").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    at = F.col("p") * (F.col("n_values") - 1)
    ranked = (
        counts.withColumn("upto", running)
        .join(F.broadcast(names), "id")
        .withColumn("at", at)
    )
    below = F.min(F.when(F.col("upto") > F.floor("at"), F.col("value")))
    above = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("value")))
    frac = F.max(F.col("at") - F.floor("at"))
    return (
        ranked.where(F.col("value").isNotNull()).groupBy("column", "p")
        .agg(below.alias("lo"), above.alias("hi"), frac.alias("f"))
        .select("column", "p", (F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo"))).alias("value"))
    )


QUARTILES = (0.25, 0.75)


def _count_measures(types: dict):
    def measures(c):
        x = F.col(c).cast("double") if is_numeric(types[c]) else F.lit(None).cast("double")
        points = sketch(c, QUARTILES) if is_numeric(types[c]) else F.max(F.lit(None).cast("array<double>"))
        return {"n_rows": F.count(F.lit(1)), "n_values": F.count(c),
                "mean": F.avg(x), "std": F.stddev_pop(x), "points": points}

    return measures


def _text_measures() -> dict:
    hits = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    out = {"null_tokens": hits("is_token"), "integer_hits": hits("is_integer"),
           "float_hits": hits("is_float"), "max_length": F.max("length")}
    for i, (label, _) in enumerate(C.DATE_FORMATS):
        out[f"date_{i}"] = F.sum(F.when(F.col("label") == label, F.col("n")))
        out[f"first_{i}"] = F.min(F.when(F.col("label") == label, F.col("first_row")))
    return out


def common_shapes(groups: DataFrame) -> DataFrame:
    """Per column, the shapes that may reach 5 % of its values, with their rows.

    ``groups`` are value groups; a shape is taken once per distinct value.
    At most twenty shapes of a column can reach the share. Its rank prunes
    the rest per task before the shuffle.
    """
    counts = groups.groupBy("column", "shape_key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "shape_key"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= int(1 / C.RARE_SHAPE_SHARE))
    return top.groupBy("column").agg(F.collect_list(F.struct("shape_key", "n")).alias("shapes"))


def fit(df: DataFrame, columns: list[str], check_row_id: bool = False) -> TableStats:
    """Statistics of ``columns``; ``df`` carries ``row_id``.

    Two jobs: counts, moments, sketches and value groups first, then the
    exact quartiles inside the sketched brackets. ``check_row_id`` groups the
    row ids in the first job too and raises unless each names one row: two
    rows under one id would be repaired as one.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    fixed = [c for c in columns if fixed_width(types[c])]
    texts = [c for c in columns if c not in fixed]
    groups = [e.alias(k) for k, e in group_measures().items()]
    parts = [wide_aggregate(df, columns, _count_measures(types))]
    ids = ["row_id"] if check_row_id else []
    if fixed or ids:
        parts.append(fixed_groups(df, fixed + ids).groupBy("column").agg(*groups, F.sum("n").alias("n_cells")))
    if texts:
        extra = [e.alias(k) for k, e in _text_measures().items()]
        values = text_groups(df, texts)
        parts.append(values.groupBy("column").agg(*groups, *extra))
        parts.append(common_shapes(values))
    found: dict[str, dict] = {c: {} for c in [*columns, *ids]}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).collect()
    for r in rows:
        found[r["column"]].update({k: v for k, v in r.asDict().items() if v is not None})
    if check_row_id:
        of_ids = found["row_id"]
        n_rows = max((found[c].get("n_rows", 0) for c in columns), default=0)
        if of_ids.get("top_count", 0) > 1 or of_ids.get("n_cells", 0) < n_rows:
            raise ValueError("the key is not unique, numeric and filled in every row; "
                             "use sources.files.number_rows to number the rows")
    out = {}
    for i, c in enumerate(columns):
        f = found[c]
        out[c] = ColumnStats(
            name=c, position=i,
            **{k: f[k] for k in ("n_rows", "n_values", "n_distinct", "n_grouped", "top_count",
                                 "null_tokens", "integer_hits", "float_hits", "max_length",
                                 "mean", "std") if k in f},
            dates={label: (f[f"date_{j}"], f[f"first_{j}"])
                   for j, (label, _) in enumerate(C.DATE_FORMATS) if f.get(f"date_{j}")},
        )
    for c in texts:
        common = [x for x in found[c].get("shapes", [])
                  if x["n"] / out[c].n_values >= C.RARE_SHAPE_SHARE]
        out[c].dominant_shape = max((x["n"] for x in found[c].get("shapes", [])), default=0)
        out[c].common_shapes = [x["shape_key"] for x in common]
        out[c].common_rows = sum(x["n"] for x in common)
    brackets = {
        (c, p): bracket
        for c in columns if found[c].get("points") and out[c].n_values >= 5
        for p, bracket in brackets_from(found[c]["points"], out[c].n_values, QUARTILES).items()
    }
    brackets = narrow_brackets(df, brackets, {c: s.n_values for c, s in out.items()})
    if brackets:
        n_values = {c: s.n_values for c, s in out.items()}
        for q in exact_quantiles(df, columns, QUARTILES, brackets, n_values).collect():
            setattr(out[q["column"]], "q1" if q["p"] == QUARTILES[0] else "q3", q["value"])
    n = max((s.n_rows for s in out.values()), default=0)
    return TableStats(n_rows=n, types=types, columns=out)
