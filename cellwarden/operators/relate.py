"""Detectors that compare cells with each other: shapes, near-duplicates,
duplicate keys and functional dependencies.

Each groups first (with map-side partial counts), keeps the groups that
matter, and joins only cells that can match back to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden import constants as C
from cellwarden.functions import text as X
from cellwarden.functions.similarity import WORD_BITS, indel_ratio, indel_ratio_long
from cellwarden.operators.cells import fixed_width, identity_of, is_string, text_of, unpivot
from cellwarden.operators.evidence import found
from cellwarden.operators.skew import ROWS_PER_TASK, join_groups
from cellwarden.operators.stats import TableStats


def _string_columns(stats: TableStats, min_values: int) -> list[str]:
    return [c for c, s in stats.columns.items()
            if is_string(stats.types[c]) and s.n_values >= min_values]


def _column_number(stats: TableStats, attribute: str, names: list[str]) -> Column:
    """A per-column statistic as an expression over the ``column`` column."""
    pairs = [x for c in names for x in (F.lit(c), F.lit(getattr(stats.columns[c], attribute)))]
    return F.create_map(*pairs)[F.col("column")]


# --- pattern rarity ---------------------------------------------------------

def shape_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, shape_key) with its number of cells."""
    cells = unpivot(df, names, lambda c: X.value_key(X.shape(c))).withColumnRenamed("value", "shape_key")
    return cells.where(F.col("shape_key").isNotNull()).groupBy("column", "shape_key").agg(
        F.count("*").alias("n_shape"))


def with_shapes(keys: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """(column, shape_key, ...) with ``shape``: the key itself, or the long shape it is the digest of.

    Only cells with a long shape and a wanted key are looked up.
    """
    long = unpivot_shapes(df, names).where(F.length("shape") > X.LONG_VALUE).select(
        "column", X.value_key("shape").alias("shape_key"), F.col("shape").alias("_long"))
    wanted = keys.where(F.length("shape_key") > X.LONG_VALUE).select("column", "shape_key")
    found_long = long.join(wanted, ["column", "shape_key"], "left_semi").groupBy("column", "shape_key").agg(
        F.any_value("_long").alias("_long"))
    return keys.join(found_long, ["column", "shape_key"], "left").withColumn(
        "shape", F.coalesce("_long", "shape_key")).drop("_long")


def rare_patterns(df: DataFrame, stats: TableStats, names: list[str] | None = None,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Cells whose shape covers less than 5 % of their column.

    The common shapes (at most twenty per column) were fitted, so a row-wise
    test drops the bulk of the cells, and columns without a rare shape are
    not read. Only rare cells are counted and joined to their counts.
    """
    names = [c for c in _string_columns(stats, 5) if (names is None or c in names)
             and stats.columns[c].common_rows < stats.columns[c].n_values]
    if not names:
        return None
    cells = unpivot_shapes(df, names).withColumn("shape_key", X.value_key("shape"))
    common = F.lit(False)
    for c in names:
        if stats.columns[c].common_shapes:
            common = common | ((F.col("column") == c) & F.col("shape_key").isin(*stats.columns[c].common_shapes))
    rare = cells.where(~common)
    counts = rare.groupBy("column", "shape_key").agg(F.count("*").alias("n_shape"))
    largest = int(C.RARE_SHAPE_SHARE * max(stats.columns[c].n_values for c in names))
    joined = join_groups(rare, counts, ["column", "shape_key"], "n_shape", "row_id", largest, rows_per_task)
    share = F.col("n_shape") / _column_number(stats, "n_values", names)
    dominant = _column_number(stats, "dominant_shape", names) / _column_number(stats, "n_values", names)
    strength = dominant * F.least(F.lit(1.0), 1.0 - share / C.RARE_SHAPE_SHARE)
    hit = found(
        "pattern_rarity_detector", F.col("column"), F.round(strength, 4), F.col("value"),
        reasons=["rare_pattern"],
        details={"observed_pattern": F.col("shape"), "pattern_share": F.round(share, 4)},
    )
    return joined.select("row_id", F.inline(F.array(hit)))


def unpivot_shapes(df: DataFrame, names: list[str]) -> DataFrame:
    """Non-null cells of string columns with value and shape."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), X.shape(c).alias("shape"))
               for c in names]
    return df.select("row_id", F.inline(F.array(*entries))).where(F.col("value").isNotNull())


# --- near duplicates --------------------------------------------------------

def value_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) with count and first row, for columns of few values."""
    cells = unpivot(df, names, F.col, keep=["row_id"]).where(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def similar_lengths(value: Column) -> Column:
    """Lengths a partner may have if the similarity reaches the threshold.

    The common subsequence is no longer than the shorter side, so
    2 * min / (a + b) >= t bounds the other length from both sides.
    """
    t = C.SIMILARITY_MIN
    n = F.length(F.lower(value))
    return F.sequence(F.ceil(n * t / (2 - t) - 1e-9), F.floor(n * (2 - t) / t + 1e-9))


def with_similarity(pairs: DataFrame, a: str, b: str, longest: int) -> DataFrame:
    """Add ``ratio``; Arrow batches take over when both texts can be long."""
    if longest <= WORD_BITS:
        return pairs.withColumn("ratio", indel_ratio(a, b))
    shorter = F.least(F.length(F.lower(F.col(a))), F.length(F.lower(F.col(b))))
    return (
        pairs.where(shorter <= WORD_BITS).withColumn("ratio", indel_ratio(a, b))
        .unionByName(pairs.where(shorter > WORD_BITS).withColumn("ratio", indel_ratio_long(a, b)))
    )


def near_duplicate_columns(stats: TableStats, max_distinct: int | None = None) -> list[str]:
    """String columns with a repeated value; ``max_distinct`` keeps to categorical ones."""
    return [c for c in _string_columns(stats, 5)
            if 2 <= stats.columns[c].n_distinct <= (max_distinct or stats.columns[c].n_distinct)
            and stats.columns[c].top_count > 1]


def _most_edits(a: Column, b: Column) -> Column:
    """Insertions and deletions between texts of two lengths at the threshold."""
    return F.floor((1 - C.SIMILARITY_MIN) * (a + b) + 1e-9).cast("int")


def _cuts(length: Column) -> Column:
    """(piece, start, size): a text of ``length`` cut into one piece more than any partner's edits."""
    t = C.SIMILARITY_MIN
    pieces = F.least(length, _most_edits(length, F.floor(length * (2 - t) / t + 1e-9)) + 1)
    bound = lambda i: F.floor(i * length / pieces).cast("int")
    return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(
        i.alias("piece"), bound(i).alias("start"), (bound(i + 1) - bound(i)).alias("size")))


# Shortened copies made of a text for one partner length; beyond it the text is cut into pieces.
MOST_COPIES = 300
MOST_LEFT_OUT = 4


def _left_out(own: Column, other: Column) -> Column:
    """Characters a text must lose to meet any partner of a length at the threshold.

    Of two texts within d insertions and deletions, one loses (d + own - other) / 2
    characters and the other the rest of d; what is left is the same. d has the
    parity of own + other. Null: no two texts of these lengths are close but unequal.
    """
    most = _most_edits(own, other)
    most = most - F.pmod(most + own + other, F.lit(2))
    return F.when((most > 0) & (most >= F.abs(own - other)), F.floor((most + own - other) / 2).cast("int"))


def _copies(length: Column, left_out: Column) -> Column:
    """Number of ways to leave so many characters out of a text."""
    ways = F.lit(1.0)
    out = F.when(left_out == 0, ways)
    for k in range(1, MOST_LEFT_OUT + 1):
        ways = ways * (length - (k - 1)) / k
        out = out.when(left_out == k, ways)
    return out.otherwise(F.lit(float("inf")))


def _by_copies(single_length: Column, repeated_length: Column) -> Column:
    """Whether shortened copies are few enough on both sides to index texts of these lengths by them."""
    a, b = _left_out(single_length, repeated_length), _left_out(repeated_length, single_length)
    return (_copies(single_length, a) <= MOST_COPIES) & (_copies(repeated_length, b) <= MOST_COPIES)


def leftovers(text: Column, left_out: Column) -> Column:
    """All distinct texts that remain when ``left_out`` characters (at most MOST_LEFT_OUT) are left out."""
    states = F.array(F.struct(text.alias("s"), F.lit(1).alias("i")))
    out = F.when(left_out == 0, F.array(text))
    for k in range(1, MOST_LEFT_OUT + 1):
        # Positions are left out from left to right, so no set of them comes twice.
        states = F.flatten(F.transform(
            F.filter(states, lambda e: e["i"] <= F.length(e["s"])),
            lambda e: F.transform(F.sequence(e["i"], F.length(e["s"])), lambda i: F.struct(
                F.concat(F.substring(e["s"], F.lit(1), i - 1), F.substring(e["s"], i + 1, F.length(e["s"]))).alias("s"),
                i.alias("i")))))
        out = out.when(left_out == k, F.array_distinct(F.transform(states, lambda e: e["s"])))
    return out


def met_by_copies(single: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each single text with the first repeated one close to it, by a deletion neighbourhood.

    Both sides are indexed by every text that remains when as many characters
    as their lengths allow are left out. Equal remainders mean the pair is
    close, and a close pair has one, so nothing is missed and nothing is
    compared in vain. Of a remainder's repeated texts only the first two, by
    row, can be the first unlike a given text, so a key never joins many to
    many. The column names are those of the pairs' inputs.
    """
    low = F.lower("canonical")
    first = F.min(F.struct("canonical_row", "canonical", "canonical_count"))
    # Copies are made only for pairs of lengths that occur, a few rows per column.
    text = F.lower("value")
    lengths = single.groupBy("column", F.length(text).alias("n"), "len").agg(F.lit(1).alias("_"))
    lengths = lengths.join(repeated.select("column", "len").distinct(), ["column", "len"]).where(
        _by_copies(F.col("n"), F.col("len"))).select("column", "n", "len")
    right = (
        repeated.groupBy("column", low.alias("low")).agg(first.alias("m"))  # of texts alike but for case the first
        .select("column", "low", "m.*", F.length("low").alias("len"))
        .join(F.broadcast(lengths), ["column", "len"])
        .select("*", F.explode(leftovers(F.col("low"), _left_out(F.col("len"), F.col("n")))).alias("rest")))
    order = F.row_number().over(Window.partitionBy("column", "n", "len", "rest").orderBy("canonical_row"))
    right = right.withColumn("place", order).where("place <= 2").drop("place")
    left = (
        single.withColumn("n", F.length(text)).join(F.broadcast(lengths), ["column", "n", "len"])
        .select("column", "value", "row_id", "n", "len",
                F.explode(leftovers(text, _left_out(F.col("n"), F.col("len")))).alias("rest")))
    met = left.join(right, ["column", "n", "len", "rest"]).where(F.lower("value") != F.col("low"))
    return met.groupBy("column", "row_id", "value").agg(first.alias("m")).select("column", "value", "row_id", "m.*")


def blocked_pairs(single: DataFrame, repeated: DataFrame, longer_only: bool = False) -> DataFrame:
    """Pairs that can reach the threshold, met on a shared piece; ``longer_only``: those ``met_by_copies`` leaves.

    With fewer edits than pieces one piece of the repeated text survives. Edits
    before it move it, edits behind it must make up the difference of lengths,
    and both share one budget. So the single text is probed for every piece
    at every such place; no pair is missed, and texts that share no piece
    never meet.
    """
    n = F.length(F.lower(F.col("value")))
    single = single.where("len > 0")
    if longer_only:
        single = single.where(_left_out(n, F.col("len")).isNotNull() & ~_by_copies(n, F.col("len")))
    low = F.lower(F.col("canonical"))
    right = repeated.where("len > 0").select(
        "*", F.explode(_cuts(F.col("len"))).alias("cut")).select(
        "*", F.col("cut.piece").alias("piece"),
        F.substring(low, F.col("cut.start") + 1, F.col("cut.size")).alias("part")).drop("cut")
    text = F.lower(F.col("value"))
    reach, longer = _most_edits(n, F.col("len")), n - F.col("len")
    probes = single.select("*", F.explode(_cuts(F.col("len"))).alias("cut")).select(
        "*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("cut.start") + F.ceil((longer - reach) / 2).cast("int")),
                                  F.greatest(F.lit(0), F.col("cut.start") + F.floor((longer + reach) / 2).cast("int"))
                                  )).alias("at"))
    left = probes.where(F.col("at") + F.col("cut.size") <= n).select(
        "column", "value", "row_id", "len", F.col("cut.piece").alias("piece"),
        F.substring(text, F.col("at") + 1, F.col("cut.size")).alias("part")).distinct()
    return left.join(right, ["column", "len", "piece", "part"]).drop("piece", "part").distinct()


def same_digits(a, b) -> Column:
    """Both texts hold the same digits in the same order."""
    digits = lambda c: F.regexp_replace(c, r"\P{N}", "")
    return digits(a) == digits(b)


def near_duplicates(df: DataFrame, stats: TableStats, safe_columns=None,
                    names: list[str] | None = None, max_distinct: int | None = None) -> DataFrame | None:
    """Single values close to a repeated one; the first such one is expected.

    Works on the distinct values. In columns of up to ``NEAR_DUP_MAX_DISTINCT``
    of them partners meet on (column, length); beyond it short texts meet on
    what remains when characters are left out, longer ones on a shared piece.
    A single value sits in exactly one row, its first, so no join back to the
    table follows. ``safe_columns`` may be repaired automatically, but only
    where value and expected value hold the same digits: numbers, codes and
    dates that differ in a digit are other values, not typos. None (the rule
    set's own behaviour) marks every finding as repairable.
    """
    names = [c for c in near_duplicate_columns(stats, max_distinct) if names is None or c in names]
    if not names:
        return None
    many = [c for c in names if stats.columns[c].n_distinct > C.NEAR_DUP_MAX_DISTINCT]
    values = value_frequencies(df, names)
    single = values.where("n = 1").select(
        "column", "value", F.col("first_row").alias("row_id"),
        F.explode(similar_lengths(F.col("value"))).alias("len"),
    ).withColumn("len", F.col("len").cast("int"))
    repeated = values.where("n > 1").select(
        "column", F.col("value").alias("canonical"), F.col("n").alias("canonical_count"),
        F.col("first_row").alias("canonical_row"), F.length(F.lower("value")).alias("len"),
    )
    few = ~F.col("column").isin(*many) if many else F.lit(True)
    pairs = single.where(few).join(repeated.where(few), ["column", "len"]).drop("len")
    if many:
        # A value becomes many rows, so few bytes are much work: not to be coalesced into few tasks.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sides = [side.where(~few).repartition(parts) for side in (single, repeated)]
        for met in (met_by_copies(*sides), blocked_pairs(*sides, longer_only=True)):
            pairs = pairs.unionByName(met.select(*pairs.columns))
    longest = max(stats.columns[c].max_length for c in names)
    close = with_similarity(pairs, "value", "canonical", longest).where(
        (F.col("ratio") >= C.SIMILARITY_MIN) & (F.col("ratio") < 1.0))
    best = close.groupBy("column", "row_id", "value").agg(
        F.min_by(F.struct("canonical", "canonical_count", "ratio"), "canonical_row").alias("m"))
    safe = F.lit(True) if safe_columns is None else (
        F.col("column").isin(*safe_columns) & same_digits("value", "m.canonical") if safe_columns else F.lit(False))
    hit = found(
        "near_duplicate_detector", F.col("column"), F.round("m.ratio", 4), F.col("value"),
        F.col("m.canonical"), reasons=["near_duplicate", "possible_typo"],
        repairable=safe,
        details={"similarity": F.round("m.ratio", 4), "canonical_frequency": F.col("m.canonical_count")},
    )
    return best.select("row_id", F.inline(F.array(hit)))


# --- duplicate keys ---------------------------------------------------------

def duplicate_key_columns(stats: TableStats) -> list[str]:
    """Key-like columns that repeat a value."""
    out = []
    for c, s in stats.columns.items():
        named = X.name_has(c, C.KEY_NAME_HINTS)
        floor = 0.5 if named else 0.9
        if s.n_rows >= 3 and s.unique_with_null >= s.n_rows * floor and s.top_count > 1:
            out.append(c)
    return out


def duplicate_keys(df: DataFrame, stats: TableStats, names: list[str] | None = None,
                   max_values: int | None = None, details: bool = False,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Every row of a repeated value in a key-like column.

    ``max_values`` keeps only the first repeated values per column, by first
    row. ``details`` adds the first ten rows of each group.
    """
    names = [c for c in duplicate_key_columns(stats) if names is None or c in names]
    if not names:
        return None
    cells = df.select("row_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), identity_of(c, stats.types[c]).cast("string").alias("value_key"),
                 text_of(c, stats.types[c]).alias("value")) for c in names
    ]))).where(F.col("value_key").isNotNull())
    keys = ["column", "value_key"]
    groups = cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row")).where("n > 1")
    if max_values is not None:
        order = F.row_number().over(Window.partitionBy("column").orderBy("first_row"))
        groups = groups.withColumn("rank", order).where(F.col("rank") <= max_values).drop("rank")
    largest = max(stats.columns[c].top_count for c in names)
    joined = join_groups(cells, groups.drop("first_row"), keys, "n", "row_id", largest, rows_per_task)
    info = {"duplicate_count": F.col("n")}
    if details:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))
        # Only groups above one row, and ten rows of each, are collected.
        first = (joined.select(*keys, "row_id", "n").withColumn("rank", rank).where("rank <= 10")
                 .groupBy(*keys).agg(F.count("*").alias("kept"), F.max("n").alias("n"),
                                     F.array_sort(F.collect_list("row_id")).alias("rows")))
        joined = join_groups(joined.drop("n"), first, keys, "n", "row_id", largest, rows_per_task)
        info["duplicate_rows"] = F.to_json("rows")
    hit = found("duplicate_key_detector", F.col("column"), 0.9, F.col("value"),
                reasons=["duplicate_key"], details=info)
    return joined.select("row_id", F.inline(F.array(hit)))


# --- functional dependencies ------------------------------------------------

def fd_determinants(stats: TableStats) -> list[str]:
    """Columns that repeat enough to determine another one."""
    n = stats.n_rows
    return [c for c, s in stats.columns.items()
            if 1 < s.n_distinct < 0.9 * n and s.n_grouped >= C.FD_MIN_COVERAGE * n]


def fd_dependents(stats: TableStats) -> list[str]:
    """Columns with more than one value, none of them at 90 % or above."""
    return [c for c, s in stats.columns.items()
            if s.n_distinct > 1 and s.top_count / s.n_values < C.FD_MAX_SHARE]


def _fd_clean(c: str, stats: TableStats) -> Column:
    """The cell holds a value that is not one of the null words.

    Only text can spell one, and a float can be NaN; other types skip the
    conversion to text.
    """
    kind = stats.types[c]
    if is_string(kind):
        return F.col(c).isNotNull() & ~X.is_null_token(c, C.FD_NULL_TOKENS)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.col(c).isNotNull() & ~F.isnan(c)
    return F.col(c).isNotNull()


# Share of the rows counted first to rule out column pairs.
FD_FIRST_SHARE = 4
# From this many distinct values on, whole x groups are taken for that.
FD_MANY_GROUPS = 1000
# Buckets by hash in which a dependent's values are counted for that.
FD_BUCKETS = 8
# (bits of a bucket's count, longs for all buckets), by the rows of the most frequent x value.
FD_PACKED = ((7, 1), (15, 2), (31, 4), (62, 8))


def fd_pairs(stats: TableStats) -> list[tuple[str, str]]:
    """Column pairs the column statistics cannot rule out.

    The m groups of x keep at most m distinct values of y; every further
    distinct value of y is at least one violating row. And no group keeps
    more rows than y's most frequent value has.
    """
    n = stats.n_rows
    out = []
    for x in fd_determinants(stats):
        for y in fd_dependents(stats):
            sx, sy = stats.columns[x], stats.columns[y]
            # Rows of y that may be null words are not counted on.
            clean = 0 if sy.mean is not None and sy.mean != sy.mean else sy.n_values - sy.null_tokens
            kept = max(0, sx.n_grouped + clean - n)
            bound = min(sx.n_distinct + sy.n_values - sy.n_distinct, sx.n_distinct * sy.top_count)
            if x != y and C.FD_MIN_CONFIDENCE * kept <= bound:
                out.append((x, y))
    return out


def _fd_key(c: str, stats: TableStats, keep: Column) -> Column:
    """A 64-bit hash, exact for fixed-width columns; text gets a second one. Null for cells not to keep."""
    second = F.lit(0).cast("bigint") if fixed_width(stats.types[c]) else F.xxhash64(F.lit("second"), c)
    return F.when(keep, F.struct(F.xxhash64(c).alias("a"), second.alias("b")))


def _fd_part(c: str, share: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(share)) == 0


def _least_violations(df: DataFrame, stats: TableStats, pairs: list, share: int) -> dict:
    """(x, y) -> rows of a part of the table that surely violate the dependency.

    A row is made once per x, whatever its dependents. Their values are
    counted in a few buckets by hash, and the counts of a group lie side by
    side in longs: no x value has more rows than the most frequent one, so
    none overflows. The fullest bucket holds at least the rows of the most
    frequent value, so violations are never counted too high.
    """
    alike: dict[tuple, dict[str, list[str]]] = {}
    for x, y in pairs:
        packed = next(p for p in FD_PACKED if stats.columns[x].top_count < 1 << p[0])
        many = stats.columns[x].n_distinct >= FD_MANY_GROUPS
        alike.setdefault((*packed, many), {}).setdefault(x, []).append(y)
    out = {}
    for (bits, longs, many), partners in alike.items():
        xs = list(partners)
        ys = list(dict.fromkeys(y for of_x in partners.values() for y in of_x))
        per_long = FD_BUCKETS // longs
        counted = [f"n{i}_{j}" for i in range(len(ys)) for j in range(longs)]
        part = df.select("row_id", *dict.fromkeys([*xs, *ys]))
        if not many:
            part = part.where(_fd_part("row_id", share))
        rows = part.select(*xs, *[
            F.when(_fd_clean(y, stats), F.xxhash64(F.lit("bucket"), y).bitwiseAND(FD_BUCKETS - 1).cast("int")).alias(f"b{i}")
            for i, y in enumerate(ys)])
        ones = []
        for i in range(len(ys)):
            at = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(f"b{i}").bitwiseAND(per_long - 1) * bits)
            ones += [F.when(F.shiftright(f"b{i}", per_long.bit_length() - 1) == j if longs > 1 else F.col(f"b{i}").isNotNull(), at)
                     .otherwise(F.lit(0).cast("bigint")).alias(f"n{i}_{j}") for j in range(longs)]
        keys = [F.struct(F.lit(i).alias("x"), _fd_key(
            x, stats, F.col(x).isNotNull() & _fd_part(x, share) if many else F.col(x).isNotNull()).alias("x_key"))
            for i, x in enumerate(xs)]
        rows = rows.select(*ones, F.inline(F.array(*keys))).where(F.col("x_key").isNotNull())
        groups = rows.groupBy("x", "x_key").agg(
            F.count("*").alias("size"), *[F.sum(c).alias(c) for c in counted]).where(F.col("size") >= C.FD_MIN_GROUP)
        violations = []
        for i in range(len(ys)):
            of_y = [F.shiftright(f"n{i}_{j}", bits * k).bitwiseAND((1 << bits) - 1)
                    for j in range(longs) for k in range(per_long)]
            violations.append(F.sum(reduce(Column.__add__, of_y) - F.greatest(*of_y)).alias(f"v{i}"))
        for r in groups.groupBy("x").agg(*violations).collect():
            out.update({(xs[r["x"]], y): r[f"v{ys.index(y)}"] for y in partners[xs[r["x"]]]})
    return out


def _part_violations(df: DataFrame, stats: TableStats, pairs: list, share: int) -> dict:
    """(x, y) -> rows of a part of the table that violate the dependency, counted by value."""
    return {(r["x"], r["y"]): (r["kept"] or 0) - (r["mode_n"] or 0)
            for r in _pair_counts(df, stats, pairs, share).collect()}


def _pair_counts(df: DataFrame, stats: TableStats, pairs: list, share: int | None) -> DataFrame:
    """Per (pair, x value): rows, clean rows and rows of the top y value.

    A row's keys are computed once; each x takes along the dependents it is
    still paired with, so that rows are made for those pairs only. Keys are
    64-bit hashes, exact for fixed-width columns; text gets a second one.
    """
    partners: dict[str, list[tuple[int, str]]] = {}
    for i, (x, y) in enumerate(pairs):
        partners.setdefault(x, []).append((i, y))
    ys = list(dict.fromkeys(y for _, y in pairs))

    def x_entry(x):
        of_x = [F.struct(F.lit(i).alias("pair"), F.col(f"y{ys.index(y)}").alias("y_key")) for i, y in partners[x]]
        keep = F.col(x).isNotNull()
        if share is not None:
            keep = keep & _fd_part(x if stats.columns[x].n_distinct >= FD_MANY_GROUPS else "row_id", share)
        return F.struct(_fd_key(x, stats, keep).alias("x_key"), F.array(*of_x).alias("of_x"))

    hashed = df.select("row_id", *partners, *[
        _fd_key(y, stats, _fd_clean(y, stats)).alias(f"y{i}") for i, y in enumerate(ys)])
    rows = (
        hashed.select(F.inline(F.array(*[x_entry(x) for x in partners]))).where(F.col("x_key").isNotNull())
        .select("x_key", F.inline("of_x"))
    )
    counts = rows.groupBy("pair", "x_key", "y_key").agg(F.count("*").alias("n"))
    clean_n = F.when(F.col("y_key").isNotNull(), F.col("n"))
    names = df.sparkSession.createDataFrame(
        [(i, x, y) for i, (x, y) in enumerate(pairs)], "pair int, x string, y string")
    groups = counts.groupBy("pair", "x_key").agg(
        F.sum("n").alias("size"), F.sum(clean_n).alias("kept"), F.max(clean_n).alias("mode_n"),
    ).where(F.col("size") >= C.FD_MIN_GROUP)
    return groups.groupBy("pair").agg(
        F.sum("kept").alias("kept"), F.sum("mode_n").alias("mode_n"),
    ).join(F.broadcast(names), "pair")


def mine_fds(df: DataFrame, stats: TableStats, first_share: int | None = FD_FIRST_SHARE,
             min_rows: int = 50_000) -> DataFrame | None:
    """Single-column dependencies x -> y that hold for 90 % of the rows.

    Exact over all rows, in steps on larger tables. In a part of the rows
    violations are counted in buckets for every pair, then by value for those
    still in question. They only grow with more rows and finer buckets, so a
    pair whose part already has more than the whole table may have is out. The
    remaining pairs, few as a rule, are counted over all rows.
    """
    n = stats.n_rows
    pairs = fd_pairs(stats)
    if not pairs or n < C.FD_MIN_GROUP:
        return None
    if first_share is not None and n >= min_rows:
        limit = 1.0 - C.FD_MIN_CONFIDENCE
        for part_of in (_least_violations, _part_violations):
            part = part_of(df, stats, pairs, first_share)
            pairs = [(x, y) for x, y in pairs
                     if part.get((x, y), 0) <= limit * stats.columns[x].n_grouped * (1 + 1e-9)]
            if not pairs:
                return None
    whole = _pair_counts(df, stats, pairs, None).withColumn("confidence", F.col("mode_n") / F.col("kept"))
    return whole.where(
        (F.col("kept") >= C.FD_MIN_COVERAGE * n) & (F.col("confidence") >= C.FD_MIN_CONFIDENCE)
    ).select("x", "y", "confidence")


def fd_violations(df: DataFrame, stats: TableStats, fds: list, max_per_fd: int | None = None,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Cells that differ from the most frequent value of their x group.

    ``fds`` are (x, y, confidence) of ``mine_fds``, at most one per pair of
    columns. Groups are counted, the minority values are found among the
    counts, and only those are joined back to the rows.
    """
    if not fds:
        return None
    entries = [
        F.struct(
            F.lit(i).alias("fd"),
            identity_of(x, stats.types[x]).cast("string").alias("x_key"),
            F.when(_fd_clean(y, stats), X.strip(text_of(y, stats.types[y]))).alias("y_value"),
        )
        for i, (x, y, _) in enumerate(fds)
    ]
    cells = df.select("row_id", F.inline(F.array(*entries))).where(F.col("x_key").isNotNull())
    # Grouped by the value itself: a text as an aggregate would have to be sorted for.
    counts = cells.groupBy("fd", "x_key", "y_value").agg(F.count("*").alias("n"))
    clean_n = F.when(F.col("y_value").isNotNull(), F.col("n"))
    of_x = {
        "size": F.sum("n"), "variants": F.count("*"), "mode_n": F.max(clean_n),
        # most rows first, then the smallest text
        "mode": F.min(F.when(clean_n.isNotNull(), F.struct((-F.col("n")).alias("n"), "y_value"))),
    }
    several = (F.col("size") >= C.FD_MIN_GROUP) & (F.col("variants") > 1)
    largest = max(stats.columns[x].top_count for x, _, _ in fds)  # no x value has more rows, or variants
    if largest <= rows_per_task:
        group = Window.partitionBy("fd", "x_key")
        minority = counts.withColumns({k: e.over(group) for k, e in of_x.items()}).where(
            several & F.col("y_value").isNotNull())
    else:
        groups = counts.groupBy("fd", "x_key").agg(*[e.alias(k) for k, e in of_x.items()]).where(several)
        minority = join_groups(
            counts.where(F.col("y_value").isNotNull()), groups,
            ["fd", "x_key"], "variants", "y_value", largest, rows_per_task)
    minority = minority.where(F.col("n") < F.col("mode_n")).select(
        "fd", "x_key", "y_value", "n", "size", F.col("mode.y_value").alias("expected"))
    joined = join_groups(cells, minority, ["fd", "x_key", "y_value"], "n", "row_id", largest, rows_per_task)
    if max_per_fd is not None:
        order = F.row_number().over(Window.partitionBy("fd").orderBy("row_id"))
        joined = joined.withColumn("rank", order).where(F.col("rank") <= max_per_fd)
    pick = lambda values: F.element_at(F.array(*values), F.col("fd") + 1)
    confidence = pick([F.lit(float(c)) for _, _, c in fds])
    hit = found(
        "fd_violation_detector", pick([F.lit(y) for _, y, _ in fds]),
        F.round(confidence * 0.9, 4), F.col("y_value"), F.col("expected"),
        reasons=["fd_violation"], seq=F.col("fd"),
        details={
            "fd_rule": pick([F.lit(f"{x} -> {y}") for x, y, _ in fds]),
            "fd_confidence": F.round(confidence, 4), "group_size": F.col("size"),
        },
    )
    return joined.select("row_id", F.inline(F.array(hit)))


def union_all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])
