"""Audit ledger: events, queries over them and tamper evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwarden.sources.files import number_rows

LEDGER_SCHEMA = (
    "id string, event_type string, actor string, dataset_id string, decision_id string, "
    "details map<string,string>, ts timestamp"
)
EVENT_CAP = 1000


def event_id(*parts) -> Column:
    """Repeatable id: a rerun of the same step writes the same id."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def _decision_event(ts: Column, actor: str) -> list[Column]:
    return [
        event_id(F.lit("decision"), "decision_id").alias("id"),
        F.col("decision").alias("event_type"), F.lit(actor).alias("actor"),
        F.col("dataset_id"), F.col("decision_id"),
        F.create_map(
            F.lit("row_id"), F.col("row_id").cast("string"), F.lit("column"), F.col("column"),
            F.lit("belief_error"), F.col("belief_error").cast("string"),
            F.lit("conflict"), F.col("conflict_k").cast("string"),
        ).alias("details"),
        ts.alias("ts"),
    ]


def decision_events(decisions: DataFrame, ts: Column, actor: str = "system") -> DataFrame:
    """One event per decision."""
    return decisions.select(*_decision_event(ts, actor))


# Shares of a dataset that are ranked and counted apart.
EVENT_PARTS = 128


def capped_decision_events(decisions: DataFrame, ts: Column, cap: int = EVENT_CAP,
                           actor: str = "system") -> DataFrame:
    """The first ``cap`` decisions of a dataset as events, and one event with
    the counts of all of them where there are more.

    Decisions are costly, so one pass gives both: shares of a dataset are
    counted and ranked by themselves, and the first ``cap`` rows of each, the
    very first one with its share's counts, meet in the dataset's window.
    """
    cell = ("row_id", "column")
    is_ = lambda d: F.count_if(F.col("decision") == d)
    counts = {"n": F.count("*"), "a": is_("AUTO"), "e": is_("ESCALATE"), "b": is_("BLOCK")}
    share, whole = Window.partitionBy("dataset_id", "part"), Window.partitionBy("dataset_id")
    of_share = (
        decisions.select("dataset_id", "decision_id", "decision", *cell, "belief_error", "conflict_k",
                         F.pmod(F.xxhash64(*cell), F.lit(EVENT_PARTS)).alias("part"))
        .withColumns({"rank": F.row_number().over(share.orderBy(*cell)), **{k: e.over(share) for k, e in counts.items()}})
        .where(F.col("rank") <= max(cap, 1)))
    ranked = of_share.withColumns({
        "rank": F.row_number().over(whole.orderBy(*cell)),
        **{k: F.sum(F.when(F.col("rank") == 1, F.col(k))).over(whole) for k in counts}})
    batch = [
        event_id(F.lit("batch"), "dataset_id").alias("id"),
        F.lit("BATCH_DECISIONS").alias("event_type"), F.lit(actor).alias("actor"),
        F.col("dataset_id"), F.lit(None).cast("string").alias("decision_id"),
        F.create_map(
            F.lit("total_decisions"), F.col("n").cast("string"), F.lit("auto_count"), F.col("a").cast("string"),
            F.lit("escalate_count"), F.col("e").cast("string"), F.lit("block_count"), F.col("b").cast("string"),
        ).alias("details"),
        ts.alias("ts"),
    ]
    return ranked.where(F.col("rank") <= max(cap, 1)).select(F.inline(F.array_compact(F.array(
        F.when(F.col("rank") <= cap, F.struct(*_decision_event(ts, actor))),
        F.when((F.col("rank") == 1) & (F.col("n") > cap), F.struct(*batch))))))


def repair_events(changes: DataFrame, dataset_id: str, ts: Column,
                  actor: str = "system_autonomy_gate", event_type: str = "AUTO_REPAIR") -> DataFrame:
    """One event per changed cell."""
    return changes.select(
        event_id(F.lit(event_type), F.lit(dataset_id), "row_id", "column").alias("id"),
        F.lit(event_type).alias("event_type"), F.lit(actor).alias("actor"),
        F.lit(dataset_id).alias("dataset_id"),
        event_id(F.lit(dataset_id), "row_id", "column").alias("decision_id"),
        F.create_map(
            F.lit("row_id"), F.col("row_id").cast("string"), F.lit("column"), F.col("column"),
            F.lit("old_value"), F.col("old_value"), F.lit("new_value"), F.col("new_value"),
        ).alias("details"),
        ts.alias("ts"),
    )


def review_events(reviews: DataFrame) -> DataFrame:
    """One REVIEW event per submitted review."""
    return reviews.select(
        event_id(F.lit("review"), "review_id").alias("id"),
        F.lit("REVIEW").alias("event_type"), F.concat(F.lit("user:"), "reviewer").alias("actor"),
        F.lit(None).cast("string").alias("dataset_id"), "decision_id",
        F.create_map(F.lit("action"), F.col("action"), F.lit("comment"), F.col("comment")).alias("details"),
        "ts",
    )


def batch_key(events: DataFrame) -> str:
    """A name made of the ids of a batch, whatever their order."""
    total = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
    n, one, two = events.agg(F.count("*"), total, F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}-{one or 0}-{two or 0}"


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append a batch to the ledger; an error stops the caller before it commits.

    A batch lies under its own key, by default made of its ids. Appending it
    again, after a failure or by mistake, replaces it, so it counts once.
    """
    folder = f"{path.rstrip('/')}/batch={batch or batch_key(events)}"
    events.write.mode("overwrite").partitionBy("event_type").parquet(folder)


def query_events(ledger: DataFrame, dataset_id: str | None = None, event_type: str | None = None,
                 actor: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Matching events, newest first."""
    out = ledger
    for name, value in (("dataset_id", dataset_id), ("event_type", event_type), ("actor", actor)):
        if value:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.col("ts").desc(), "id").offset(offset).limit(limit)


def get_event(ledger: DataFrame, id_: str) -> DataFrame:
    return ledger.where(F.col("id") == id_)


def count_events(ledger: DataFrame, dataset_id: str | None = None) -> DataFrame:
    rows = ledger.where(F.col("dataset_id") == dataset_id) if dataset_id else ledger
    return rows.agg(F.count("*").alias("events"))


def timeline(ledger: DataFrame, dataset_id: str) -> DataFrame:
    """All events of a dataset, oldest first."""
    return ledger.where(F.col("dataset_id") == dataset_id).orderBy("ts", "id")


def numbered_timeline(ledger: DataFrame, dataset_id: str, folder: str) -> DataFrame:
    """The timeline with each event's ``place``, from 1.

    Tasks sort ranges of (ts, id) and count themselves, so that no task holds
    a whole dataset. The sorted events are written to ``folder``, shared by
    all executors.
    """
    events = ledger.where(F.col("dataset_id") == dataset_id)
    ranges = events.repartitionByRange("ts", "id").sortWithinPartitions("ts", "id")
    return number_rows(ranges, folder).withColumn("place", F.col("row_id") + 1).drop("row_id")


def leaf_hash(ts_format: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    """Digest of one event's fields as JSON: quoted, with nulls as such and microseconds."""
    fields = F.struct(
        "id", "event_type", "actor", "dataset_id", "decision_id",
        F.array_sort(F.map_entries("details")).alias("details"), F.date_format("ts", ts_format).alias("ts"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


# Most events of a block, and digests joined into one at the levels above.
BLOCK_EVENTS = 1000
FAN_OUT = 1000


def block_count(ledger: DataFrame, events_per_block: int = BLOCK_EVENTS) -> int:
    """Blocks that keep the expected block at the given size."""
    return max(1, -(-ledger.count() // events_per_block))


def block_roots(ledger: DataFrame, blocks: int) -> DataFrame:
    """One digest per block of events; ids spread evenly over the blocks."""
    block = F.pmod(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint"), F.lit(blocks))
    leaves = ledger.select(block.alias("block"), leaf_hash().alias("leaf"))
    return leaves.groupBy("block").agg(
        F.count("*").alias("events"),
        F.sha2(F.concat_ws("", F.array_sort(F.collect_list("leaf"))), 256).alias("block_root"))


def _in_order() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("block", "block_root")))
    return F.concat_ws("", F.transform(ordered, lambda b: b["block_root"]))


def batch_root(roots: DataFrame, blocks: int, previous: str = "") -> DataFrame:
    """Digest over all block roots, chained to the previous batch's digest.

    Many blocks are digested level by level, so that no task joins more than
    ``FAN_OUT`` digests.
    """
    while blocks > FAN_OUT:
        roots = roots.groupBy(F.floor(F.col("block") / FAN_OUT).alias("parent")).agg(
            F.sum("events").alias("events"), F.sha2(_in_order(), 256).alias("block_root")
        ).withColumnRenamed("parent", "block")
        blocks = -(-blocks // FAN_OUT)
    return roots.agg(
        F.sum("events").alias("events"),
        F.sha2(F.concat(F.lit(previous), _in_order()), 256).alias("batch_root"))


def _block(blocks: int) -> Column:
    return F.pmod(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint"), F.lit(blocks))


def hash_tree(ledger: DataFrame, blocks: int) -> DataFrame:
    """All digests on the way to the batch root: level, parent, node, digest, events.

    Level 0 holds the events (node: id, parent: block), level 1 the blocks, the
    levels above groups of ``FAN_OUT``. A node's digest is that of its children:
    events by digest, others by number. To be stored beside the ledger.
    """
    levels = [ledger.select(F.lit(0).alias("level"), _block(blocks).alias("parent"), F.col("id").alias("node"),
                            leaf_hash().alias("digest"), F.lit(1).cast("long").alias("events"))]
    rows, level = block_roots(ledger, blocks), 1
    while True:
        parent = F.floor(F.col("block") / FAN_OUT) if blocks > FAN_OUT else F.lit(0).cast("long")
        levels.append(rows.select(F.lit(level).alias("level"), parent.alias("parent"), F.col("block").cast("string").alias("node"),
                                  F.col("block_root").alias("digest"), "events"))
        if blocks <= FAN_OUT:
            return reduce(DataFrame.unionByName, levels)
        rows = rows.groupBy(F.floor(F.col("block") / FAN_OUT).alias("parent")).agg(
            F.sum("events").alias("events"), F.sha2(_in_order(), 256).alias("block_root")).withColumnRenamed("parent", "block")
        blocks, level = -(-blocks // FAN_OUT), level + 1


def inclusion_path(tree: DataFrame, id_: str) -> DataFrame:
    """What is needed to reach the root from one event: its siblings and those of each node above; ``own`` marks the way.

    At most a block's events and ``FAN_OUT`` digests a level. Empty if the event is not in the tree.
    """
    top = tree.agg(F.max("level")).first()[0] or 0
    way, parts = tree.where((F.col("level") == 0) & (F.col("node") == id_)), []
    for level in range(top + 1):
        mine = way.select("parent", F.col("node").alias("_own"))
        parts.append(tree.where(F.col("level") == level).join(mine, "parent").withColumn("own", F.col("node") == F.col("_own")).drop("_own"))
        above = way.select(F.col("parent").cast("string").alias("node"))
        way = tree.where(F.col("level") == level + 1).join(above, "node", "left_semi")
    return reduce(DataFrame.unionByName, parts)


def proof(path: DataFrame, leaf: str, previous: str = "") -> DataFrame:
    """One row: whether ``leaf`` is the path's event and each node holds its children, and the batch root that follows."""
    number = F.when(F.col("level") > 0, F.col("node").cast("long"))
    children = F.array_sort(F.collect_list(F.struct(number.alias("number"), "digest")))
    levels = path.groupBy("level").agg(
        F.concat_ws("", F.transform(children, lambda c: c["digest"])).alias("joined"),
        F.max(F.when(F.col("own"), F.col("digest"))).alias("own"))
    below = levels.select((F.col("level") + 1).alias("level"), F.sha2("joined", 256).alias("made"))
    held = levels.join(below, "level", "left").withColumn("holds", F.coalesce("made", F.lit(leaf)) == F.col("own"))
    return held.agg((F.count("*") > 1).alias("found"), F.coalesce(F.every("holds"), F.lit(False)).alias("valid"),
                    F.sha2(F.concat(F.lit(previous), F.max_by("joined", "level")), 256).alias("batch_root")).select(
        (F.col("found") & F.col("valid")).alias("valid"), "batch_root")


def altered_blocks(tree: DataFrame, ledger: DataFrame, blocks: int) -> DataFrame:
    """Blocks whose events are no longer those of the stored tree: block, events and digests then and now."""
    stored = tree.where("level = 1").select(F.col("node").cast("long").alias("block"), F.col("events").alias("events_stored"),
                                            F.col("digest").alias("digest_stored"))
    now = block_roots(ledger, blocks).withColumnsRenamed({"events": "events_now", "block_root": "digest_now"})
    return stored.join(now, "block", "full").where(~F.col("digest_stored").eqNullSafe(F.col("digest_now")))


def altered_events(tree: DataFrame, ledger: DataFrame, blocks: int) -> DataFrame:
    """Events added, lost or changed since the tree was stored: id, block, what happened. Only altered blocks are compared."""
    bad = altered_blocks(tree, ledger, blocks).select("block")
    stored = tree.where("level = 0").select(F.col("parent").alias("block"), F.col("node").alias("id"), F.col("digest").alias("then"))
    now = ledger.select(_block(blocks).alias("block"), "id", leaf_hash().alias("now"))
    both = stored.join(bad, "block", "left_semi").join(now.join(bad, "block", "left_semi"), ["block", "id"], "full")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "lost").otherwise("changed")
    return both.where(~F.col("then").eqNullSafe(F.col("now"))).select("id", "block", change.alias("change"))
