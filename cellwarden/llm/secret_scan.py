"""Secret scans: Boolean trigram queries against an inverted index, candidates verified by the rules' regexes.

Every regex is turned into an OR of ANDs of trigrams that each match must
contain (in lower case). The index holds, for those trigrams, the documents
that contain them; intersecting the lists of one AND gives the candidates of
a rule. A rule without mandatory trigrams scans all documents.

Everything on the corpus is DataFrame functions. The trigram queries are
derived on the driver from the fixed rule list, in size bounded by it.
"""

from __future__ import annotations

import re._constants as rx
import re._parser as rx_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwarden.llm.common import stored, text_key


@dataclass(frozen=True)
class Rule:
    """``regex`` proposes leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped."""
    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


# The rules in the order in which their spans are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9a-zA-Z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_ALL = frozenset([frozenset()])  # matches every document
_MOST = 64  # strings or ANDs carried on; beyond it a part counts as unknown


def _simpler(query: frozenset) -> frozenset:
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: frozenset, b: frozenset) -> frozenset:
    return _simpler(frozenset(x | y for x, y in product(a, b))) if len(a) * len(b) <= _MOST else a


def _of_strings(strings: set[str]) -> frozenset:
    return _simpler(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


def _known(node) -> set[str] | None:
    """The lower-case strings a part can match, if they are few."""
    op, arg = node
    if op is rx.LITERAL:
        return {chr(arg).lower()}
    if op is rx.IN and all(x[0] is rx.LITERAL for x in arg):
        return {chr(x[1]).lower() for x in arg}
    if op is rx.SUBPATTERN:
        return _known_all(arg[3])
    if op is rx.BRANCH:
        each = [_known_all(x) for x in arg[1]]
        return set().union(*each) if None not in each else None
    if op is rx.MAX_REPEAT and arg[1] <= 4:
        inner = _known_all(arg[2])
        if inner is not None:
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)}
    return None


def _known_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        strings = _known(node)
        if strings is None or len(out) * len(strings) > _MOST:
            return None
        out = {a + b for a, b in product(out, strings)}
    return out


def _query(nodes) -> frozenset:
    query, run = _ALL, {""}
    for node in nodes:
        strings = _known(node)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, run = _and(query, _of_strings(run)), strings or {""}
        if strings is None:
            op, arg = node
            if op is rx.SUBPATTERN:
                query = _and(query, _query(arg[3]))
            elif op is rx.BRANCH:
                query = _and(query, _simpler(frozenset().union(*(_query(x) for x in arg[1]))))
            elif op is rx.MAX_REPEAT and arg[0] > 0:
                query = _and(query, _query(arg[2]))
    return _and(query, _of_strings(run))


def trigram_query(regex: str) -> list[list[str]]:
    """An OR of ANDs of lower-case trigrams that hold for every text with a match; [[]] if none are mandatory."""
    return sorted(sorted(a) for a in _query(rx_parser.parse(regex)))


def _literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    each = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def trigram_postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The stored index (gram, doc_id, hash): which documents contain which of the trigrams, in any case."""
    low = docs.select("doc_id", text_key(F.col("text")).alias("hash"), F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return stored(low.select("doc_id", "hash", F.explode(has).alias("gram")), "trigrams")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, hash, rules): bit r is set if the document may match rule r by its trigrams."""
    queries = {r: trigram_query(rule.regex) for r, rule in enumerate(rules)}
    queries = {r: q for r, q in queries.items() if [] not in q}
    grams = sorted({g for q in queries.values() for a in q for g in a})
    spark = docs.sparkSession
    if not grams:
        return docs.select("doc_id", F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("rules")).limit(0)
    wanted = [(grams.index(g), r, k, 1 << i, (1 << len(a)) - 1)
              for r, q in queries.items() for k, a in enumerate(q) for i, g in enumerate(a)]
    table = _literal_table(spark, wanted, ["gram", "rule", "term", "bit", "full"])
    lists = trigram_postings(docs, grams).join(F.broadcast(table), "gram")  # broadcast: bounded by the rule list
    met = (lists.groupBy("doc_id", "hash", "rule", "term", "full").agg(F.bit_or(F.col("bit").cast("long")).alias("have"))
           .filter("have = full"))
    return met.groupBy("doc_id", "hash").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, hash, rule, start, end), each distinct span once; code points, end exclusive."""
    docs = docs.select("doc_id", text_key(F.col("text")).alias("hash"), "text")
    found = candidates(docs, rules).select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "rules")
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found["d"]) & (docs["hash"] == found["h"]), "left")

    def matches(r: int, rule: Rule) -> Column:
        regex, text = F.lit(rule.regex), F.col("text")
        if rule.group == 0 and is_run(rule.regex):
            # Runs of one class: those long enough, found directly.
            regex = F.lit(rule.regex[:-1] + "{%d,}" % rule.least)
        full = [] in trigram_query(rule.regex)
        active = text.isNotNull() if full else F.col("rules").bitwiseAND(F.lit(1 << r)) != 0
        lengths = lambda c: F.transform(c, F.length)
        return F.when(active, F.struct(
            F.lit(r).alias("rule"), lengths(F.split(text, regex, -1)).alias("gaps"),
            lengths(F.regexp_extract_all(text, regex, F.lit(0))).alias("sizes"),
            lengths(F.regexp_extract_all(text, regex, F.lit(rule.group))).alias("parts")))

    each = F.filter(F.array(*[matches(r, x) for r, x in enumerate(rules)]), lambda m: F.size(m["sizes"]) > 0)
    each = rows.select("doc_id", "hash", F.explode(each).alias("m")).select("doc_id", "hash", "m.*")
    one = each.dropDuplicates(["doc_id", "hash", "rule"]).select(
        "doc_id", "hash", "rule", F.posexplode(F.arrays_zip(F.expr("slice(gaps, 1, size(sizes))").alias("gaps"),
                                                            "sizes", "parts")).alias("i", "m"))
    one = one.select("doc_id", "hash", "rule", "i", F.col("m.gaps").alias("gap"), F.col("m.sizes").alias("size"),
                     F.col("m.parts").alias("part"))
    line = Window.partitionBy("doc_id", "hash", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(line)
    least = F.get(F.array(*[F.lit(x.least) for x in rules]), F.col("rule"))
    return (one.withColumn("end", end).filter(F.col("part") >= least)
            .select("doc_id", "hash", "rule", (F.col("end") - F.col("size")).alias("start"), "end"))


def is_run(regex: str) -> bool:
    """Whether a regex is one class, repeated with a final plus: its matches are maximal runs."""
    return regex.startswith("[") and regex.endswith("]+") and regex.count("[") == 1 and "\\" not in regex


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, hash, n_<kind> for the base rules, base_spans, all_spans (``kind:start:end``, comma-joined) per row.

    * A null or empty text has no spans; its strings are empty.
    * Equal starts are listed in the order of the rules.
    * Repeated rows are answered alike, each with its own result row.
    * A null doc_id is an id like others; an empty table gives an empty
      result; extra columns are ignored; texts are scanned whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = F.array(*[F.lit(x.kind) for x in rules])
    ordered = F.sort_array(F.collect_list(F.struct("start", "rule", "end")))
    by_doc = find_spans(docs, rules).groupBy("doc_id", "hash").agg(ordered.alias("spans"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "spans")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("hash"))
    out = rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["d"]) & (rows["hash"] == by_doc["h"]), "left")
    base = [r for r, x in enumerate(rules) if x.base]
    of_rule = lambda rs: F.filter("spans", lambda s: s["rule"].isin(rs))
    text = lambda c: F.coalesce(F.array_join(F.transform(
        c, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
    counts = [F.coalesce(F.size(of_rule([r])), F.lit(0)).cast("long").alias(f"n_{rules[r].kind}") for r in base]
    counts = [F.greatest(c, F.lit(0).cast("long")).alias(f"n_{rules[r].kind}") for c, r in zip(counts, base, strict=True)]
    return out.select("doc_id", "hash", *counts, text(of_rule(base)).alias("base_spans"), text(F.col("spans")).alias("all_spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text and any others) with every span replaced by ``mark``; overlapping spans become one mark.

    ``n_chars``, if present, follows the text. Rows without spans are returned as they are.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = find_spans(plain, rules)
    line = Window.partitionBy("doc_id", "hash").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("start") >= F.coalesce("reach", F.lit(0))).cast("int")).over(
        line.rowsBetween(Window.unboundedPreceding, 0))
    merged = (spans.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "hash", "island")
              .agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("doc_id", "hash")
              .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("k_spans"))
              .select(F.col("doc_id").alias("k_id"), F.col("hash").alias("k_hash"), "k_spans"))
    out = docs.join(merged, docs["doc_id"].eqNullSafe(merged["k_id"]) & (text_key(docs["text"]) == merged["k_hash"]), "left")
    text, spans = docs["text"], merged["k_spans"]  # of their own tables: ``docs`` may have columns of these names
    starts = F.concat(spans["start"], F.array(F.length(text).cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), spans["end"])
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    fresh = F.when(spans.isNull(), text).otherwise(F.array_join(pieces, mark))
    keep = [(fresh if c == "text" else
             F.when(spans.isNull(), docs[c]).otherwise(F.length(fresh)).cast(docs.schema[c].dataType)
             if c == "n_chars" else docs[c]).alias(c) for c in docs.columns]
    return out.select(*keep)
