"""Interaction audit of filters: what each filter removes after every possible set of earlier ones, by joins on failing-id tables.

One id table per filter holds the rows that fail it. Survivors of every set of filters are one relation (before, id), built filter by
filter: rows that a left-anti join with the filter's ids keeps are added under the set enlarged by it. A left-semi join of survivors
with a filter's ids gives what the filter removes there; a left-anti join of its failing ids with the survivors gives those that were
removed earlier. Orders only choose among these sets: the prefix of a step decides its counts.

All joins are equi-joins on row ids, which are spread evenly whatever the parts; parts and label flags travel with the id, so a part with
a third of all rows is only ever counted, map-side first. Every relation is written to the shared folder.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import settle, with_row_id

MOST_FILTERS = 7  # 2^n relations and n! orders
WORDS = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails")


def measured(docs: DataFrame) -> DataFrame:
    """rid, doc_id, part and the failures a, b, c, d of each row, with a digest of its text. A null text is the empty text."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    out = out.withColumns({"_w": F.regexp_extract_all("_t", F.lit(WORDS), F.lit(0))})
    n, distinct = F.size("_w"), F.size(F.array_distinct("_w"))
    capitals = F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return with_row_id(out.select(
        "doc_id", "part", (n < 100).alias("a"), (100 * distinct.cast("long") < 80 * n.cast("long")).alias("b"),
        (100 * capitals.cast("long") > 10 * F.length("_t").cast("long")).alias("c"), F.col("_t").rlike("[#$%&*|]").alias("d"),
        F.unhex(F.sha2("_t", 256)).alias("text_key")))


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """One settled (rid) table per filter A to E of ``measured`` rows.

    E fails where a smaller doc_id has the same text: all but the smallest, which a left-anti join on (text, doc_id) takes out. A null
    doc_id is neither smaller nor larger than another and never fails E; rows that repeat the smallest id do not fail it either.
    """
    first = rows.filter(F.col("doc_id").isNotNull()).groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    later = rows.filter(F.col("doc_id").isNotNull()).join(first, ["text_key", "doc_id"], "left_anti").select("rid")
    tables = {f.upper(): rows.filter(f).select("rid") for f in "abcd"} | {"E": later}
    return {f: settle(t, f"fails-{f}") for f, t in tables.items()}


def survivors(rows: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """(before, rid, and the columns of ``rows``): the rows left after each set of filters; bit i of ``before`` is the i-th filter."""
    out = rows.withColumn("before", F.lit(0))
    for i, ids in enumerate(fails.values()):
        passed = out.join(ids, "rid", "left_anti").withColumn("before", F.col("before") + (1 << i))
        out = settle(out.unionByName(passed), "survivors")
    return out


def audit(rows: DataFrame, fails: dict[str, DataFrame], losses: tuple[str, ...] = ()) -> DataFrame:
    """Per part, set of earlier filters (``before``, a bit set) and next filter: kept, removed, redundant, unique_fails, and the removed
    rows of which each boolean column of ``losses`` holds. Zeros included.

    ``rows``: rid (unique), part (not null) and the ``losses``. ``fails``: up to ``MOST_FILTERS`` filters, each a table of distinct rid.
    """
    names = list(fails)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: every set of them is audited")
    full = (1 << len(names)) - 1
    left = survivors(rows.select("rid", "part", *losses), fails)
    kept = left.groupBy("part", "before").agg(F.count("*").alias("kept"))
    found = None
    for i, (name, ids) in enumerate(fails.items()):
        sets = [s for s in range(full + 1) if not s >> i & 1]
        removed = left.filter(F.col("before").isin(sets)).join(ids, "rid", "left_semi")
        earlier = rows.join(ids, "rid", "left_semi").select("rid", "part", F.explode(F.array(*map(F.lit, sets))).alias("before"))
        earlier = earlier.join(left.select("rid", "before"), ["rid", "before"], "left_anti")
        here = removed.select("part", "before", F.lit(1).alias("_r"), *losses)
        gone = earlier.select("part", "before", F.lit(0).alias("_r"), *[F.lit(False).alias(c) for c in losses])
        both = here.union(gone).select(F.lit(name).alias("filter"), "*")
        found = both if found is None else found.union(both)
    counted = found.groupBy("part", "before", "filter").agg(
        F.sum("_r").alias("removed"), F.sum(1 - F.col("_r")).alias("redundant"),
        *[F.sum(F.col(c).cast("int")).alias(c) for c in losses])
    bit = F.create_map(*[x for i, f in enumerate(names) for x in (F.lit(f), F.lit(1 << i))])
    frame = (
        rows.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, names))).alias("filter"))
        .select("part", "filter", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("before"), bit[F.col("filter")].alias("bit"))
        .filter(F.col("before").bitwiseAND(F.col("bit")) == 0)
    )
    after = kept.select("part", F.col("before").alias("after"), "kept")
    alone = counted.withColumn("_bit", bit[F.col("filter")]).filter(F.col("before") + F.col("_bit") == full)
    alone = alone.select("part", "filter", F.col("removed").alias("unique_fails"))
    out = frame.withColumn("after", F.col("before") + F.col("bit")).join(after, ["part", "after"], "left")
    out = out.join(counted, ["part", "before", "filter"], "left").join(alone, ["part", "filter"], "left")
    return out.select("part", "before", "filter", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTS, *losses)])


def by_order(audited: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of ``audit`` and ``shapley``: the removals of the step's filter,
    summed over all orders."""
    spark, n = audited.sparkSession, len(names)
    bits = {f: 1 << i for i, f in enumerate(names)}
    steps = [("".join(order), k + 1, f, sum(bits[x] for x in order[:k])) for order in permutations(names) for k, f in enumerate(order)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    share = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    shapley = audited.groupBy("part", "filter").agg(F.sum(F.col("removed") * share).cast("long").alias("shapley"))
    return audited.join(shapley, ["part", "filter"]).join(orders, ["before", "filter"]).drop("before", "filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the five filters A to E.

    A row counts as good or toxic if any label row of its doc_id says so; a null doc_id has no labels. Repeated rows are counted each.
    A null lang is the part ''. Texts are read whole. An empty table gives no rows. Only doc_id, lang and text are read, so other columns
    cannot clash. Runs jobs while it is built.
    """
    rows = settle(measured(docs), "measured")
    fails = failing_ids(rows)
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    flagged = rows.select("rid", "doc_id", "part").join(known, "doc_id", "left").select(
        "rid", "part", (F.coalesce("g", F.lit(0)) == 1).alias("good_lost"), (F.coalesce("x", F.lit(0)) == 1).alias("toxic_lost"))
    audited = settle(audit(settle(flagged, "flagged"), fails, ("good_lost", "toxic_lost")), "audit")
    return by_order(audited, "".join(fails))
