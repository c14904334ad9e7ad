"""Even shards by balanced label propagation: documents move to the shard most of their linked documents are in, under quotas.

Documents with equal texts are linked; a group larger than half a shard is split into parts of that size first. Shards are labels.
Large parts (a 64th of a shard or more, so a bounded number) start whole, largest first, in the fullest shard that has room for them.
The rows of all others, and of large parts that fit nowhere, start in one line over the room left, part after part, so that a shard's
end cuts one part at most. From there labels are propagated in rounds of joins until no move admitted by the quotas cuts fewer pairs
(``propagate``). Unlinked documents cut no edge whatever their shard, so they are dealt last and fill every shard to its exact quota:
``law`` is ``rows``, counts differ by one at most.

Only built-in functions and joins are used, and texts are read once, for their size and digests. Numbers in the line and inside a
shard come from per-bucket counts, so neither is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import settle, with_row_id
from talkframe.operators.sequence import number

SHARDS = 40
LARGE = 64  # parts of this fraction of a shard are placed one by one
BUCKET_ROWS = 50_000  # rows numbered together


def start_labels(linked: DataFrame, quota: list[int]) -> DataFrame:
    """``linked`` (rid, grp, part, ...; settled) with a first ``shard``: parts whole where they fit, the others in one line over the room left,
    which cuts fewer of them than there are shards. No shard has more rows than its quota."""
    keys, shards = ["grp", "part"], range(len(quota))
    parts = settle(linked.groupBy(*keys).agg(F.count("*").alias("n")), "parts")
    room, starts, split = list(quota), [], 0
    large = parts.filter(F.col("n") >= max(2, -(-quota[0] // LARGE))).collect()  # at most LARGE per shard
    for p in sorted(large, key=lambda p: (-p["n"], p["grp"], p["part"])):
        at = min((s for s in shards if room[s] >= p["n"]), key=lambda s: (room[s], s), default=None)
        if at is not None:
            room[at] -= p["n"]
        starts.append((p["grp"], p["part"], at, None if at is not None else split))
        split += at is None
    marked = linked.join(_small(linked, starts, "shard int, turn int"), keys, "left")
    whole = marked.filter("shard is not null").drop("turn")

    order = sorted(shards, key=lambda s: (-room[s], s))
    ends = [sum(room[s] for s in order[:i + 1]) for i in shards]
    each, fine = (max(1, -(-n // BUCKET_ROWS)) for n in (quota[0], sum(quota)))
    bucket = F.when(F.col("turn").isNotNull(), F.col("turn") * F.lit(each) + F.pmod(F.xxhash64("rid", F.lit("line")), F.lit(each)))
    bucket = bucket.otherwise(F.lit(split * each) + F.pmod(F.xxhash64("grp", "part"), F.lit(fine))).cast("long")
    line = number(marked.filter("shard is null").withColumn("_b", bucket), [], ["_b", *keys, "rid"], F.col("_b"), "pos")
    line = settle(line.withColumn("shard", _at(order, _place(ends))).drop("_b", "pos", "turn"), "line")

    return settle(whole.unionByName(line), "start")


def propagate(placed: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """``placed`` (grp, shard, ...; settled) after balanced label propagation, and the cut pairs before every round and at the end.

    In a round every document looks at its group's labels and wants the one most of its neighbours have (ties to the smaller shard), if that
    is not its own. Those of one group and shard want the same and go together. For each shard the comers are admitted, fewest first, while
    their prefix sum fits its room; what leaves makes room for the next round. A move joins the larger side, so every admitted one cuts
    fewer pairs; the rounds end when none is admitted. Groups in one place never enter the rounds. Only one row per shard and the cut
    counts reach the driver.
    """
    start = settle(placed.groupBy("grp", "shard").agg(F.count("*").alias("n")), "cells")
    load = dict(start.groupBy("shard").agg(F.sum("n")).collect())
    open_groups = settle(start.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 1").select("grp"), "open")
    loose = settle(placed.join(open_groups, "grp", "left_semi"), "loose")
    cuts = []
    while True:
        cells = settle(loose.groupBy("grp", "shard").agg(F.count("*").alias("n")), "cells")
        pairs = cells.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
        cuts.append(int(pairs.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("q")).cast("decimal(38,0)")), F.lit(0))).first()[0]) // 2)
        best = cells.groupBy("grp").agg(F.max(F.struct("n", (-F.col("shard")).alias("s")))["s"].alias("s")).select("grp", (-F.col("s")).alias("target"))
        comers = cells.join(best, "grp").filter("shard <> target")
        room = F.get(F.array(*[F.lit(q - load.get(s, 0)).cast("long") for s, q in enumerate(quota)]), F.col("target"))
        upto = F.sum("n").over(Window.partitionBy("target").orderBy("n", "grp", "shard"))
        admitted = settle(comers.withColumn("_upto", upto).filter(F.col("_upto") <= room).select("grp", "shard", "target", "n"), "moves")
        moved = admitted.select(F.col("target").alias("s"), "n").union(admitted.select("shard", -F.col("n"))).groupBy("s").agg(F.sum("n")).collect()
        if not moved:
            break
        for s, n in moved:  # one row per shard
            load[s] = load.get(s, 0) + n
        step = loose.join(admitted.drop("n"), ["grp", "shard"], "left").withColumn("shard", F.coalesce("target", "shard")).drop("target")
        loose = settle(step.select(placed.columns), "loose")
    return placed.join(open_groups, "grp", "left_anti").select(placed.columns).unionByName(loose), cuts


def _small(like: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """A table of few parts, sent to every task."""
    return F.broadcast(like.sparkSession.createDataFrame(rows, f"grp string, part int, {columns}"))


def _place(ends: list[int]) -> Column:
    """How many of ``ends`` lie at or before ``pos``."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("pos")))


def _at(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _numbered(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """0-based ``pos`` per key. Rows are ordered by a hash of their own."""
    fine = max(1, -(-rows // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(F.lit("slot"), "rid"), F.lit(fine))
    return number(df.withColumn("_b", bucket), keys, ["_b", "rid"], F.col("_b"), "pos").drop("_b")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard, slot (gapless from 0), grown_shard (null).

    A null text has size 16 and crc 0 and is linked with nothing; empty texts are equal texts. Repeated rows are documents of their
    own. Shards may stay empty when there are fewer documents than shards; an empty table gives an empty result. Only ``doc_id``
    and ``text`` are read. Runs jobs while it is built.
    """
    base = with_row_id(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.md5("text").alias("grp")))
    base = settle(base, "shard_rows")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    part_rows = max(1, quota[0] // 2)
    # settled, so that the joins deal both sides anew and adaptive execution can split a large group
    groups = settle(base.filter("grp is not null").groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    linked = base.join(groups, "grp").withColumn(
        "part", F.pmod(F.xxhash64("rid", F.lit("part")), F.ceil(F.col("n") / F.lit(part_rows))).cast("int")).drop("n")
    placed, _ = propagate(start_labels(settle(linked, "linked"), quota), quota)
    placed = settle(placed.drop("grp", "part"), "placed")
    held = dict(placed.groupBy("shard").count().collect())  # one row per shard
    pool = base.join(groups, "grp", "left_anti").drop("grp")
    upto, free = [], 0
    for s in range(shards):
        free += quota[s] - held.get(s, 0)
        upto.append(free)
    dealt = _numbered(pool, [], total).withColumn("shard", _place(upto).cast("int"))
    columns = ["rid", "doc_id", "size", "text_crc32", "shard"]
    final = settle(placed.select(columns).unionByName(dealt.select(columns)), "shards")
    return _numbered(final, ["shard"], quota[0] if quota else 0).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("pos").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
