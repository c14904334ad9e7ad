"""Topic segments: by silence where messages carry times, else by a dip in word overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions.text import slang_tokens
from talkframe.operators import sequence as seq
from talkframe.session import settle

CONV = "conversation_id"


def time_segments(df: DataFrame, gap_minutes: float = 90.0) -> DataFrame:
    """Add ``segment_id``: a new segment starts after more than ``gap_minutes`` since the last known time."""
    rows = seq.blocked(seq.with_positions(df))
    known = F.when(F.col("ts").isNotNull(), F.struct("pos", "ts"))
    rows = seq.prefix(rows, {"_last": ("max", known)}, inclusive=False)
    silence = F.expr("timestampdiff(MICROSECOND, _last.ts, ts)") > F.lit(int(gap_minutes * 60_000_000))
    rows = rows.withColumn("_cut", F.coalesce(silence, F.lit(False)).cast("int")).drop("_last")
    return seq.prefix(rows, {"segment_id": ("sum", F.col("_cut"))}).drop("_cut", seq.BLK)


def cohesion_cuts(df: DataFrame, window: int = 5, drop: float = 0.28, apart: int = 3, shortest: int = 6) -> DataFrame:
    """Positions where the word overlap of the messages before and after dips below that of the neighbouring places."""
    rows = seq.with_positions(df).select(CONV, "pos", F.array_distinct(slang_tokens(F.col("text"))).alias("tok"))
    spread = seq.blocked(rows, before=window, after=window - 1)
    w = seq.block_window()
    spread = spread.select(
        "*",
        F.collect_list("tok").over(w.rowsBetween(-window, -1)).alias("a"),
        F.collect_list("tok").over(w.rowsBetween(0, window - 1)).alias("b"),
    )
    sides = seq.owned(spread, keep_block=True).select(
        CONV, "pos", seq.BLK,
        F.array_distinct(F.flatten("a")).alias("a"), F.array_distinct(F.flatten("b")).alias("b"),
    )
    sides = seq.attach(sides, {"n": ("count", F.lit(1))})
    overlap = F.size(F.array_intersect("a", "b")) / F.sqrt((F.size("a") * F.size("b")).cast("double"))
    places = sides.filter(
        (F.col("n") >= shortest) & (F.col("pos") >= 1) & (F.size("a") > 0) & (F.size("b") > 0)
    ).select(CONV, "pos", overlap.alias("cos"))
    places = seq.number(settle(places, "overlap"), [CONV], ["pos"], F.expr(f"pos div {seq.block_rows(df)}"), "place")
    near = seq.blocked(places, before=2, after=2, pos="place")
    w = seq.block_window(pos="place")
    total = F.lit(0.0)
    count = F.lit(0)
    for frame in (w.rowsBetween(-2, -1), w.rowsBetween(1, 2)):
        total = total + F.coalesce(F.sum("cos").over(frame), F.lit(0.0))
        count = count + F.count("cos").over(frame)
    near = near.select("*", total.alias("total"), count.alias("count"))
    hits = seq.owned(near).filter(
        (F.col("count") >= 2) & (F.round(F.col("total") / F.col("count") - F.col("cos"), 9) > drop)
    )
    hits = settle(hits.select(CONV, "pos", F.lit(0.0).alias("level")), "dips")
    return seq.merge_close(hits, "level", reach=apart - 1)


def cohesion_segments(df: DataFrame, **options: float) -> DataFrame:
    """Add ``segment_id`` from the overlap dips."""
    rows = seq.with_positions(df)
    cuts = cohesion_cuts(rows, **options).withColumn("_cut", F.lit(1))
    marked = rows.join(cuts, [CONV, "pos"], "left")
    return seq.prefix(seq.blocked(marked), {"segment_id": ("sum", F.coalesce("_cut", F.lit(0)))}).drop("_cut", seq.BLK)


def topic_segments(df: DataFrame) -> DataFrame:
    """Segment list per conversation; the first message decides which method applies."""
    rows = seq.with_positions(df).select(CONV, "pos", "message_id", "text", "ts")
    first = rows.filter(F.col("pos") == 0).select(CONV, F.col("ts").isNotNull().alias("timed"))
    rows = seq.attach_table(seq.blocked(rows), first).drop(seq.BLK)
    by_time = time_segments(rows.filter("timed")).withColumn("method", F.lit("time-gap"))
    by_words = cohesion_segments(rows.filter("not timed")).withColumn("method", F.lit("cohesion"))
    return segment_list(by_time.unionByName(by_words))


def segment_list(df: DataFrame) -> DataFrame:
    """One row per segment: first and last message, number of messages, method."""
    return df.groupBy(CONV, "segment_id", "method").agg(
        F.min(F.struct("pos", "message_id"))["message_id"].alias("start"),
        F.max(F.struct("pos", "message_id"))["message_id"].alias("end"),
        F.count(F.lit(1)).alias("messages_analyzed"),
    )
