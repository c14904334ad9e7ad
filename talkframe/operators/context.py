"""What a message is read against: the turns before it, salient older turns, and its speaker's recent state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.lookup import mapped
from talkframe.operators import sequence as seq

CONV = "conversation_id"
RECENT_SEPARATOR = " || "
OLDER_SEPARATOR = " :: "


def response_gap(df: DataFrame, name: str = "gap_hours") -> DataFrame:
    """Hours since the previous message of the conversation, between 0 and 24; 0 when either time is unknown."""
    spread = seq.blocked(seq.with_positions(df), before=1)
    spread = spread.withColumn("prev_ts", F.lag("ts").over(seq.block_window()))
    return seq.owned(spread.withColumn(name, gap_hours())).drop("prev_ts")


def gap_hours() -> Column:
    seconds = F.expr("timestampdiff(MICROSECOND, prev_ts, ts)") / F.lit(1e6)
    hours = F.least(F.greatest(seconds, F.lit(0.0)), F.lit(86400.0)) / 3600
    return F.when(seconds.isNull(), F.lit(0.0)).otherwise(hours)


def _insert(df: DataFrame, item: str, earlier: Window, k: int) -> DataFrame:
    """The ``k`` largest of ``item`` before each row (``_p0.._pk``) and up to it (``_m0.._mk``).

    Inserting into a sorted list pushes the smaller value down one slot, so slot j is the running maximum of the
    values slot j-1 lets go: plain running maxima, constant state.
    """
    current = item
    for j in range(k):
        df = df.withColumn(f"_p{j}", F.max(current).over(earlier))
        x, p = F.col(current), F.col(f"_p{j}")
        df = df.withColumns(
            {f"_m{j}": F.greatest(x, p), f"_d{j}": F.when(x.isNotNull() & p.isNotNull(), F.least(x, p))}
        )
        current = f"_d{j}"
    return df.drop(*[f"_d{j}" for j in range(k)])


def running_top(df: DataFrame, item: str, k: int, name: str) -> DataFrame:
    """Array with the ``k`` largest ``item`` structs up to each row, largest first. ``df`` is blocked and ordered by pos."""
    past = Window.partitionBy(CONV, seq.BLK).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    local = _insert(df, item, past, k)
    local = local.withColumn(
        "_top", F.filter(F.array(*[f"_m{j}" for j in range(k)]), lambda s: s.isNotNull())
    ).drop(*[f"_{a}{j}" for a in "pm" for j in range(k)])
    best = local.select(CONV, seq.BLK, "pos", "_top").groupBy(CONV, seq.BLK).agg(
        F.max(F.struct("pos", "_top"))["_top"].alias("_top")
    )
    items = best.select(CONV, seq.BLK, F.posexplode_outer("_top").alias("_i", "_x"))
    before = Window.partitionBy(CONV).orderBy(seq.BLK, "_i").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        _insert(items, "_x", before, k)
        .filter(F.coalesce("_i", F.lit(0)) == 0)
        .select(CONV, seq.BLK, F.filter(F.array(*[f"_p{j}" for j in range(k)]), lambda s: s.isNotNull()).alias("_carry"))
    )
    merged = F.slice(F.sort_array(F.concat("_top", "_carry"), asc=False), 1, k)
    return local.join(carry, [CONV, seq.BLK]).withColumn(name, merged).drop("_top", "_carry")


def context_window(df: DataFrame, k: int = 4, picks: int = 3, previous: tuple = ()) -> DataFrame:
    """Add ``recent`` (the ``k`` previous texts), ``older`` (most tense earlier texts) and the joined ``context_text``.

    Columns named in ``previous`` also get a ``prev_<c>`` with their value on the previous message, in the same pass.
    """
    spread = seq.blocked(seq.with_positions(df), before=k + 1)
    w = seq.block_window()
    item = F.struct(F.abs(F.coalesce("tension", F.lit(0.0))).alias("heat"), (-F.col("pos")).alias("np"), F.col("text").alias("said"))
    spread = spread.withColumns(
        {
            "_recent": F.collect_list("text").over(w.rowsBetween(-k, -1)),
            "_left": F.lag(item, k + 1).over(w),
            **{f"prev_{c}": F.lag(c).over(w) for c in previous},
        }
    )
    rows = running_top(seq.owned(spread, keep_block=True), "_left", picks, "_older")
    older = F.array_join(F.transform("_older", lambda s: s["said"]), OLDER_SEPARATOR)
    recent = F.array_join("_recent", RECENT_SEPARATOR)
    out = rows.withColumns({"recent": recent, "older": older})
    joined = F.when(F.size("_older") > 0, F.concat(F.col("older"), F.lit(RECENT_SEPARATOR), F.col("recent"))).otherwise(
        F.col("recent")
    )
    return out.withColumn("context_text", joined).drop("_recent", "_left", "_older", seq.BLK)


def pooled(df: DataFrame, vector: str = "embedding", k: int = 4, name: str = "context_vector") -> DataFrame:
    """Mean of the ``k`` previous messages' vectors, per component; zeros where there is none. Vectors must be of one length."""
    spread = seq.blocked(seq.with_positions(df), before=k)
    before = F.collect_list(vector).over(seq.block_window().rowsBetween(-k, -1))
    rows = seq.owned(spread.withColumn("_before", before))
    zero = F.transform(vector, lambda x: F.lit(0.0))
    total = F.aggregate("_before", zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return rows.withColumn(name, F.transform(total, lambda x: x / F.greatest(F.size("_before"), F.lit(1)))).drop("_before")


def extractive_summary(df: DataFrame, max_chars: int = 600, size: int = 10) -> DataFrame:
    """The most tense text of every ``size`` messages, in order, joined and cut to ``max_chars`` characters.

    Every pick adds at least its separator, so picks beyond number ``max_chars`` lie outside the cut.
    """
    rows = seq.with_positions(df)
    rows = rows.withColumn("part", F.expr(f"pos div {size}")).filter(F.col("part") <= max_chars)
    best = rows.groupBy(CONV, "part").agg(
        F.max(
            F.struct(F.abs(F.coalesce("tension", F.lit(0.0))).alias("heat"), (-F.col("pos")).alias("np"),
                     F.substring("text", 1, max_chars).alias("said"))
        ).alias("best")
    )
    picks = best.groupBy(CONV).agg(F.sort_array(F.collect_list(F.struct("part", "best.said"))).alias("a"))
    text = F.array_join(F.transform("a", lambda s: s["said"]), " ")
    return picks.select(CONV, F.substring(text, 1, max_chars).alias("summary"))


def speaker_memory(df: DataFrame, window: int = 5, short: str = "is_short") -> DataFrame:
    """Each speaker's state just before the message: last labels, mean of the last tensions, run of short messages."""
    keys = [CONV, "speaker_id"]
    rows = seq.with_positions(df)
    rows = seq.number(rows, keys, ["pos"], F.expr(f"pos div {seq.block_rows(df)}"), "spos")
    spread = seq.blocked(rows, before=window, pos="spos")
    w = seq.block_window(keys, "spos")
    spread = spread.select(
        "*",
        *[F.lag(c).over(w).alias(f"last_{c}") for c in ("emotion", "tone", "sentiment")],
        F.avg("tension").over(w.rowsBetween(-window, -1)).alias("recent_tension"),
    )
    own = seq.owned(spread, keep_block=True)
    talked = {"_broke": ("max", F.when(F.col(short) == 0, F.col("spos")))}
    own = seq.prefix(own, talked, keys, ["spos"], inclusive=False)
    streak = F.col("spos") - 1 - F.coalesce("_broke", F.lit(-1))
    return own.withColumn("short_streak", streak.cast("long")).drop("_broke", "spos", seq.BLK)


def memory_vector(df: DataFrame) -> DataFrame:
    """Five memory numbers and five products with the message's own behaviour, as columns ``m0 .. m9``."""
    valence = mapped(F.col("last_emotion"), fixed.VALENCE, 0.0)
    warmth = mapped(F.col("last_tone"), fixed.WARMTH, 0.0)
    heat = F.coalesce("recent_tension", F.lit(0.0)) / 100
    negative = F.col("negative_hits") / 3
    values: list[Column] = [
        mapped(F.col("last_emotion"), fixed.AROUSAL, 0.0),
        valence,
        warmth,
        mapped(F.col("last_sentiment"), fixed.SENTIMENT_CODE, 0.0),
        heat,
        valence * negative,
        warmth * (F.col("exclamations") / 3),
        heat * negative,
        F.col("is_short") * (F.lit(1.0) - (warmth + 1.0) / 2),
        F.col("gap_hours") / 24 * heat,
    ]
    return df.withColumns({f"m{i}": v for i, v in enumerate(values)})
