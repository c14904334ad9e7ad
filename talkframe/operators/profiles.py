"""Aggregates per speaker and per conversation. Every one combines map-side, so a large key costs no more than others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.operators import sequence as seq
from talkframe.operators import temporal

CONV = "conversation_id"


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def speaker_profiles(df: DataFrame, sarcasm: str = "p", pa: str = "pa_p") -> DataFrame:
    """How each speaker of a conversation talks. Label shares are in ``label_shares``."""
    return df.groupBy(CONV, "speaker_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.avg("tension").alias("avg_tension"),
        F.max("tension").alias("max_tension"),
        share(F.col(sarcasm) >= 0.5).alias("sarcastic_share"),
        share(F.col(pa) >= 0.5).alias("passive_aggressive_share"),
        share(F.col("tension") >= fixed.ESCALATION_TENSION).alias("high_tension_share"),
    )


def label_shares(df: DataFrame, keys: list[str], limits: dict[str, int]) -> DataFrame:
    """Top labels per group and label kind with counts and shares; ties go to the label that sorts first.

    ``limits`` maps a label column to how many labels to keep.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in limits]))
    counts = df.select(*keys, kinds.alias("_l")).groupBy(*keys, "_l.kind", "_l.label").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per known label and group from here on.
    whole = seq.Window.partitionBy(*keys, "kind")
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
    ranked = seq.top_k(counts, [*keys, "kind"], [F.col("n").desc(), F.col("label")], max(limits.values()))
    keep = F.lit(False)
    for kind, k in limits.items():
        keep = keep | ((F.col("kind") == kind) & (F.col("rank") <= k))
    return ranked.filter(keep)


def _top_lists(shares: DataFrame) -> DataFrame:
    """``top_emotions`` and ``top_tones`` per conversation: (label, n), most frequent first. A few entries each."""
    def listed(kind: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "label", "n"))))
        return F.transform(rows, lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n")))

    return shares.groupBy(CONV).agg(listed("emotion").alias("top_emotions"), listed("tone").alias("top_tones"))


def conversation_summary(df: DataFrame, sarcasm: str = "p", irony: str = "irony_p", pa: str = "pa_p", emotions: int = 3, tones: int = 6) -> DataFrame:
    """Size, speakers, most frequent emotions and tones, sentiment counts, mean hidden-signal levels, tension and trajectory."""
    speakers = df.groupBy(CONV, "speaker_id").agg(F.lit(1).alias("x")).groupBy(CONV).agg(F.count("x").alias("n_speakers"))
    top = _top_lists(label_shares(df, [CONV], {"emotion": emotions, "tone": tones})).withColumn("dominant_emotion", F.get("top_emotions", F.lit(0))["label"])
    base = df.groupBy(CONV).agg(
        F.count(F.lit(1)).alias("n_messages"),
        *[F.count(F.when(F.col("sentiment") == s, 1)).alias(f"n_{s}") for s in fixed.SENTIMENTS],
        F.avg(sarcasm).alias("sarcasm_level"),
        F.avg(irony).alias("irony_level"),
        F.avg(pa).alias("passive_aggression_level"),
        F.avg("tension").alias("mean_tension"),
        F.max("tension").alias("peak_tension"),
    )
    traj = temporal.trajectory(df).select(CONV, "trajectory")
    return base.join(speakers, CONV).join(top, CONV).join(traj, CONV)


def conversation_block(df: DataFrame) -> DataFrame:
    """Identity of a conversation: platform and time of the first message, time of the last, counts, and the sorted speakers."""
    at = F.struct("message_id", "platform", "ts")
    ends = df.groupBy(CONV).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("message_count")
    )
    speakers = df.select(CONV, "speaker_id").distinct().groupBy(CONV).agg(
        F.count("*").alias("n_speakers"), F.sort_array(F.collect_list("speaker_id")).alias("speakers"))
    return ends.join(speakers, CONV).select(
        CONV,
        F.col("first.platform").alias("platform"),
        "message_count",
        "n_speakers",
        "speakers",
        F.col("first.ts").cast("string").alias("first_timestamp"),
        F.col("last.ts").cast("string").alias("last_timestamp"),
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
    )


def scenario_summary(df: DataFrame, segments: DataFrame) -> DataFrame:
    """One line per conversation: summary, number of turning points, number of segments."""
    tp = temporal.turning_points(df).groupBy(CONV).agg(F.count(F.lit(1)).alias("n_turning_points"))
    seg = segments.groupBy(CONV).agg(F.count(F.lit(1)).alias("n_segments"))
    out = conversation_summary(df).join(tp, CONV, "left").join(seg, CONV, "left")
    return out.withColumn("n_turning_points", F.coalesce("n_turning_points", F.lit(0)))


def corpus_stats(df: DataFrame) -> DataFrame:
    """One row: conversations, messages, mean speakers and messages per conversation, rates and tension mean."""
    per = df.groupBy(CONV, "speaker_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tension").alias("t"),
        *[F.sum(c).alias(c) for c in ("sarcasm", "irony", "passive_aggression")],
        *[F.count(F.when(F.col("sentiment") == s, 1)).alias(f"n_{s}") for s in fixed.SENTIMENTS],
    )
    sums = ["n", "t", "sarcasm", "irony", "passive_aggression", *[f"n_{s}" for s in fixed.SENTIMENTS]]
    conv = per.groupBy(CONV).agg(F.count(F.lit(1)).alias("s"), *[F.sum(c).alias(c) for c in sums])
    total = conv.agg(F.count(F.lit(1)).alias("conversations"), F.sum("s").alias("s"), *[F.sum(c).alias(c) for c in sums])
    return total.select(
        "conversations",
        F.col("n").alias("messages"),
        F.try_divide("s", "conversations").alias("speakers_per_conversation"),
        F.try_divide("n", "conversations").alias("messages_per_conversation"),
        *[F.try_divide(F.col(c), "n").alias(f"{c}_rate") for c in ("sarcasm", "irony", "passive_aggression")],
        *[f"n_{s}" for s in fixed.SENTIMENTS],
        F.try_divide("t", "n").alias("tension_mean"),
    )
