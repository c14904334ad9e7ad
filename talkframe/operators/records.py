"""Row-level projections: defaults, derived fields, label maps, timelines, joins of gold and predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.lookup import mapped
from talkframe.operators import sequence as seq

CONV = "conversation_id"


def fill_defaults(df: DataFrame) -> DataFrame:
    """Missing ids, speakers and platforms; ``pos`` is the 0-based arrival position."""
    return df.withColumns(
        {
            "message_id": F.coalesce("message_id", F.col("pos") + 1),
            "speaker_id": F.coalesce("speaker_id", F.concat(F.lit("speaker_"), (F.col("pos") % 2 + 1).cast("string"))),
            "platform": F.coalesce("platform", F.lit("generic")),
        }
    )


def derive_fields(df: DataFrame) -> DataFrame:
    out = df.withColumn("escalation", (F.col("tension") >= fixed.ESCALATION_TENSION).cast("int"))
    return out.withColumn("topic", F.coalesce("topic", F.lit("unknown")))


def emotion_sentiment(emotion: Column) -> Column:
    return mapped(emotion, fixed.EMOTION_SENTIMENT)


def base_tension(emotion: Column, sarcasm: Column, pa: Column) -> Column:
    return F.least(mapped(emotion, fixed.EMOTION_TENSION) + sarcasm * 15 + pa * 12, F.lit(100.0))


def timeline(df: DataFrame, sarcasm: str = "p") -> DataFrame:
    """Labels and scores per message, without the text."""
    return df.select(CONV, "message_id", "speaker_id", "emotion", "tension", "sentiment", "tone", F.col(sarcasm).alias("sarcasm"))


def probe_turns(df: DataFrame, flag: str = "is_probe") -> DataFrame:
    """Only the turns marked as probes; a missing mark is none."""
    return df.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` messages of each conversation."""
    return seq.with_positions(df).filter(F.col("pos") < n)


def erase(df: DataFrame, erased: DataFrame) -> DataFrame:
    """Everything but the conversations listed in ``erased``; a large conversation is split by adaptive execution."""
    return df.join(erased.select(CONV).distinct(), CONV, "left_anti")


def design_lookup(df: DataFrame, design: DataFrame, key: Column) -> DataFrame:
    """Design labels of each message by its normalised text (``design`` has one row per ``text_key``)."""
    return df.withColumn("text_key", key).join(design, "text_key", "left")


def gold_and_predicted(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold and predicted label of the same message side by side; the id pair is unique, so no key is frequent."""
    return gold.join(pred, [CONV, "message_id"]).withColumn("correct", F.col("gold") == F.col("pred"))
