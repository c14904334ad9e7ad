"""Scored messages to fully read messages: the per-message half of the analysis.

The wide rows (text) are shuffled once, over (conversation, block), for the previous values, the context window and the
salient older turns; the text features follow on the shuffled rows. Speaker state is worked out on a narrow table that
is written once, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions import hidden, text
from talkframe.operators import context
from talkframe.operators import sequence as seq
from talkframe.session import settle

CONV = "conversation_id"
PREVIOUS = ("ts", "tension", "emotion", "sentiment", "tone")


def enrich(df: DataFrame, lexicon: text.Lexicon = text.DEFAULT) -> DataFrame:
    """Add behaviour, signals, context, previous values and speaker state to every message."""
    df = seq.with_positions(df)
    narrow = df.select(CONV, "pos", "speaker_id", "emotion", "tone", "sentiment", "tension", text.is_short(F.col("text")).alias("is_short"))
    memory = context.speaker_memory(settle(narrow, "turns")).select(
        CONV, "pos", "last_emotion", "last_tone", "last_sentiment", "recent_tension", "short_streak"
    )
    rows = context.context_window(df, previous=PREVIOUS)
    rows = text.signals(text.behaviour(rows, lexicon=lexicon), lexicon=lexicon)
    return rows.withColumn("gap_hours", context.gap_hours()).join(memory, [CONV, "pos"])


def read_messages(df: DataFrame, weights: dict = fixed.FUSION_WEIGHTS, lexicon: text.Lexicon = text.DEFAULT) -> DataFrame:
    """``enrich`` plus hidden signals, behaviour intensity and fused confidence."""
    rows = enrich(df, lexicon)
    rows = rows.withColumns({"before_tension": F.col("prev_tension"), "prev_tension": F.coalesce("prev_tension", F.lit(0.0))})
    rows = hidden.with_hidden(rows).withColumn("intensity", text.intensity())
    return rows.withColumn("confidence", hidden.fused_confidence(F.col("intensity"), weights))
