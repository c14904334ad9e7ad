"""The whole analysis: messages in, one table per report section out.

Tables stay apart because a conversation can be very long; ``report_rows`` gives the same content as JSON documents, one
per section row, and ``only`` narrows any table to one conversation or message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe import fixed
from talkframe.functions import text
from talkframe.operators import context, explain, fusion, learn, profiles, records, segments, temporal
from talkframe.operators import sequence as seq
from talkframe.plans.enrich import read_messages
from talkframe.session import settle

CONV = "conversation_id"


def score(df: DataFrame, model: learn.Model) -> DataFrame:
    """Unlabelled messages to labelled ones, with the model's own predictions as history."""
    rows = text.behaviour(context.response_gap(seq.with_positions(df)), gap="gap_hours")
    got = learn.predict_sequential(rows, model).drop("speaker_id")
    return with_polarity(seq.with_positions(df).join(got, [CONV, "message_id"]))


def with_polarity(scored: DataFrame) -> DataFrame:
    """Scores plus the two probabilities polarity is taken from, each label head's likeliest classes and the names the reading uses."""
    return scored.withColumns({
        **{f"p_{s}": F.coalesce(F.element_at("sentiment_probs", s), F.lit(0.0)) for s in ("positive", "negative")},
        **{f"{h}_top3": learn.top_classes(f"{h}_probs") for h in learn.MULTI},
        "pa_p": F.col("passive_aggression_p"),
    })


#: What a conversation without messages shows in the sections that have one row per conversation; other columns are null or empty lists.
EMPTY = {
    "conversation": {"platform": "generic", "message_count": 0, "n_speakers": 0, "schema_version": fixed.SCHEMA_VERSION},
    "summary": {"n_messages": 0, "n_speakers": 0, "n_positive": 0, "n_neutral": 0, "n_negative": 0, "sarcasm_level": 0, "irony_level": 0,
                "passive_aggression_level": 0, "mean_tension": 0, "peak_tension": 0, "trajectory": "stable"},
    "escalation": {"n": 0, "trajectory": "stable", "escalation_rate": 0, "peak_tension": 0, "start_tension": 0, "middle_tension": 0,
                   "end_tension": 0, "confidence": 0},
    "digest": {"n_messages": 0, "n_speakers": 0, "n_flagged": 0, "trajectory": "stable", "escalation_rate": 0, "peak_tension": 0,
               "n_turning_points": 0, "recovered": False},
}


def with_empty(table: DataFrame, empty: DataFrame, values: dict) -> DataFrame:
    """``table`` plus one row per conversation of ``empty`` with the given ``values``; lists are empty, all else is null."""
    def default(field: T.StructField) -> Column:
        value = F.array() if isinstance(field.dataType, T.ArrayType) else F.lit(values.get(field.name))
        return value.cast(field.dataType).alias(field.name)

    return table.unionByName(empty.select(*[F.col(CONV) if f.name == CONV else default(f) for f in table.schema.fields]))


def analyze(df: DataFrame, weights: dict | None = None, model: learn.Model | None = None, conversations: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables for labelled messages (see ``views.messages`` for the columns). Stream weights are the caller's, else the model's,
    else the default. ``conversations`` (conversation_id) may name conversations without messages: they show as ``EMPTY``."""
    weights = fusion.resolve_weights(weights, stored=model.fusion_weights if model else None)
    read = settle(read_messages(seq.with_positions(df), weights), "read")
    tables = _sections(read)
    if conversations is not None:
        empty = conversations.select(CONV).distinct().join(read.select(CONV), CONV, "left_anti")
        tables |= {name: with_empty(tables[name], empty, values) for name, values in EMPTY.items()}
    return tables


def _sections(read: DataFrame) -> dict[str, DataFrame]:
    return {
        "messages": read,
        "conversation": profiles.conversation_block(read if "platform" in read.columns else read.withColumn("platform", F.lit("generic"))),
        "summary": profiles.conversation_summary(read, "sarcasm_score", "irony_score", "pa_score"),
        "emotional_arc": temporal.arc_summary(read),
        "arc_peaks": temporal.extrema(read),
        "emotion_transitions": temporal.transitions(read),
        "transition_matrix": temporal.transition_matrix(read),
        "turning_points": temporal.turning_points(read),
        "escalation": temporal.trajectory(read),
        "escalation_phases": temporal.phases(read),
        "speaker_profiles": profiles.speaker_profiles(read, "sarcasm_score", "pa_score"),
        "speaker_labels": profiles.label_shares(read, [CONV, "speaker_id"], {"emotion": 3, "tone": 3, "sentiment": 3}),
        "digest": explain.digest(read.withColumnsRenamed({"sarcasm_score": "p"}) if "p" not in read.columns else read),
        "explanations": explain.explain_messages(read),
        "what_changed": explain.what_changed(read),
        "topics": segments.topic_segments(read),
        "timeline": records.timeline(read, "sarcasm_score"),
    }


def only(table: DataFrame, conversation_id: object = None, message_id: int | None = None) -> DataFrame:
    out = table if conversation_id is None else table.filter(F.col(CONV) == conversation_id)
    key = "at_message" if "at_message" in table.columns else "message_id"
    return out if message_id is None else out.filter(F.col(key) == message_id)


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(conversation_id, section, body): every section row as one JSON document."""
    out = None
    for name, t in tables.items():
        body = F.to_json(F.struct(*[c for c in t.columns if c != CONV]))
        part = t.select(CONV, F.lit(name).alias("section"), body.alias("body"))
        out = part if out is None else out.unionByName(part)
    return out
