"""Evidence behind a message, what changed at it, and the per-conversation digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.hidden import first_words, noted, notes, sig, some
from talkframe.operators import profiles, temporal

CONV = "conversation_id"
_E = fixed.EVIDENCE
HEATED = ["frustration", "anger", "sadness"]


def display(label: Column) -> Column:
    spaced = F.lower(F.replace(label, F.lit("_"), F.lit(" ")))
    plain = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1000))
    return F.when(label == "passive_aggressive", "Passive-aggressive").otherwise(plain)


def explain_messages(read: DataFrame) -> DataFrame:
    """Detected evidence (in the text) and inferred reading (from context), kept apart, for every read message."""
    step = F.col("tension") - F.col("before_tension")
    detected = notes(
        (some("negative_hits"), noted("negative", first_words("negative_hits", 3))),
        (some("positive_hits"), noted("positive", first_words("positive_hits", 3))),
        (sig("exclamations") > 0, noted("exclaim", sig("exclamations"))),
        (sig("ellipses") > 0, _E["ellipsis"]),
        (some("exaggeration"), noted("exaggeration", first_words("exaggeration", 3))),
        (sig("emoji_polarity") != 0, noted("emoji", sig("emoji_polarity"))),
        (some("sarcasm_words"), noted("markers", first_words("sarcasm_words", 3))),
        (sig("concessive_phrase").isNotNull(), noted("phrase", sig("concessive_phrase"))),
        (sig("swears") > 0, noted("swear", sig("swears"))),
        (F.col("caps_share") > 0.12, _E["caps"]),
        (F.col("is_short") == 1, _E["short"]),
    )
    inferred = notes(
        (step > 8, noted("rose", step)),
        (step < -8, noted("eased", step)),
        (F.col("prev_emotion") != F.col("emotion"), noted("emotion_shift", F.col("prev_emotion"), F.col("emotion"))),
        (
            F.col("prev_sentiment") != F.col("sentiment"),
            noted("sentiment_shift", F.col("prev_sentiment"), F.col("sentiment")),
        ),
        (F.col("last_emotion").isin(HEATED), noted("speaker_state", F.col("last_emotion"))),
        (F.size("sarcasm_notes") > 0, noted("sarcasm", F.array_join(F.slice("sarcasm_notes", 1, 2), "; "))),
        (F.size("pa_notes") > 0, noted("pa", F.array_join(F.slice("pa_notes", 1, 2), "; "))),
        (F.col("context_text") != "", _E["window"]),
    )
    return read.select(
        CONV,
        "message_id",
        *[display(F.col(c)).alias(c) for c in ("sentiment", "emotion", "tone")],
        "sentiment_confidence",
        "emotion_confidence",
        F.col("sarcasm_score").alias("sarcasm_probability"),
        F.col("pa_score").alias("passive_aggression_probability"),
        "tension",
        detected.alias("detected_evidence"),
        inferred.alias("inferred_interpretation"),
        F.col("confidence").alias("model_confidence"),
    )


def what_changed(read: DataFrame) -> DataFrame:
    """State before and after every message but the first, with the signals that may have contributed."""
    found = notes(
        (some("negative_hits"), _E["change_negative"]),
        ((sig("exclamations") > 0) | (sig("swears") > 0), _E["change_intensity"]),
        (sig("concessive_phrase").isNotNull() | (F.col("pa_score") > 0.5), _E["change_cold"]),
        (F.col("sarcasm_score") > 0.5, _E["change_sarcasm"]),
        (F.col("last_emotion").isin(["frustration", "anger"]), _E["change_carry"]),
        (F.col("is_short") == 1, _E["change_short"]),
    )
    rows = read.filter(F.col("prev_emotion").isNotNull()).withColumn("found", found)
    return rows.select(
        CONV,
        F.col("message_id").alias("at_message"),
        *[F.col(f"prev_{c}").alias(f"before_{c}") for c in ("emotion", "tone", "sentiment")],
        "before_tension",
        *[F.col(c).alias(f"after_{c}") for c in ("emotion", "tone", "sentiment", "tension")],
        (F.col("tension") - F.col("before_tension")).alias("tension_delta"),
        F.concat("prev_emotion", F.lit(" → "), "emotion").alias("emotion_shift"),
        F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit(_E["change_none"]))).alias("contributing"),
    )


def digest(df: DataFrame) -> DataFrame:
    """One row per conversation: headline event, trajectory reading and the speakers that stand out, by name."""
    traj = temporal.trajectory(df)
    turning = temporal.turning_points(df)
    tp = turning.groupBy(CONV).agg(
        F.count(F.lit(1)).alias("n_tp"),
        F.max(
            F.struct(
                F.abs("tension_change").alias("size"), (-F.col("pos")).alias("np"), "message_id", "tension_change",
                F.concat("before_emotion", F.lit(" → "), "after_emotion").alias("from_to"),
                F.col("trigger_text").alias("trigger"), "speaker",
            )
        ).alias("tp"),
    )
    prof = profiles.speaker_profiles(df).groupBy(CONV).agg(
        F.count(F.lit(1)).alias("n_speakers"),
        F.sort_array(F.collect_list(
            F.when((F.col("high_tension_share") > 0.5) | (F.col("sarcastic_share") > 0.25), F.col("speaker_id"))
        )).alias("flagged"),
    ).withColumn("n_flagged", F.size("flagged").cast("long"))
    peaks = traj.select(CONV, F.col("peak_message").alias("message_id"))
    peak = df.join(peaks, [CONV, "message_id"]).select(
        CONV, F.substring("text", 1, 140).alias("peak_text"), F.col("speaker_id").alias("peak_speaker")
    )
    rows = (
        traj.join(tp, CONV, "left").join(prof, CONV).join(peak, CONV).join(temporal.recovery(df), CONV)
        .withColumn("n_tp", F.coalesce("n_tp", F.lit(0)))
    )
    turned = F.coalesce(F.col("tp.size") >= 5.0, F.lit(False))
    rising = F.col("trajectory") == "escalating"
    kind = F.when(turned, "turning_point").when(rising, "escalation_peak")
    direction = F.when(turned, F.when(F.col("tp.tension_change") > 0, "tension spike").otherwise("tension dip"))
    recovered = F.col("recovered") | F.col("deescalation_point").isNotNull()
    head = F.when(turned, F.col("tp.message_id")).when(rising, F.col("peak_message"))
    overview = F.concat(
        F.format_string(
            "%d messages, %d participant(s): trajectory is %s, peak tension %s/100, %d turning point(s) detected.",
            "n", "n_speakers", "trajectory", F.round("peak_tension", 1).cast("string"), "n_tp",
        ),
        F.when(recovered, " The conversation de-escalated after its peak.").otherwise(""),
        F.when(F.col("n_flagged") > 0, F.concat(F.lit(" Elevated-tension/sarcasm share: "), F.array_join("flagged", ", "), F.lit("."))).otherwise(""),
    )
    detail = F.concat(
        F.lit("Detected "), direction, F.lit(" after message "), F.col("tp.message_id"), F.lit(" ("), F.col("tp.from_to"), F.lit(").")
    )
    return rows.select(
        CONV,
        F.col("n").alias("n_messages"),
        "n_speakers",
        "n_flagged",
        "flagged",
        kind.alias("headline_kind"),
        head.alias("headline_message"),
        direction.alias("direction"),
        F.when(turned, F.col("tp.tension_change")).alias("tension_change"),
        F.when(turned, F.col("tp.from_to")).alias("from_to"),
        F.when(turned, F.col("tp.trigger")).when(rising, F.col("peak_text")).alias("trigger"),
        F.when(turned, F.col("tp.speaker")).when(rising, F.col("peak_speaker")).alias("speaker"),
        "trajectory",
        "escalation_rate",
        "peak_tension",
        F.col("n_tp").alias("n_turning_points"),
        recovered.alias("recovered"),
        overview.alias("overview"),
        F.coalesce(detail, overview).alias("headline"),
    )
