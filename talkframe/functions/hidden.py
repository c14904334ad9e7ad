"""Sarcasm, irony and passive aggression: a learned probability combined with what the words and the context show.

Expressions over one enriched message: ``signals``, ``context_text``, ``prev_tension`` (0 on the first message),
``recent_tension`` of the speaker, and the learned ``p_positive, p_negative, sarcasm_p, irony_p, pa_p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.lookup import clip, count_contains, noisy_or

_E = fixed.EVIDENCE


def sig(name: str) -> Column:
    return F.col(f"signals.{name}")


def some(name: str) -> Column:
    return F.size(sig(name)) > 0


def first_words(name: str, n: int) -> Column:
    return F.array_join(F.slice(sig(name), 1, n), ", ")


def notes(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs])
    )


def noted(key: str, *args: Column) -> Column:
    return F.format_string(_E[key], *args)


def contradiction() -> Column:
    """Literal praise inside a negative or heated context."""
    hits = count_contains(F.lower("context_text"), fixed.NEGATIVE_CONTEXT)
    worded = F.when(F.col("context_text") != "", F.least(hits / 3.0, F.lit(1.0))).otherwise(F.lit(0.0))
    heat = F.least(F.greatest(F.col("prev_tension") - 35.0, F.lit(0.0)) / 45.0, F.lit(1.0)) * 0.6
    evidence = (
        F.greatest(worded, heat) * 0.30
        + (sig("exclamations") >= 1).cast("int") * 0.20
        + F.least(F.size(sig("sarcasm_words")) / 2.0, F.lit(1.0)) * 0.15
        + some("interjections").cast("int") * 0.15
    )
    praised = F.round(F.col("p_positive") - F.col("p_negative"), 9) > 0.10
    return F.when(praised, evidence).otherwise(F.lit(0.0)) * F.when(sig("belief_update"), F.lit(0.5)).otherwise(F.lit(1.0))


def with_hidden(df: DataFrame) -> DataFrame:
    """Add ``contradiction`` and, per signal, ``<signal>_score`` and ``<signal>_notes``."""
    out = df.withColumn("contradiction", contradiction())
    coop = sig("cooperative")
    out = out.withColumn("_c", F.col("contradiction") * F.when(coop, F.lit(0.25)).otherwise(F.lit(1.0)))
    echoed = F.filter(
        sig("repeated_words"),
        lambda w: F.array_contains(sig("positive_hits"), w) | F.array_contains(sig("sarcasm_words"), w),
    )
    repeat = F.least(F.size(echoed) / 2.0, F.lit(1.0)) * 0.25
    spike = F.greatest(F.col("tension") - F.col("prev_tension"), F.lit(0.0)) / 100.0
    residual = (
        (F.lit(1.0) - F.col("sarcasm_p"))
        * (F.lit(1.0) - F.least(F.col("_c") + repeat, F.lit(0.95)))
        * (F.lit(1.0) - spike * 0.30)
        * F.when(coop, F.lit(2.5)).otherwise(F.lit(1.0))
    )
    opposed = F.round("_c", 9) > 0.3
    quoted = F.when(sig("quoted_echo"), F.lit(0.2)).otherwise(F.lit(0.0))
    phrase = sig("concessive_phrase").isNotNull()
    cold = sig("is_short") & (sig("exclamations") == 0) & (sig("emoji_polarity") <= 0)
    base = F.coalesce(F.nullif("recent_tension", F.lit(0.0)), "prev_tension")
    rising = F.round(F.col("tension") - base, 9) > 8
    pa = F.least(
        phrase.cast("int") * 0.35 + cold.cast("int") * 0.15 + rising.cast("int") * 0.2, F.lit(0.95)
    )
    return out.withColumns(
        {
            "sarcasm_score": clip(F.lit(1.0) - F.least(residual, F.lit(1.0)), 0.0, 1.0),
            "sarcasm_notes": notes(
                (opposed, _E["sarcasm_context"]),
                (some("sarcasm_words"), noted("sarcasm_markers", first_words("sarcasm_words", 3))),
                (some("repeated_words"), noted("sarcasm_repeat", first_words("repeated_words", 2))),
                (coop, _E["sarcasm_cooperative"]),
                (sig("belief_update"), _E["sarcasm_belief"]),
                (some("sarcasm_emoji"), noted("sarcasm_emoji", first_words("sarcasm_emoji", 2))),
                (sig("exclamations") > 0, _E["sarcasm_exclaim"]),
                (spike > 0.05, noted("sarcasm_spike", spike * 100)),
            ),
            "irony_score": F.least(noisy_or(F.col("irony_p"), F.least(F.col("_c") + quoted, F.lit(0.95))), F.lit(1.0)),
            "irony_notes": notes(
                (opposed, _E["irony_context"]),
                (some("interjections"), _E["irony_interjection"]),
                (sig("quoted_echo"), _E["irony_quote"]),
            ),
            "pa_score": F.least(noisy_or(F.col("pa_p"), pa), F.lit(1.0)),
            "pa_notes": notes(
                (phrase, noted("pa_phrase", sig("concessive_phrase"))), (cold, _E["pa_cold"]), (rising, _E["pa_rising"])
            ),
        }
    ).withColumn("mismatch", F.col("_c")).drop("_c")


def fused_confidence(intensity: Column, weights: dict = fixed.FUSION_WEIGHTS) -> Column:
    """Confidence of a message from the text, behaviour and hidden streams."""
    spoken = F.greatest("sentiment_confidence", "emotion_confidence")
    share = weights["text"] + weights["context"] + weights["memory"]
    fused = clip(
        spoken * share * 2.2 + intensity * weights["behavior"] + F.col("sarcasm_score") * weights["hidden"], 0.0, 0.995
    )
    return fused * 0.55 + F.col("emotion_confidence") * 0.45
