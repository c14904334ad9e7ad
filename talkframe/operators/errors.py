"""Error taxonomy of predicted labels: what kind of mistake, likely cause, and which gold labels contradict the design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions.hidden import sig, some
from talkframe.functions.text import normal_text


CONV = "conversation_id"
CAUSES = {
    "noise": "gold label contradicts the design label",
    "subtle": "symbolic evidence below threshold (subtle contradiction)",
    "literal": "literal reading dominated, no contextual trigger",
    "primed": "tension trajectory primed the prior",
    "marker": "marker words present without ironic intent",
}


def label_errors(read: DataFrame, heads: dict[str, str]) -> DataFrame:
    """Wrong multi-class labels. ``heads`` maps a predicted column to its gold column."""
    kind = (
        F.when(some("sarcasm_words") | (F.col("sarcasm_score") > 0.5), "sarcasm interference")
        .when(sig("is_short"), "short-message ambiguity")
        .when(sig("emoji_polarity") != 0, "emoji polarity conflict")
        .when(some("negative_hits") & some("positive_hits"), "mixed polarity")
        .otherwise("context disagreement")
    )
    sides = F.array(*[F.struct(F.lit(p).alias("head"), F.col(g).alias("gold"), F.col(p).alias("pred")) for p, g in heads.items()])
    rows = read.select(CONV, "message_id", kind.alias("error_type"), F.inline(sides))
    return rows.filter(F.col("gold") != F.col("pred"))


def binary_errors(read: DataFrame, heads: dict[str, tuple[str, str]], design: DataFrame) -> DataFrame:
    """Wrong binary labels. ``heads`` maps a gold column to its (score, learned probability) columns.

    ``design`` has one row per ``text_key``; the lookup is salted, so one very common text is no obstacle.
    """
    sides = F.array(*[
        F.struct(F.lit(g).alias("head"), F.col(g).alias("gold"), F.col(s).alias("score"), F.col(p).alias("learned"))
        for g, (s, p) in heads.items()
    ])
    key = F.md5(normal_text(F.col("text"))).alias("text_key")
    rows = read.select(CONV, "message_id", key, F.inline(sides)).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    rows = rows.filter(F.col("gold") != F.col("pred"))
    label = F.coalesce(*[F.when(F.col("head") == g, F.col(f"design_{g}")) for g in heads])
    rows = rows.join(design, "text_key", "left").withColumn("noise", F.coalesce(label != F.col("gold"), F.lit(False)))
    missed = F.col("gold") == 1
    cause = (
        F.when(F.col("noise"), CAUSES["noise"])
        .when(missed & (F.col("learned") > 0.4), CAUSES["subtle"])
        .when(missed, CAUSES["literal"])
        .when(F.round(F.col("score") - F.col("learned"), 9) > 0.2, CAUSES["primed"])
        .otherwise(CAUSES["marker"])
    )
    kind = F.when(missed, "false_negative").otherwise("false_positive")
    return rows.select(CONV, "message_id", F.concat_ws(":", "head", kind).alias("error_type"), cause.alias("cause"), "noise")


def taxonomy(labels: DataFrame, binary: DataFrame) -> DataFrame:
    """Errors per type: all, attributed to label noise, remaining."""
    every = labels.select("error_type", F.lit(0).alias("noise")).unionByName(
        binary.select("error_type", F.col("noise").cast("int").alias("noise"))
    )
    return every.groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"), F.sum("noise").alias("noise_attributed")).withColumn(
        "remaining", F.col("errors") - F.col("noise_attributed")
    )
