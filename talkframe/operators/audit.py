"""Data checks: record and conversation rules, duplicates, leakage between splits, label balance, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.text import normal_text, strip_space
from talkframe.operators import metrics
from talkframe.operators import sequence as seq

CONV = "conversation_id"


def validate_records(df: DataFrame) -> DataFrame:
    """One row per broken rule. Required columns that the table lacks count as missing in every row; a time may be null, derived fields
    (escalation, topic) are only judged where they are present."""
    flags = ("sarcasm", "irony", "passive_aggression")
    lacking = [c for c in (CONV, "message_id", "speaker_id", "ts", "text", "sentiment", "emotion", "tone", *flags, "tension") if c not in df.columns]
    rules = [F.lit(f"missing {c}") for c in lacking]
    df = df.withColumns({c: F.lit(None).cast("string") for c in lacking})

    def bad(name: str, condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)), F.lit(name))

    given = [c for c in (CONV, "message_id", "speaker_id", "text", "tone") if c not in lacking]
    rules += [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in given]
    judged = {
        "sentiment": bad("bad sentiment", ~F.col("sentiment").isin(fixed.SENTIMENTS)),
        "emotion": bad("bad emotion", ~F.col("emotion").isin(fixed.EMOTIONS)),
        **{c: bad(f"{c} must be 0/1", ~F.col(c).cast("int").isin(0, 1)) for c in flags},
        "tension": bad("tension out of range", (F.col("tension") < 0) | (F.col("tension") > 100) | F.isnan(F.col("tension").cast("double"))),
        "text": F.when(strip_space(F.col("text")) == "", F.lit("empty text")),
    }
    rules += [rule for c, rule in judged.items() if c not in lacking]
    if "escalation" in df.columns:
        rules.append(F.when(~F.col("escalation").cast("int").isin(0, 1), F.lit("escalation must be 0/1")))
    if "topic" in df.columns:
        rules.append(F.when(strip_space(F.col("topic")) == "", F.lit("empty topic")))
    return df.select(CONV, "message_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def validate_conversations(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Ids used twice in a conversation, and ids that go down in arrival order (a dense 0-based column)."""
    twice = df.groupBy(CONV, "message_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = seq.blocked(df.select(CONV, "message_id", F.col(arrival).alias("pos")), before=1)
    down = seq.owned(spread.withColumn("_p", F.lag("message_id").over(seq.block_window()))).filter(F.col("message_id") < F.col("_p"))
    return twice.select(CONV, "message_id", F.lit("duplicate id").alias("violation")).unionByName(
        down.select(CONV, "message_id", F.lit("not ascending").alias("violation"))
    )


def signature(df: DataFrame) -> DataFrame:
    """Order-sensitive identity of each conversation, built from sums over (position, text) digests."""
    digest = F.md5(F.concat_ws("␟", F.col("pos"), normal_text(F.col("text"))))
    parts = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]
    agg = seq.with_positions(df).select(CONV, *[p.alias(f"h{i}") for i, p in enumerate(parts)]).groupBy(CONV).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)]
    )
    return agg.select(CONV, F.concat_ws("-", "n", "h0", "h1", "h2", "h3").alias("signature"))


def duplicate_conversations(df: DataFrame) -> DataFrame:
    s = signature(df).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_conversations"), F.count(F.lit(1)).alias("distinct_signatures")
    )


def duplicate_messages(df: DataFrame, text: str = "text") -> DataFrame:
    t = df.groupBy(F.md5(normal_text(F.col(text))).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return t.agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("distinct_texts"),
        F.try_divide(F.sum("n"), F.count(F.lit(1))).alias("reuse_factor"), F.max("n").alias("max_repeats"),
    )


def split_overlap(df: DataFrame) -> DataFrame:
    """How many ids, conversation signatures and texts each pair of splits shares. Needs column ``split``."""
    sig = signature(df).join(df.select(CONV, "split").distinct(), CONV)
    items = (
        df.select(F.lit("id").alias("kind"), F.col(CONV).cast("string").alias("item"), "split")
        .unionByName(sig.select(F.lit("signature").alias("kind"), F.col("signature").alias("item"), "split"))
        .unionByName(df.select(F.lit("text").alias("kind"), F.md5(normal_text(F.col("text"))).alias("item"), "split"))
    )
    seen = items.groupBy("kind", "item").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    return seen.groupBy("kind").agg(
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
    )


def class_imbalance(df: DataFrame, heads: dict[str, list], binary: list[str]) -> DataFrame:
    """Per head: rows of the largest and smallest class (absent classes count 0), ratio, and whether it is acceptable."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(h) == v, 1)).alias(f"{h}|{v}") for h, labels in heads.items() for v in labels],
        *[F.sum(b).alias(b) for b in binary],
    )
    rows = []
    for h, labels in heads.items():
        cells = [F.col(f"`{h}|{v}`") for v in labels]
        top, low = F.greatest(*cells), F.least(*cells)
        rows.append(F.struct(F.lit(h).alias("head"), top.alias("largest"), low.alias("smallest"), (top / F.col("n")).alias("share"),
                             (top / F.greatest(low, F.lit(1))).alias("ratio"), (top / F.col("n") < 0.9).alias("ok")))
    for b in binary:
        pos, neg = F.col(b), F.col("n") - F.col(b)
        rate = pos / F.col("n")
        rows.append(F.struct(F.lit(b).alias("head"), F.greatest(pos, neg).alias("largest"), F.least(pos, neg).alias("smallest"),
                             rate.alias("share"), (neg / F.greatest(pos, F.lit(1))).alias("ratio"), rate.between(0.02, 0.60).alias("ok")))
    return counts.select(F.inline(F.array(*rows)))


def label_noise(df: DataFrame, design: DataFrame, binary: list[str], injected: float = 0.015) -> DataFrame:
    """Share of messages whose released binary labels differ from the design labels of their text.

    ``design`` has one row per ``text_key`` with ``design_<label>`` columns. Messages are counted per text and label
    combination before the join, so a text that makes up much of the corpus is joined once per combination.
    """
    counts = df.groupBy(F.md5(normal_text(F.col("text"))).alias("text_key"), *binary).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(design, "text_key", "left")
    differs = [F.coalesce(F.col(b) != F.col(f"design_{b}"), F.lit(False)) for b in binary]
    any_flip = differs[0]
    for d in differs[1:]:
        any_flip = any_flip | d
    t = rows.agg(
        F.sum("n").alias("messages"), F.sum(F.when(any_flip, F.col("n")).otherwise(0)).alias("flipped"),
        *[F.sum(F.when(d, F.col("n")).otherwise(0)).alias(f"flips_{b}") for b, d in zip(binary, differs)],
    )
    rate = F.try_divide("flipped", "messages")
    return t.select("*", rate.alias("rate"), rate.between(injected * 0.25, injected * 2.5).alias("passed"))


def bounds(df: DataFrame, unit: list[str], percent: list[str]) -> DataFrame:
    """How many values of each column lie outside [0, 1] (or [0, 100]) or are not a number."""
    def broken(c: str, high: float) -> Column:
        return F.count(F.when(F.isnan(c) | (F.col(c) < 0) | (F.col(c) > high), 1)).alias(c)

    cols = [(c, 1.0) for c in unit] + [(c, 100.0) for c in percent]
    t = df.agg(F.count(F.lit(1)).alias("n"), *[broken(c, h) for c, h in cols])
    return t.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("violations"), F.col("n").alias("checked")) for c, _ in cols])))


def release_gates(df: DataFrame, heads: tuple[str, ...] = ("sentiment", "emotion", "tone"), value: str = "tension") -> DataFrame:
    """(gate, passed) of a labelled, split corpus, and their conjunction as ``verdict``: splits share no conversation and no conversation text
    with the test split, no conversation occurs twice, the split depends on no head's labels and not on ``value``."""


    over = split_overlap(df)
    shared = F.sum(F.when(F.col("kind") == "id", F.col("train_val") + F.col("train_test") + F.col("val_test")))
    leaked = F.sum(F.when(F.col("kind") == "signature", F.col("train_test") + F.col("val_test")))
    gates = over.agg((shared == 0).alias("separation"), (leaked == 0).alias("contamination"))
    gates = gates.select(F.inline(F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).alias("passed")) for c in ("separation", "contamination")])))
    dup = duplicate_conversations(df).select(F.lit("duplicate_conversations").alias("gate"), (F.col("duplicate_conversations") == 0).alias("passed"))
    bal = metrics.split_balance(df, value).select(F.lit("split_balance").alias("gate"), "passed")
    gates = gates.unionByName(dup).unionByName(bal)
    for head in heads:
        gates = gates.unionByName(metrics.split_independence(df, head).select(F.lit(f"independence_{head}").alias("gate"), F.col("ok").alias("passed")))
    gates = gates.groupBy("gate").agg(F.bool_and("passed").alias("passed"))
    return gates.unionByName(gates.agg(F.lit("verdict").alias("gate"), F.bool_and("passed").alias("passed")))
