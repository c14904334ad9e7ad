"""Text features: normalised text, emoji tokens, the 16 behaviour numbers and the 20 sparse signals.

All of it is built-in expressions over one message; nothing shuffles. Word lists are parameters of ``Lexicon``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.lookup import any_contains, clip, literal_map

BEHAVIOUR = [
    "n_words", "n_chars", "exclamations", "questions", "repeated_punctuation", "caps_share", "positive_hits",
    "negative_hits", "exaggeration_hits", "emoji_polarity", "emoji_sarcasm", "laughter", "ellipses",
    "odd_quote_or_swear", "is_short", "gap_hours",
]


@dataclass(frozen=True)
class Lexicon:
    positive: list = field(default_factory=lambda: fixed.POSITIVE)
    negative: list = field(default_factory=lambda: fixed.NEGATIVE)
    sarcasm: list = field(default_factory=lambda: fixed.SARCASM_MARKERS)
    sincere_frames: dict = field(default_factory=lambda: fixed.SINCERE_FRAMES)
    irony: list = field(default_factory=lambda: fixed.IRONY_MARKERS)
    interjections: list = field(default_factory=lambda: fixed.INTERJECTIONS)
    belief_update: list = field(default_factory=lambda: fixed.BELIEF_UPDATE)
    concessive: list = field(default_factory=lambda: fixed.CONCESSIVE_PHRASES)
    exaggeration: list = field(default_factory=lambda: fixed.EXAGGERATION)
    cooperative: list = field(default_factory=lambda: fixed.COOPERATIVE)
    emoji_polarity: dict = field(default_factory=lambda: fixed.EMOJI_POLARITY)
    emoji_sarcasm: list = field(default_factory=lambda: fixed.EMOJI_SARCASM)


DEFAULT = Lexicon()


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{fixed.SPACE}+|{fixed.SPACE}+$", "")


def words(text: Column) -> Column:
    """Non-empty runs of non-space characters."""
    return F.filter(F.split(text, f"{fixed.SPACE}+"), lambda w: w != "")


def word_runs(text: Column) -> Column:
    """Maximal runs of letters, digits and underscore."""
    return F.filter(F.split(text, fixed.NOT_WORD), lambda w: w != "")


def emoji_tokens(text: Column) -> Column:
    """Adjacent emoji form one token."""
    return F.regexp_extract_all(text, F.lit(fixed.EMOJI_RUN), F.lit(0))


def without_emoji(text: Column) -> Column:
    return F.regexp_replace(text, fixed.EMOJI_RUN, " ")


def process_text(text: Column) -> Column:
    """Mask links, cut runs of one punctuation mark to two, collapse white space."""
    masked = F.regexp_replace(text, fixed.URL, " link ")
    squeezed = F.regexp_replace(F.regexp_replace(masked, "!{2,}", "!!"), r"\?{2,}", "??")
    return strip_space(F.regexp_replace(squeezed, f"{fixed.SPACE}+", " "))


def normal_text(text: Column) -> Column:
    """Key for duplicate checks: parenthesised parts removed, lower case, single spaces."""
    bare = F.regexp_replace(text, rf"{fixed.SPACE}*\([^)]*\){fixed.SPACE}*", " ")
    return F.regexp_replace(strip_space(F.lower(bare)), f"{fixed.SPACE}+", " ")


def slang_tokens(text: Column, slang: dict = fixed.SLANG) -> Column:
    """Lower-case ``[a-z']`` tokens with slang spelled out, in order."""
    plain = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z' ]", " "), " +"), lambda w: w != "")
    table = literal_map(slang)
    return F.flatten(F.transform(plain, lambda w: F.split(F.coalesce(F.try_element_at(table, w), w), " ")))


def parse_timestamp(value: Column) -> Column:
    """ISO text to a timestamp; a bare clock time or any other form is null."""
    return F.try_to_timestamp(F.when(value.rlike(fixed.ISO_TIMESTAMP), value))


def speaker_name(value: Column) -> Column:
    """Trimmed, with direction marks removed from both ends."""
    return F.regexp_replace(strip_space(value), r"^[\x{200E}\x{200F}]+|[\x{200E}\x{200F}]+$", "")


def is_short(text: Column) -> Column:
    """1 when at most two words are left without emoji."""
    return (F.size(words(without_emoji(text))) <= 2).cast("int")


def _count_in(tokens: Column, vocabulary: list) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(vocabulary)))


def _polarity(emoji: Column, table: dict) -> Column:
    known = literal_map(table)
    return F.aggregate(
        emoji, F.lit(0.0), lambda acc, e: acc + F.coalesce(F.try_element_at(known, e), F.lit(0.0))
    )


def behaviour(df: DataFrame, text: str = "text", gap: str | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Append the 16 behaviour numbers (see ``BEHAVIOUR``); ``gap`` names a column with the response gap in hours."""
    raw = F.col(text)
    staged = df.withColumns({"_emoji": emoji_tokens(raw), "_words": words(without_emoji(raw)), "_runs": word_runs(raw)})
    staged = staged.withColumn(
        "_bare", F.transform("_words", lambda w: F.regexp_replace(F.lower(w), r"^[.,!?]+|[.,!?]+$", ""))
    )
    shouted = F.aggregate(
        F.filter("_runs", lambda w: w.rlike(fixed.CAPS_WORD)), F.lit(0), lambda acc, w: acc + F.length(w)
    )
    swears = F.size(F.filter("_runs", lambda w: F.lower(w).rlike(fixed.SWEAR_WORD)))
    quotes = F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit("")))
    out = staged.withColumns(
        {
            "n_words": F.size("_words"),
            "n_chars": F.length(raw),
            "exclamations": F.regexp_count(raw, F.lit("!")),
            "questions": F.regexp_count(raw, F.lit(r"\?")),
            "repeated_punctuation": F.regexp_count(raw, F.lit(fixed.REPEATED_PUNCTUATION)),
            "caps_share": shouted / F.greatest(F.length(raw), F.lit(1)),
            "positive_hits": _count_in(F.col("_bare"), lexicon.positive),
            "negative_hits": _count_in(F.col("_bare"), lexicon.negative),
            "exaggeration_hits": _count_in(F.col("_bare"), lexicon.exaggeration),
            "emoji_polarity": _polarity(F.col("_emoji"), lexicon.emoji_polarity),
            "emoji_sarcasm": _count_in(F.col("_emoji"), lexicon.emoji_sarcasm),
            "laughter": F.exists("_runs", lambda w: F.lower(w).rlike(fixed.LAUGH_WORD)).cast("int"),
            "ellipses": F.regexp_count(raw, F.lit(fixed.ELLIPSIS)),
            "odd_quote_or_swear": quotes % 2 + swears,
            "is_short": (F.size("_words") <= 2).cast("int"),
            "gap_hours": F.col(gap) if gap else F.lit(0.0),
        }
    )
    return out.drop("_emoji", "_words", "_runs", "_bare")


def intensity() -> Column:
    """Behaviour intensity in [0, 1] from the behaviour columns."""
    return clip(
        F.col("exclamations") * 0.18 + F.col("repeated_punctuation") * 0.22 + F.col("caps_share") * 2.2
        + F.col("negative_hits") * 0.15 + F.col("odd_quote_or_swear") * 0.3 + F.col("exaggeration_hits") * 0.1,
        0.0,
        1.0,
    )


def signals(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT, name: str = "signals") -> DataFrame:
    """Append one struct with the 20 sparse signals of a message."""
    raw = F.col(text)
    staged = df.withColumns(
        {"_emoji": emoji_tokens(raw), "_low": strip_space(F.lower(without_emoji(raw))), "_runs": word_runs(raw)}
    )
    staged = staged.withColumn(
        "_w", F.transform(words(F.col("_low")), lambda w: F.regexp_replace(w, r"""^[.,!?"']+|[.,!?"']+$""", ""))
    ).withColumn("_sorted", F.array_sort("_w"))
    low = F.col("_low")
    sincere = {w: any_contains(low, frames) for w, frames in lexicon.sincere_frames.items()}

    def ironic_sense(w: Column) -> Column:
        keep = w.isin(lexicon.sarcasm)
        for marker, framed in sincere.items():
            keep = keep & ~((w == marker) & framed)
        return keep

    repeated = F.array_distinct(
        F.filter("_sorted", lambda w, i: (w == F.get(F.col("_sorted"), i - 1)) & (w != "") & ~w.isin(fixed.REPEAT_STOP_WORDS))
    )
    hits = staged.withColumns(
        {
            "_pos": F.filter("_w", lambda w: w.isin(lexicon.positive)),
            "_neg": F.filter("_w", lambda w: w.isin(lexicon.negative)),
        }
    )
    concessive = F.coalesce(*[F.when(low.startswith(p), F.lit(p)) for p in lexicon.concessive])
    out = hits.withColumn(
        name,
        F.struct(
            F.size("_w").alias("n_words"),
            F.col("_pos").alias("positive_hits"),
            F.col("_neg").alias("negative_hits"),
            F.filter("_w", ironic_sense).alias("sarcasm_words"),
            F.filter("_w", lambda w: w.isin(lexicon.irony)).alias("irony_words"),
            concessive.alias("concessive_phrase"),
            F.filter("_w", lambda w: w.isin(lexicon.exaggeration)).alias("exaggeration"),
            repeated.alias("repeated_words"),
            any_contains(low, lexicon.cooperative).alias("cooperative"),
            any_contains(low, lexicon.belief_update).alias("belief_update"),
            F.filter(F.array(*[F.lit(w) for w in lexicon.interjections]), lambda w: F.array_contains("_w", w)).alias(
                "interjections"
            ),
            (F.size("_pos") - F.size("_neg")).alias("praise_minus_negative"),
            F.regexp_count(raw, F.lit("!")).alias("exclamations"),
            F.regexp_count(raw, F.lit(fixed.ELLIPSIS)).alias("ellipses"),
            F.filter("_emoji", lambda e: e.isin(lexicon.emoji_sarcasm)).alias("sarcasm_emoji"),
            _polarity(F.col("_emoji"), lexicon.emoji_polarity).alias("emoji_polarity"),
            F.exists("_runs", lambda w: F.lower(w).rlike(fixed.LAUGH_WORD)).alias("laughter"),
            F.size(F.filter("_runs", lambda w: F.lower(w).rlike(fixed.SWEAR_WORD))).alias("swears"),
            low.contains('"').alias("quoted_echo"),
            (F.size("_w") <= 2).alias("is_short"),
        ),
    )
    return out.drop("_emoji", "_low", "_runs", "_w", "_sorted", "_pos", "_neg")
