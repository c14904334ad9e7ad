"""Public label formats to the labelled message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.lookup import count_contains, mapped
from talkframe.functions.text import strip_space
from talkframe.operators import sequence as seq
from talkframe.operators.records import base_tension, emotion_sentiment
from talkframe.sources import tables


def labelled(df: DataFrame, emotion: Column, tone: Column, sarcasm: Column, topic: str) -> DataFrame:
    """Complete a message to the labelled layout; sentiment and tension follow from the emotion."""
    zero = F.lit(0)
    out = df.withColumns({"emotion": emotion, "tone": tone, "sarcasm": sarcasm, "irony": zero, "passive_aggression": zero})
    out = out.withColumns(
        {
            "sentiment": emotion_sentiment(F.col("emotion")),
            "tension": base_tension(F.col("emotion"), F.col("sarcasm"), F.col("passive_aggression")),
            "topic": F.lit(topic),
        }
    )
    return out.withColumn("escalation", (F.col("tension") >= fixed.ESCALATION_TENSION).cast("int"))


def priority_labels(df: DataFrame, source: str = "goe", names: list | None = None) -> DataFrame:
    """Rows (line_no, text, labels: array<int>) to one-message conversations; the first label in priority order wins."""
    table = F.array(*[F.lit(n) for n in (names or fixed.SOURCE_LABELS)])
    known = F.array_compact(F.transform("labels", lambda i: F.when(i >= 0, F.get(table, i))))
    emotion = F.coalesce(*[F.when(F.array_contains("_names", n), F.lit(e)) for n, e in fixed.LABEL_PRIORITY], F.lit("neutral"))
    rows = df.withColumn("_names", known).withColumn("text", strip_space(F.col("text"))).filter("text != ''")
    rows = rows.select(
        F.concat(F.lit(f"{source}_"), F.col("line_no").cast("string")).alias("conversation_id"), F.lit(1).cast("long").alias("message_id"),
        F.lit("anon").alias("speaker_id"), "text", "_names",
    )
    return labelled(rows, emotion, F.lit("casual"), F.lit(0), "reddit_comment").drop("_names")


def read_priority_labels(spark: SparkSession, path: str | list[str], source: str = "goe", names: list | None = None) -> DataFrame:
    """JSON lines {text, labels}; a line's number in the file names its conversation."""
    return priority_labels(tables.numbered_jsonl(spark, path, "text string, labels array<int>"), source, names)


def read_author_threads(spark: SparkSession, path: str | list[str], source: str = "sarc") -> DataFrame:
    """JSON lines {label, comment, author}, threaded by author in file order."""
    return author_threads(tables.numbered_jsonl(spark, path, "label int, comment string, author string"), source)


def read_dialogues(spark: SparkSession, utterances: str | list[str], emotions: str | list[str], acts: str | list[str] | None = None, source: str = "dd") -> DataFrame:
    """Line-aligned text files, one dialogue per line; dialogue acts are aligned too but decide nothing, as there is no label for them."""
    paths = {"u": utterances, "e": emotions} | ({"a": acts} if acts else {})
    return aligned_dialogues(tables.read_aligned(spark, paths), source)


def author_threads(df: DataFrame, source: str = "sarc") -> DataFrame:
    """Rows (line_no, label, comment, author) to one conversation per author, numbered in file order."""
    rows = df.withColumn("text", strip_space(F.col("comment"))).filter("text != ''")
    rows = rows.withColumn("speaker_id", F.coalesce("author", F.concat(F.lit("anon"), F.col("line_no").cast("string"))))
    rows = seq.number(rows, ["speaker_id"], ["line_no"], F.expr(f"line_no div {seq.block_rows(df)}"))
    low = F.lower("text")
    balance = count_contains(low, fixed.THREAD_POSITIVE) - count_contains(low, fixed.THREAD_NEGATIVE)
    emotion = F.when(balance < 0, "frustration").when(balance > 0, "joy").otherwise("neutral")
    label = F.coalesce("label", F.lit(0))
    rows = rows.select(
        F.concat(F.lit(f"{source}_"), "speaker_id").alias("conversation_id"), (F.col("pos") + 1).alias("message_id"),
        "speaker_id", "text", label.cast("int").alias("_label"),
    )
    return labelled(rows, emotion, F.when(F.col("_label") == 1, "sarcastic").otherwise("casual"), F.col("_label"), "reddit_thread").drop("_label")


def dialogues(utterances: DataFrame, emotions: DataFrame, source: str = "dd") -> DataFrame:
    """Line-aligned files (line_no, line): utterances split by ``__eou__`` paired with emotion numbers, shorter wins."""
    return aligned_dialogues(utterances.select("line_no", F.col("line").alias("u")).join(emotions.select("line_no", F.col("line").alias("e")), "line_no"), source)


def aligned_dialogues(both: DataFrame, source: str = "dd") -> DataFrame:
    """The same from one table (line_no, u, e)."""
    said = F.filter(F.transform(F.split("u", "__eou__"), lambda x: strip_space(x)), lambda x: x != "")
    felt = F.transform(F.filter(F.split("e", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("int"))
    rows = both.select("line_no", said.alias("u"), felt.alias("e"))
    n = F.least(F.size("u"), F.size("e"))
    pairs = F.zip_with(F.slice("u", 1, n), F.slice("e", 1, n), lambda u, e: F.struct(u.alias("u"), e.alias("e")))
    rows = rows.select("line_no", F.posexplode(pairs).alias("at", "t"))
    names = F.array(*[F.lit(x) for x in fixed.DIALOGUE_EMOTIONS])
    emotion = F.coalesce(F.when(F.col("_e") >= 0, F.get(names, F.col("_e"))), F.lit("neutral"))
    rows = rows.select(
        F.concat(F.lit(f"{source}_d"), F.col("line_no").cast("string")).alias("conversation_id"), (F.col("at") + 1).cast("long").alias("message_id"),
        F.when(F.col("at") % 2 == 0, "A").otherwise("B").alias("speaker_id"), F.col("t.u").alias("text"), F.col("t.e").alias("_e"),
    )
    return labelled(rows, emotion, mapped(emotion_sentiment(emotion), fixed.SENTIMENT_TONE), F.lit(0), "daily_dialogue").drop("_e")
