"""Live conversations with Structured Streaming: gap sessions, duplicate ids, tension windows, speaker state, late rows.

Sources are any streaming ``messages`` with an event-time column ``ts``. ``run_available`` drains a source into a table
on the shared folder, which is how the batch checks use these operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkframe import fixed
from talkframe.functions import text as text_features
from talkframe.operators import learn
from talkframe.session import work_dir

CONV = "conversation_id"
BATCH_ROWS = 250_000  # about as many rows of a table in order arrive in one micro-batch
PIECE_ROWS = 10_000  # rows given out together
BUCKETS = 1024  # groups of conversations whose state is handled in one call
WAIT = 16  # positions of a conversation whose waiting messages are stored together
DAY = 86_400_000_000  # microseconds


def sessions(stream: DataFrame, gap: str = "90 minutes", delay: str = "10 minutes") -> DataFrame:
    """One row per closed session: a silence longer than ``gap`` ends it. Emitted once the watermark passes its end."""
    s = stream.withWatermark("ts", delay).groupBy(CONV, F.session_window("ts", gap).alias("w"))
    return s.agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("messages"), F.avg("tension").alias("mean_tension")
    ).drop("w")


def without_repeats(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First arrival of every message id; repeats within the watermark delay are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([CONV, "message_id"])


def tension_windows(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tension per fixed window, over all conversations. Partial sums are combined before the shuffle."""
    hot = (F.col("tension") >= fixed.ESCALATION_TENSION).cast("double")
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("messages"), F.avg("tension").alias("mean_tension"), F.max("tension").alias("peak_tension"), F.avg(hot).alias("hot_share")
    ).select(F.col("w.start").alias("start"), "messages", "mean_tension", "peak_tension", "hot_share")


def in_buckets(stream: DataFrame, *ids: str) -> GroupedData:
    """Rows grouped by a hash of ``ids``: state calls take many short conversations at once. Null ids get buckets of their own, since pandas
    would turn whole numbers beside them into floats."""
    bucket = F.pmod(F.hash(*ids), F.lit(BUCKETS))
    for i, c in enumerate(ids):
        bucket = bucket + F.when(F.col(c).isNull(), F.lit(BUCKETS << i)).otherwise(0)
    return stream.withColumn("_bucket", bucket).groupBy("_bucket")


def plain(value):
    """A pandas cell as the state store takes it."""
    return None if pd.isna(value) else value.item() if isinstance(value, np.generic) else value


class SpeakerState(StatefulProcessor):
    """Per (conversation, speaker): last labels, the last five tensions and the run of short messages. The rows of one micro-batch are taken
    in order of ``message_id``, so the result does not depend on how the batch was partitioned. Only one micro-batch's rows of a bucket of
    speakers are ever held: the source bounds them (``in_order``, or its own ``maxFilesPerTrigger`` and the like), the length of its table doesn't.

    State is constant per speaker; with ``ttl_ms`` it expires after that long without messages.
    """

    def __init__(self, ids: str, window: int = 5, ttl_ms: int | None = None):
        self.ids, self.window, self.ttl_ms = ids, window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "emotion string, tone string, sentiment string, tensions array<double>, streak bigint"
        self.state = handle.getMapState("speakers", self.ids, schema, *([self.ttl_ms] if self.ttl_ms else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in rows]  # one bucket's rows of one micro-batch
        if not held:
            return
        pdf = pd.concat(held)
        del held
        pdf = pdf.iloc[np.lexsort([pdf["message_id"], *(pd.factorize(pdf[c])[0] for c in ("speaker_id", CONV))])]
        who, known = None, None
        for low in range(0, len(pdf), PIECE_ROWS):
            out = []
            for r in pdf.iloc[low : low + PIECE_ROWS].itertuples(index=False):
                now = (plain(r.conversation_id), plain(r.speaker_id))
                if now != who:
                    if known:
                        self.state.updateValue(who, known)
                    who, known = now, self.state.getValue(now) or (None, None, None, [], 0)
                emotion, tone, sentiment, tensions, streak = known
                mean = sum(tensions) / len(tensions) if len(tensions) else None
                out.append((who[0], r.message_id, who[1], emotion, tone, sentiment, mean, streak))
                known = (r.emotion, r.tone, r.sentiment, [*tensions, float(r.tension)][-self.window :], streak + 1 if r.is_short else 0)
            yield pd.DataFrame(out, columns=MEMORY_COLUMNS)
        self.state.updateValue(who, known)

    def close(self) -> None:
        pass


MEMORY_COLUMNS = [CONV, "message_id", "speaker_id", "last_emotion", "last_tone", "last_sentiment", "recent_tension", "short_streak"]


def speaker_memory(stream: DataFrame, window: int = 5, ttl_ms: int | None = None) -> DataFrame:
    """Live form of the speaker memory; the session must use the RocksDB state store.

    ``ttl_ms`` suits a continuously running query: expiry is by processing time, which never lets a drain-once run end.
    """
    ids = [f"{c} {stream.schema[c].dataType.simpleString()}" for c in MEMORY_COLUMNS[:3]]
    shown = ", ".join([*ids, *(f"{c} string" for c in MEMORY_COLUMNS[3:6]), "recent_tension double", "short_streak bigint"])
    return in_buckets(stream, CONV, "speaker_id").transformWithStateInPandas(
        statefulProcessor=SpeakerState(f"{ids[0]}, {ids[2]}", window, ttl_ms), outputStructType=shown, outputMode="append",
        timeMode="processingTime" if ttl_ms else "none",
    )


class ConversationScorer(StatefulProcessor):
    """Per conversation: the ring of its last messages, its most tense older ones, every speaker's last labels and tensions, and the heads.

    Messages are scored in order of ``pos``, which counts a conversation's messages from 0. Those that come before an earlier one wait in
    the state store, ``WAIT`` positions together, until the missing one arrives. So neither the files' order nor their number shows in the
    result. One piece of a bucket's rows is held at a time; the state is constant per conversation and speaker, besides what waits.
    """

    def __init__(self, model: learn.Model, ids: str, k: int = 4, window: int = 5, picks: int = 3):
        self.model, self.ids, self.sizes = model, ids, (k, window, picks)

    def init(self, handle: StatefulProcessorHandle) -> None:
        turns = "array<struct<heat:double,place:bigint,tokens:array<string>>>"
        self.talks = handle.getMapState("talks", self.ids, f"next bigint, clock bigint, waits bigint, recent {turns}, older {turns}")
        self.speakers = handle.getMapState("speakers", f"{self.ids}, speaker string", "emotion string, tone string, sentiment string, tensions array<double>")
        message = "pos:bigint,message_id:bigint,speaker:string,clock:bigint,tokens:array<string>,behave:array<double>"
        self.waiting = handle.getMapState("waiting", f"{self.ids}, part bigint", f"messages array<struct<{message}>>")
        self.scorer = learn.Recurrence(self.model, *self.sizes)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            talks, out = {}, []
            for r in pdf.itertuples(index=False):
                talks.setdefault(plain(r.conversation_id), {})[int(r.pos)] = (
                    int(r.message_id), r.speaker_id, None if pd.isna(r.clock) else int(r.clock), [str(t) for t in r.tokens], [float(x) for x in r.behave])
            for conv, held in talks.items():
                out.extend(self.advance(conv, held))
            yield pd.DataFrame(out, columns=[CONV, "message_id", "speaker_id", *learn.SCORES])

    def advance(self, conv, held: dict[int, tuple]) -> Iterator[tuple]:
        """Score what follows on, with the messages of ``held`` (by position); the rest waits."""
        at, clock, waits, recent, older = self.talks.getValue((conv,)) or (0, None, 0, [], [])
        recent, older = ([(h, p, list(t)) for h, p, t in turns] for turns in (recent, older))
        first, speakers, seen = at, {}, set()
        held = {pos: row for pos, row in held.items() if pos >= at}  # others were delivered before

        def take(part: int) -> None:
            nonlocal waits
            if waits and part not in seen:
                seen.add(part)
                stored = self.waiting.getValue((conv, part))
                if stored:
                    self.waiting.removeKey((conv, part))
                    waits -= len(stored[0])
                    for pos, *row in stored[0]:
                        held.setdefault(pos, tuple(row))

        while True:
            if at not in held:
                take(at // WAIT)
            if at not in held:
                break
            message, speaker, now, tokens, behave = held.pop(at)
            who = "" if speaker is None else speaker
            if who not in speakers:
                speakers[who] = (self.speakers.getValue((conv, who)) if first else None) or learn.NEW_SPEAKER
            if clock is not None and now is not None:
                behave = [*behave[:-1], min(max(now - clock, 0), DAY) / 3_600_000_000]
            scores, recent, older, speakers[who] = self.scorer.step(recent, older, speakers[who], at, list(tokens), np.asarray(behave, float))
            yield (conv, message, speaker, *scores)
            at, clock = at + 1, now
        for part in {pos // WAIT for pos in held}:
            take(part)
        left: dict[int, list] = {}
        for pos, (message, speaker, now, tokens, behave) in sorted(held.items()):
            left.setdefault(pos // WAIT, []).append((pos, message, speaker, now, list(tokens), [float(x) for x in behave]))
        for part, messages in left.items():
            self.waiting.updateValue((conv, part), (messages,))
            waits += len(messages)
        for who, (emotion, tone, sentiment, tensions) in speakers.items():
            self.speakers.updateValue((conv, who), (emotion, tone, sentiment, [float(x) for x in tensions]))
        self.talks.updateValue((conv,), (at, clock, waits, recent, older))

    def close(self) -> None:
        pass


def score(stream: DataFrame, model: learn.Model, k: int = 4, window: int = 5, picks: int = 3) -> DataFrame:
    """Live form of ``learn.predict_sequential``: the same rows, whatever the arrival order. ``stream``: conversation_id, pos (from 0,
    without gaps), message_id, speaker_id, ts (may be null), text. The session must use the RocksDB state store.
    """
    rows = text_features.behaviour(stream)  # the gap to the previous message is known in the state only
    clock = F.unix_micros(F.col("ts").cast("timestamp")).alias("clock")
    rows = learn.read_ahead(rows.select("*", clock), "clock")
    ids = [f"{CONV} {stream.schema[CONV].dataType.simpleString()}", "message_id bigint", "speaker_id string"]
    shown = ", ".join([*ids, *(f"{c} {t}" for c, t in zip(learn.SCORES, learn.SCORE_KINDS))])
    return in_buckets(rows, CONV).transformWithStateInPandas(
        statefulProcessor=ConversationScorer(model, ids[0], k, window, picks), outputStructType=shown, outputMode="append", timeMode="none")


def in_order(rows: DataFrame, batch_rows: int = BATCH_ROWS, least: int = 4) -> DataFrame:
    """A table as a stream in order of ``message_id``: at least ``least`` micro-batches of about ``batch_rows`` rows (ranges are sampled).

    One file per micro-batch; files are written one after another, since a file source takes them by time. Runs jobs."""
    spark = rows.sparkSession
    ranges, path = work_dir(spark, "ranges"), work_dir(spark, "arrivals")
    n = max(least, -(-rows.count() // batch_rows))
    dealt = rows.repartitionByRange(n, "message_id", CONV).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(ranges)
    parts = spark.read.schema(dealt.schema).parquet(ranges)
    for i in range(n):
        parts.filter(F.col("_range") == i).drop("_range").coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the RocksDB state store; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_available(result: DataFrame, name: str) -> tuple[DataFrame, list]:
    """Drain the source once into a table on the shared folder; also returns the progress reports."""
    spark: SparkSession = result.sparkSession
    path = work_dir(spark, name)
    query = (
        result.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path), query.recentProgress


def watermark(progress: list) -> str | None:
    """The last event-time watermark of a drained query."""
    marks = [p["eventTime"]["watermark"] for p in progress if "watermark" in p["eventTime"]]
    return max(marks) if marks else None


def open_windows(arrived: DataFrame, mark: str | None, width: str = "1 hour") -> DataFrame:
    """The tension windows a drained stream still holds: no row of theirs came late, so a batch over what arrived gives them."""
    hot = (F.col("tension") >= fixed.ESCALATION_TENSION).cast("double")
    rows = arrived.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("messages"), F.avg("tension").alias("mean_tension"), F.max("tension").alias("peak_tension"), F.avg(hot).alias("hot_share"))
    rows = rows if mark is None else rows.filter(F.col("w.end") > F.lit(mark).cast("timestamp"))
    return rows.select(F.col("w.start").alias("start"), "messages", "mean_tension", "peak_tension", "hot_share")


def open_sessions(arrived: DataFrame, mark: str | None, gap: str = "90 minutes") -> DataFrame:
    """The sessions a drained stream still holds."""
    rows = arrived.groupBy(CONV, F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("messages"), F.avg("tension").alias("mean_tension"))
    # not by the window column: a condition on it would be pushed below the merging of sessions
    rows = rows if mark is None else rows.filter(F.col("last_ts") + F.expr(f"interval {gap}") > F.lit(mark).cast("timestamp"))
    return rows.drop("w")


def late_rows(arrived: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: windows delivered (open ones included), their messages, and the rows that came behind the watermark - what arrived and
    lies in no window. Counted on rows, so it does not depend on partial aggregation or on how long progress is kept."""
    total = arrived.agg(F.lit(0).cast("long").alias("windows"), F.lit(0).cast("long").alias("messages"), F.count(F.lit(1)).alias("rows"))
    kept = windows.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.lit(0).cast("long").alias("rows"))
    both = total.unionByName(kept).agg(*[F.sum(c).alias(c) for c in ("windows", "messages", "rows")])
    return both.select("windows", "messages", (F.col("rows") - F.col("messages")).alias("late"))
