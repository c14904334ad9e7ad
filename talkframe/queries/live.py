"""Streaming queries: each drains a file source with ``availableNow`` and is compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import views
from talkframe.plans import analyze
from talkframe.queries import learning
from talkframe.queries.context import MEMORY_SQL
from talkframe.queries.registry import over_messages, query
from talkframe.session import prepare, work_dir
from talkframe.streaming import live

CONV = "conversation_id"


def stream(spark, sf, path=None):
    """``events`` as a stream of messages, one conversation per user."""
    schema = views.table(spark, sf, "events").schema
    return _messages(prepare(spark).readStream.schema(schema).parquet(path or f"{sf}/events*.parquet"))


def arrived(spark, sf):
    """The same rows as a table."""
    return _messages(views.table(spark, sf, "events"))


def _messages(raw):
    return raw.select(
        F.col("user_id").alias(CONV), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.least("value", F.lit(100.0)).alias("tension"), F.col("event_type").alias("emotion"),
    )


_SHOWN = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query(
    "stream_sessions",
    f"""with x as (select user_id as c, ts, least(value, 100) as t, lag(ts) over (partition by user_id order by ts) as p from events),
g as (select *, sum(case when epoch_us(ts) - epoch_us(p) > 5400000000 then 1 else 0 end) over (partition by c order by ts) as s from x),
a as (select c, s, min(ts) as f, max(ts) as l, count(*) as n, avg(t) as m from g group by 1, 2)
select c as conversation_id, {_SHOWN.format(c='f')} as first_ts, {_SHOWN.format(c='l')} as last_ts, n as messages, round(m, 6) as mean_tension
from a""",
)
def stream_sessions(spark, sf):
    out, progress = live.run_available(live.sessions(stream(spark, sf)), "sessions")
    out = out.unionByName(live.open_sessions(arrived(spark, sf), live.watermark(progress)))
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")}
    return out.withColumns({**shown, "mean_tension": F.round("mean_tension", 6)})


@query("stream_dedup", "select user_id as conversation_id, event_id as message_id, least(value, 100) as tension from events")
def stream_dedup(spark, sf):
    twice = stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out, _ = live.run_available(live.without_repeats(twice), "dedup")
    return out.select(CONV, "message_id", "tension")


@query(
    "stream_tension",
    f"""with a as (select date_trunc('hour', ts) as w, count(*) as n, avg(least(value, 100)) as m, max(least(value, 100)) as pk,
  avg(case when value >= 60 then 1 else 0 end) as h from events group by 1)
select {_SHOWN.format(c='w')} as start, n as messages, round(m, 6) as mean_tension, pk as peak_tension, round(h, 6) as hot_share from a""",
)
def stream_tension(spark, sf):
    out, progress = live.run_available(live.tension_windows(stream(spark, sf)), "tension")
    out = out.unionByName(live.open_windows(arrived(spark, sf), live.watermark(progress)))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "messages", F.round("mean_tension", 6).alias("mean_tension"),
                      "peak_tension", F.round("hot_share", 6).alias("hot_share"))


@query(
    "stream_memory",
    over_messages(f"""behave as (select *, cast(length(text) < 20 as integer) as is_short from messages), {MEMORY_SQL}
select conversation_id, message_id, speaker_id, last_emotion, last_tone, last_sentiment, round(recent_tension, 6) as recent_tension, short_streak from mem"""),
)
def stream_memory(spark, sf):
    """Speaker state over live messages; the batch form is ``speaker_memory``."""
    rows = views.messages(prepare(spark), sf).select(CONV, "message_id", "speaker_id", "emotion", "tone", "sentiment", "tension",
                                            (F.length("text") < 20).cast("int").alias("is_short"))
    with live.rocksdb(spark):
        out, _ = live.run_available(live.speaker_memory(live.in_order(rows)), "memory")
    return out.withColumn("recent_tension", F.round("recent_tension", 6))


@query("stream_score", learning.SEQUENTIAL_SQL)
def stream_score(spark, sf, files=4):
    """Live messages scored on the model's own history, in files of mixed order; the batch form is ``predict_sequential``."""
    rows = views.messages(prepare(spark), sf).select(CONV, "pos", "message_id", "speaker_id", "ts", "text")
    path = work_dir(spark, "arrivals")
    rows.repartition(files, F.xxhash64(CONV, "pos")).write.parquet(path)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with live.rocksdb(spark):
        out, _ = live.run_available(live.score(arriving, learning.history_model()), "scores")
    return learning.sequential_columns(analyze.with_polarity(out))


@query(
    "stream_late",
    """with x as (select date_trunc('hour', ts) as w, event_id % 7 = 0 and day(ts) <= 7 as moved, ts from events),
mark as (select max(ts) - interval 10 minutes as m from x where not moved),
k as (select w from x, mark where not moved or w + interval 1 hour > date_trunc('milliseconds', m))
select count(distinct w) as windows, count(*) as messages, (select count(*) from x) - count(*) as late from k""",
)
def stream_late(spark, sf):
    """Events in two arrivals, the second one with every seventh event of the first week moved behind the watermark."""
    events = views.table(spark, sf, "events")
    path = work_dir(spark, "late")
    late = (F.col("event_id") % 7 == 0) & (F.dayofmonth("ts") <= 7)
    events.filter(~late).write.parquet(f"{path}/a")
    windows = live.tension_windows(stream(spark, sf, f"{path}/*"))
    target, mark = work_dir(spark, "late-out"), None
    for part in (None, events.filter(late)):
        if part is not None:
            part.write.parquet(f"{path}/b")
        q = (
            windows.writeStream.format("parquet").outputMode("append").option("path", target)
            .option("checkpointLocation", f"{target}-progress").trigger(availableNow=True).start()
        )
        q.awaitTermination()
        mark = live.watermark(q.recentProgress) or mark
    closed = spark.read.schema(windows.schema).parquet(target)
    return live.late_rows(arrived(spark, sf), closed.unionByName(live.open_windows(arrived(spark, sf), mark)))
