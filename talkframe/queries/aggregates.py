"""Queries over records, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import fixed, views
from talkframe.operators import profiles, records, temporal
from talkframe.operators import segments as seg
from talkframe.queries.context import TIME_SQL
from talkframe.queries.ordered import RECOVERY_SQL, TRAJECTORY_SQL, TURNING_SQL, sql_map
from talkframe.queries.registry import over_messages, over_signals, query

CONV = "conversation_id"


def rounded(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(
    "timeline",
    over_signals("select conversation_id, message_id, speaker_id, emotion, tension, sentiment, tone, p as sarcasm from signals"),
)
def timeline(spark, sf):
    return records.timeline(views.signals(spark, sf))


@query(
    "preview",
    over_signals("select conversation_id, message_id, speaker_id, text from signals where message_id <= 10"),
)
def preview(spark, sf):
    return records.preview(views.signals(spark, sf)).select(CONV, "message_id", "speaker_id", "text")


@query(
    "fill_defaults",
    """select conv_id as conversation_id, turn as pos, turn + 1 as message_id,
 case when turn % 3 = 0 then concat('speaker_', turn % 2 + 1) else role end as speaker_id,
 case when turn % 2 = 0 then 'generic' else 'slack' end as platform from conversations""",
)
def fill_defaults(spark, sf):
    t = views.table(spark, sf, "conversations")
    raw = t.select(
        F.col("conv_id").alias(CONV), F.col("turn").alias("pos"),
        F.when(F.col("turn") % 2 == 1, F.col("turn") + 1).alias("message_id"),
        F.when(F.col("turn") % 3 != 0, F.col("role")).alias("speaker_id"),
        F.when(F.col("turn") % 2 == 1, "slack").alias("platform"),
    )
    return records.fill_defaults(raw)


@query(
    "derive_fields",
    over_signals("""select conversation_id, message_id, tension, cast(tension >= 60 as integer) as escalation,
 case when event_id % 4 = 0 then 'unknown' else event_type end as topic from signals"""),
)
def derive_fields(spark, sf):
    rows = views.signals(spark, sf).select(CONV, "message_id", "tension", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("topic"))
    return records.derive_fields(rows)


@query(
    "emotion_valence",
    over_messages(f"""select conversation_id, message_id, emotion, {sql_map('emotion', fixed.EMOTION_SENTIMENT)} as valence,
 least({sql_map('emotion', fixed.EMOTION_TENSION)} + 15 * sarcasm + 12 * passive_aggression, 100) as base_tension from messages"""),
)
def emotion_valence(spark, sf):
    return views.messages(spark, sf).select(
        CONV, "message_id", "emotion", records.emotion_sentiment(F.col("emotion")).alias("valence"),
        records.base_tension(F.col("emotion"), F.col("sarcasm"), F.col("passive_aggression")).alias("base_tension"),
    )


@query(
    "gold_pred_join",
    over_signals("""select g.conversation_id, g.message_id, g.emotion as gold, s.pred_emotion as pred, g.emotion = s.pred_emotion as correct
 from signals g join signals s using (conversation_id, message_id)"""),
)
def gold_pred_join(spark, sf):
    rows = views.signals(spark, sf)
    gold = rows.select(CONV, "message_id", F.col("emotion").alias("gold"))
    pred = rows.select(CONV, "message_id", F.col("pred_emotion").alias("pred"))
    return records.gold_and_predicted(gold, pred)


@query(
    "corpus_stats",
    over_messages("""
select count(distinct conversation_id) as conversations, count(*) as messages,
 round((select avg(s) from (select count(distinct speaker_id) as s from messages group by conversation_id)), 6) as speakers_per_conversation,
 round(count(*) / count(distinct conversation_id), 6) as messages_per_conversation,
 round(avg(sarcasm), 6) as sarcasm_rate, round(avg(irony), 6) as irony_rate, round(avg(passive_aggression), 6) as passive_aggression_rate,
 count(*) filter (sentiment = 'positive') as n_positive, count(*) filter (sentiment = 'neutral') as n_neutral,
 count(*) filter (sentiment = 'negative') as n_negative, round(avg(tension), 6) as tension_mean from messages"""),
)
def corpus_stats(spark, sf):
    out = profiles.corpus_stats(views.messages(spark, sf))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


SUMMARY_SQL = """
emo as (select conversation_id, emotion, count(*) as k, row_number() over (partition by conversation_id order by count(*) desc, emotion) as rk
  from signals group by 1, 2),
ton as (select conversation_id, tone, count(*) as k, row_number() over (partition by conversation_id order by count(*) desc, tone) as rk
  from signals group by 1, 2),
tops as (select conversation_id, string_agg(emotion || ':' || k, ',' order by rk) as top_emotions from emo where rk <= 3 group by 1),
topt as (select conversation_id, string_agg(tone || ':' || k, ',' order by rk) as top_tones from ton where rk <= 6 group by 1),
base as (select conversation_id, count(*) as n_messages, count(distinct speaker_id) as n_speakers,
  count(*) filter (sentiment = 'positive') as n_positive, count(*) filter (sentiment = 'neutral') as n_neutral,
  count(*) filter (sentiment = 'negative') as n_negative, round(avg(p), 6) as sarcasm_level, round(avg(irony_p), 6) as irony_level,
  round(avg(pa_p), 6) as passive_aggression_level, round(avg(tension), 6) as mean_tension, max(tension) as peak_tension
  from signals group by 1),
summ as (select base.*, emo.emotion as dominant_emotion, traj.trajectory, top_emotions, top_tones from base
  join tops on tops.conversation_id = base.conversation_id join topt on topt.conversation_id = base.conversation_id
  join emo on emo.conversation_id = base.conversation_id and rk = 1 join traj on traj.conversation_id = base.conversation_id)"""
_LEVELS = ("sarcasm_level", "irony_level", "passive_aggression_level", "mean_tension")


@query("conversation_summary", over_signals(f"{TRAJECTORY_SQL.strip()}, {SUMMARY_SQL.strip()}\nselect * from summ"))
def conversation_summary(spark, sf):
    return rounded(_shown(profiles.conversation_summary(views.placed_signals(spark, sf))), *_LEVELS)


def _shown(summary):
    return summary.withColumns({c: F.expr(f"array_join(transform({c}, x -> concat(x.label, ':', x.n)), ',')") for c in ("top_emotions", "top_tones")})


@query(
    "conversation_block",
    over_messages("""
select conversation_id, min_by(case when message_id % 2 = 1 then 'generic' else 'slack' end, message_id) as platform,
 count(*) as message_count, count(distinct speaker_id) as n_speakers, string_agg(distinct speaker_id, ',' order by speaker_id) as speakers,
 strftime(arg_min_null(ts, message_id), '%Y-%m-%d %H:%M:%S') as first_timestamp,
 strftime(arg_max_null(ts, message_id), '%Y-%m-%d %H:%M:%S') as last_timestamp, '1.0.0' as schema_version
from messages group by 1"""),
)
def conversation_block(spark, sf):
    rows = views.messages(spark, sf).withColumn("platform", F.when(F.col("message_id") % 2 == 1, "generic").otherwise("slack"))
    return profiles.conversation_block(rows).withColumn("speakers", F.array_join("speakers", ","))


@query(
    "speaker_profiles",
    over_signals("""
select conversation_id, speaker_id, count(*) as messages, round(avg(tension), 6) as avg_tension, max(tension) as max_tension,
 round(avg(case when p >= 0.5 then 1 else 0 end), 6) as sarcastic_share,
 round(avg(case when pa_p >= 0.5 then 1 else 0 end), 6) as passive_aggressive_share,
 round(avg(case when tension >= 60 then 1 else 0 end), 6) as high_tension_share
from signals group by 1, 2"""),
)
def speaker_profiles(spark, sf):
    out = profiles.speaker_profiles(views.signals(spark, sf))
    return rounded(out, "avg_tension", "sarcastic_share", "passive_aggressive_share", "high_tension_share")


@query(
    "topk_per_group",
    over_signals("""
l as (select conversation_id, speaker_id, 'emotion' as kind, emotion as label from signals
  union all select conversation_id, speaker_id, 'tone', tone from signals
  union all select conversation_id, speaker_id, 'sentiment', sentiment from signals),
c as (select conversation_id, speaker_id, kind, label, count(*) as n from l group by all),
r as (select *, round(n / sum(n) over (partition by conversation_id, speaker_id, kind), 6) as share,
  row_number() over (partition by conversation_id, speaker_id, kind order by n desc, label) as rank from c)
select conversation_id, speaker_id, kind, label, n, share, cast(rank as integer) as rank from r
where rank <= case kind when 'sentiment' then 3 else 4 end"""),
)
def topk_per_group(spark, sf):
    out = profiles.label_shares(views.signals(spark, sf), [CONV, "speaker_id"], {"emotion": 4, "tone": 4, "sentiment": 3})
    return rounded(out, "share")


@query(
    "label_distribution",
    over_signals("""
c as (select 'gold' as side, emotion as label, count(*) as n from signals group by 2
  union all select 'pred', pred_emotion, count(*) from signals group by 2)
select side, label, n, cast(row_number() over (partition by side order by n desc, label) as integer) as rank from c"""),
)
def label_distribution(spark, sf):
    rows = views.signals(spark, sf).select(F.inline(F.array(
        F.struct(F.lit("gold").alias("side"), F.col("emotion").alias("label")),
        F.struct(F.lit("pred").alias("side"), F.col("pred_emotion").alias("label")),
    )))
    counts = rows.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"))
    order = temporal.seq.Window.partitionBy("side").orderBy(F.col("n").desc(), "label")  # one row per label
    return counts.withColumn("rank", F.row_number().over(order))


@query(
    "scenario_summary",
    over_signals(f"""{TRAJECTORY_SQL.strip()}, {SUMMARY_SQL.strip()}, {TURNING_SQL.strip()}, {TIME_SQL.format(src="signals").strip()},
nt as (select conversation_id, count(*) as n from tp group by 1),
ns as (select conversation_id, count(distinct segment_id) as n_segments from tseg group by 1)
select summ.*, coalesce(nt.n, 0) as n_turning_points, n_segments from summ left join nt using (conversation_id) join ns using (conversation_id)"""),
)
def scenario_summary(spark, sf):
    rows = views.placed_signals(spark, sf)
    timed = seg.time_segments(rows).withColumn("method", F.lit("time-gap"))
    return rounded(_shown(profiles.scenario_summary(rows, seg.segment_list(timed))), *_LEVELS)


@query(
    "conversation_overview",
    over_signals(f"""{TRAJECTORY_SQL.strip()}, {RECOVERY_SQL.strip()}, {TURNING_SQL.strip()},
nt as (select conversation_id, count(*) as n from tp group by 1),
ns as (select conversation_id, count(distinct speaker_id) as n_speakers, round(avg(tension), 6) as mean_tension from signals group by 1)
select traj.*, coalesce(nt.n, 0) as n_turning_points, n_speakers, mean_tension, recovered
from traj left join nt using (conversation_id) join ns using (conversation_id) join rec using (conversation_id)"""),
)
def conversation_overview(spark, sf):
    rows = views.placed_signals(spark, sf)
    tp = temporal.turning_points(rows).groupBy(CONV).agg(F.count(F.lit(1)).alias("n_turning_points"))
    per = rows.groupBy(CONV, "speaker_id").agg(F.sum("tension").alias("t"), F.count(F.lit(1)).alias("k"))
    speakers = per.groupBy(CONV).agg(F.count(F.lit(1)).alias("n_speakers"), (F.sum("t") / F.sum("k")).alias("mean_tension"))
    out = temporal.trajectory(rows).join(tp, CONV, "left").join(speakers, CONV).join(temporal.recovery(rows), CONV)
    out = out.withColumn("n_turning_points", F.coalesce("n_turning_points", F.lit(0)))
    return rounded(out, "escalation_rate", "start_tension", "middle_tension", "end_tension", "confidence", "mean_tension")


@query(
    "empty_conversation",
    over_signals("""
ids as (select distinct user_id * 10 + 9 as conversation_id from events union select distinct conversation_id from signals),
c as (select conversation_id, count(*) as n, avg(tension) as m, max(tension) as pk from signals group by 1)
select ids.conversation_id, coalesce(n, 0) as n_messages, round(coalesce(m, 0), 6) as mean_tension, coalesce(pk, 0) as peak_tension,
 case when n is null then 'stable' end as trajectory_if_empty from ids left join c using (conversation_id)"""),
)
def empty_conversation(spark, sf):
    rows = views.signals(spark, sf)
    ids = rows.select((F.col("user_id") * 10 + 9).alias(CONV)).unionByName(rows.select(CONV)).distinct()
    stats = rows.groupBy(CONV).agg(F.count(F.lit(1)).alias("n"), F.avg("tension").alias("m"), F.max("tension").alias("pk"))
    return ids.join(stats, CONV, "left").select(
        CONV, F.coalesce("n", F.lit(0)).alias("n_messages"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_tension"),
        F.coalesce("pk", F.lit(0.0)).alias("peak_tension"), F.when(F.col("n").isNull(), "stable").alias("trajectory_if_empty"),
    )
