"""Queries over context windows, speaker memory and topic segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import fixed, views
from talkframe.functions import text
from talkframe.operators import context, segments
from talkframe.queries import sqltext as t
from talkframe.queries.ordered import sql_map
from talkframe.queries.registry import over_messages, over_signals, query

CONV = "conversation_id"


@query(
    "response_gap",
    over_messages(f"{t.GAPS_SQL}\nselect conversation_id, message_id, round(gap_hours, 6) as gap_hours from gaps"),
)
def response_gap(spark, sf):
    out = context.response_gap(views.messages(spark, sf))
    return out.select(CONV, "message_id", F.round("gap_hours", 6).alias("gap_hours"))


@query(
    "context_recent",
    over_messages("""
select conversation_id, message_id, coalesce(string_agg(text, ' || ') over
  (partition by conversation_id order by message_id rows between 4 preceding and 1 preceding), '') as recent
from messages"""),
)
def context_recent(spark, sf):
    return context.context_window(views.messages(spark, sf)).select(CONV, "message_id", "recent")


@query(
    "context_salient",
    over_signals("""
older as (select a.conversation_id, a.message_id, b.text, row_number() over
   (partition by a.conversation_id, a.message_id order by b.tension desc, b.message_id) as rk
  from signals a join signals b on a.conversation_id = b.conversation_id and b.message_id < a.message_id - 4),
j as (select conversation_id, message_id, string_agg(text, ' :: ' order by rk) as older from older where rk <= 3 group by 1, 2),
rec as (select conversation_id, message_id, coalesce(string_agg(text, ' || ') over
  (partition by conversation_id order by message_id rows between 4 preceding and 1 preceding), '') as recent from signals)
select conversation_id, message_id, coalesce(older, '') as older,
  case when older is null then recent else concat(older, ' || ', recent) end as context_text
from rec left join j using (conversation_id, message_id)"""),
)
def context_salient(spark, sf):
    return context.context_window(views.signals(spark, sf)).select(CONV, "message_id", "older", "context_text")


@query(
    "extractive_summary",
    over_signals("""
b as (select conversation_id, pos // 10 as part, text, row_number() over
  (partition by conversation_id, pos // 10 order by tension desc, pos) as rk from signals)
select conversation_id, substr(string_agg(text, ' ' order by part), 1, 600) as summary
from b where rk = 1 group by 1"""),
)
def extractive_summary(spark, sf):
    return context.extractive_summary(views.signals(spark, sf))


MEMORY_SQL = """mem as (
 select *, lag(emotion) over w as last_emotion, lag(tone) over w as last_tone, lag(sentiment) over w as last_sentiment,
  avg(tension) over (w rows between 5 preceding and 1 preceding) as recent_tension,
  row_number() over w - 1 - coalesce(max(case when is_short = 0 then rn end) over
    (w rows between unbounded preceding and 1 preceding), 0) as short_streak
 from (select *, row_number() over (partition by conversation_id, speaker_id order by message_id) as rn from behave) b
 window w as (partition by conversation_id, speaker_id order by message_id))"""


def remembered(spark, sf):
    rows = text.behaviour(context.response_gap(views.messages(spark, sf)), gap="gap_hours")
    return context.speaker_memory(rows)


@query(
    "speaker_memory",
    over_messages(f"""{t.GAPS_SQL}, {t.BEHAVE_SQL}, {MEMORY_SQL}
select conversation_id, message_id, speaker_id, last_emotion, last_tone, last_sentiment,
  round(recent_tension, 6) as recent_tension, short_streak from mem"""),
)
def speaker_memory(spark, sf):
    return remembered(spark, sf).select(
        CONV, "message_id", "speaker_id", "last_emotion", "last_tone", "last_sentiment",
        F.round("recent_tension", 6).alias("recent_tension"), "short_streak",
    )


MEMORY_VECTOR_SQL = f"""dims as (select *, {sql_map('last_emotion', fixed.AROUSAL, 0)} as a,
   {sql_map('last_emotion', fixed.VALENCE, 0)} as v, {sql_map('last_tone', fixed.WARMTH, 0)} as w,
   {sql_map('last_sentiment', fixed.SENTIMENT_CODE, 0)} as s, coalesce(recent_tension, 0) / 100 as h from mem)"""


@query(
    "memory_vector",
    over_messages(f"""{t.GAPS_SQL}, {t.BEHAVE_SQL}, {MEMORY_SQL}, {MEMORY_VECTOR_SQL}
select conversation_id, message_id, a as m0, v as m1, w as m2, s as m3, round(h, 6) as m4,
  round(v * negative_hits / 3, 6) as m5, round(w * exclamations / 3, 6) as m6, round(h * negative_hits / 3, 6) as m7,
  round(is_short * (1 - (w + 1) / 2), 6) as m8, round(gap_hours / 24 * h, 6) as m9 from dims"""),
)
def memory_vector(spark, sf):
    out = context.memory_vector(remembered(spark, sf))
    return out.select(CONV, "message_id", *[F.round(f"m{i}", 6).alias(f"m{i}") for i in range(10)])


TIME_SQL = """
lastts as (select *, max(ts) over (partition by conversation_id order by pos rows between unbounded preceding and 1 preceding) as mx,
  last_value(ts ignore nulls) over (partition by conversation_id order by pos rows between unbounded preceding and 1 preceding) as prev
  from {src}),
tseg as (select *, cast(sum(case when epoch_us(ts) - epoch_us(prev) > 5400000000 then 1 else 0 end) over
  (partition by conversation_id order by pos) as bigint) as segment_id from lastts)"""


@query(
    "segments_time",
    over_signals(TIME_SQL.format(src="signals").strip() + "\nselect conversation_id, message_id, segment_id from tseg"),
)
def segments_time(spark, sf):
    return segments.time_segments(views.signals(spark, sf)).select(CONV, "message_id", "segment_id")


COHESION_SQL = """
tok as (select *, {tokens} as tok, count(*) over (partition by conversation_id) as n from {src}),
sides as (select *, list_distinct(flatten(list(tok) over (w rows between 5 preceding and 1 preceding))) as a,
   list_distinct(flatten(list(tok) over (w rows between current row and 4 following))) as b
  from tok window w as (partition by conversation_id order by pos)),
places as (select *, row_number() over (partition by conversation_id order by pos) as place,
   len(list_intersect(a, b)) / sqrt(len(a) * len(b)) as cos
  from sides where n >= 6 and pos >= 1 and len(a) > 0 and len(b) > 0),
near as (select *, coalesce(sum(cos) over (w rows between 2 preceding and 1 preceding), 0)
    + coalesce(sum(cos) over (w rows between 1 following and 2 following), 0) as total,
   count(cos) over (w rows between 2 preceding and 1 preceding)
    + count(cos) over (w rows between 1 following and 2 following) as cnt
  from places window w as (partition by conversation_id order by place)),
dips as (select conversation_id, pos, row_number() over (partition by conversation_id order by pos) as rk
  from near where cnt >= 2 and round(total / cnt - cos, 9) > cast(0.28 as double)),
scan(conversation_id, rk, last_cut, is_cut, pos) as (
  select conversation_id, rk, pos, true, pos from dips where rk = 1
  union all
  select d.conversation_id, d.rk, case when d.pos - last_cut >= 3 then d.pos else last_cut end, d.pos - last_cut >= 3, d.pos
  from scan join dips d on d.conversation_id = scan.conversation_id and d.rk = scan.rk + 1),
cseg as (select s.*, cast(sum(case when c.is_cut then 1 else 0 end) over
   (partition by s.conversation_id order by s.pos) as bigint) as segment_id
  from {src} s left join scan c on c.conversation_id = s.conversation_id and c.pos = s.pos)"""


@query(
    "segments_cohesion",
    over_signals(COHESION_SQL.format(src="signals", tokens=t.slang("text")).strip()
                 + "\nselect conversation_id, message_id, segment_id from cseg"),
)
def segments_cohesion(spark, sf):
    return segments.cohesion_segments(views.placed_signals(spark, sf)).select(CONV, "message_id", "segment_id")


TOPICS_SQL = f"""
timed as (select * from messages where conversation_id in (select conversation_id from messages where pos = 0 and ts is not null)),
plain as (select * from messages where conversation_id in (select conversation_id from messages where pos = 0 and ts is null)),
{TIME_SQL.format(src="timed").strip()},
{COHESION_SQL.format(src="plain", tokens=t.slang("text")).strip()},
allseg as (select conversation_id, message_id, segment_id, 'time-gap' as method from tseg
  union all select conversation_id, message_id, segment_id, 'cohesion' from cseg),
topics as (select conversation_id, segment_id, method, min(message_id) as start, max(message_id) as "end",
  count(*) as messages_analyzed from allseg group by 1, 2, 3)"""


@query("topic_segments", over_messages(TOPICS_SQL.strip() + "\nselect * from topics"))
def topic_segments(spark, sf):
    return segments.topic_segments(views.messages(spark, sf))


@query(
    "slang_tokens",
    over_messages(f"select conversation_id, message_id, array_to_string({t.slang('text')}, '|') as tokens from messages"),
)
def slang_tokens(spark, sf):
    return views.messages(spark, sf).select(
        CONV, "message_id", F.array_join(text.slang_tokens(F.col("text")), "|").alias("tokens")
    )


@query(
    "behavior_vector",
    over_messages(f"""{t.GAPS_SQL}, {t.BEHAVE_SQL}
select conversation_id, message_id, n_words, n_chars, exclamations, questions, repeated_punctuation,
 round(caps_share, 6) as caps_share, positive_hits, negative_hits, exaggeration_hits,
 round(emoji_polarity, 6) as emoji_polarity, emoji_sarcasm, laughter, ellipses, odd_quote_or_swear, is_short,
 round(gap_hours, 6) as gap_hours from behave"""),
)
def behavior_vector(spark, sf):
    out = text.behaviour(context.response_gap(views.messages(spark, sf)), gap="gap_hours")
    rounded = {c: F.round(c, 6) for c in ("caps_share", "emoji_polarity", "gap_hours")}
    return out.select(CONV, "message_id", *text.BEHAVIOUR).withColumns(rounded)
