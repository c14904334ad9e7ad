"""The full report over all conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import views
from talkframe.plans import analyze as whole
from talkframe.queries.context import TOPICS_SQL
from talkframe.queries.evidence import READ_SQL
from talkframe.queries.learning import HISTORY_SQL, history_model
from talkframe.queries.ordered import TRAJECTORY_SQL, TURNING_SQL
from talkframe.queries.registry import over_messages, query
from talkframe.queries.sources import MIXED_SQL, mixed_documents
from talkframe.session import settle
from talkframe.sources import exports


@query("report_json")
def report_json(spark, sf):
    tables = whole.analyze(views.messages(spark, sf))
    return whole.report_rows(tables)


@query(
    "report_sections",
    over_messages("""select 'messages' as section, count(*) as n from messages union all select 'timeline', count(*) from messages
union all select 'explanations', count(*) from messages union all select 'conversation', count(distinct conversation_id) from messages
union all select 'summary', count(distinct conversation_id) from messages union all select 'digest', count(distinct conversation_id) from messages
union all select 'escalation', count(distinct conversation_id) from messages
union all select 'speaker_profiles', count(*) from (select distinct conversation_id, speaker_id from messages) x"""),
)
def report_sections(spark, sf):
    """Rows per report section; none may lose a message, a conversation or a speaker."""
    shown = ("messages", "timeline", "explanations", "conversation", "summary", "digest", "escalation", "speaker_profiles")
    tables = whole.analyze(views.messages(spark, sf))
    return whole.report_rows({s: tables[s] for s in shown}).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


#: Per section: what is checked besides the number of rows, from the section's own columns.
CHECKED = {
    "messages": "avg(confidence)", "conversation": "sum(n_speakers)", "summary": "sum(mean_tension)", "emotional_arc": "sum(mean_intensity)",
    "arc_peaks": "count(*)", "emotion_transitions": "count(*)", "transition_matrix": "sum(n)", "turning_points": "sum(abs(tension_change))",
    "escalation": "sum(end_tension)", "escalation_phases": "count(case when phase <> 'neutral' then 1 end)", "speaker_profiles": "sum(avg_tension)",
    "speaker_labels": "sum(n)", "digest": "sum(n_flagged)", "explanations": "avg(model_confidence)", "what_changed": "sum(tension_delta)",
    "topics": "sum(messages_analyzed)", "timeline": "sum(tension)",
}


@query(
    "analyze_exports",
    f"""with recursive scored as (select * from (with recursive {MIXED_SQL},
  messages as (select conversation_id, message_id, message_id - 1 as pos, speaker_id, try_cast(ts as timestamp) as ts, text, platform from mixed), {HISTORY_SQL}
  select m.*, 'neutral' as emotion, 'neutral' as tone, case when e_negative = top then 'negative' when e_neutral = top then 'neutral' else 'positive' end as sentiment,
   least(heat * 100 + 10, 100) as tension, p_positive, p_negative, cast(0 as double) as sarcasm_p, cast(0 as double) as irony_p, cast(0 as double) as pa_p,
   cast(0 as double) as emotion_confidence, top / (e_negative + e_neutral + e_positive) as sentiment_confidence from pr join messages m using (conversation_id, message_id)) s),
messages as (select * from scored), {READ_SQL},
signals as (select m.*, h.sarcasm_score as p from messages m join hid h using (conversation_id, message_id)), {TRAJECTORY_SQL.strip()}, {TURNING_SQL.strip()},
{TOPICS_SQL.strip()},
phases as (select conversation_id, case when message_id = peak_message then 'peak' when message_id > escalation_start_message and message_id < peak_message then 'escalating'
  when message_id > peak_message and trajectory in ('de-escalating', 'volatile') then 'de-escalating' when message_id >= escalation_start_message then 'escalating' else 'neutral' end as phase
  from signals join traj using (conversation_id)),
prof as (select conversation_id, speaker_id, avg(tension) as t, avg(cast(tension >= 60 as int)) > cast(0.5 as double) or avg(cast(p >= 0.5 as int)) > cast(0.25 as double) as flagged,
  count(distinct sentiment) as s, count(*) as n from signals group by 1, 2),
per as (select conversation_id, count(*) as n, count(distinct speaker_id) as sp, avg(tension) as t, sum(tension) as total, avg(confidence) as c from exp group by 1),
empty as (select distinct 'empty-' || conv_id as conversation_id from conversations where conv_id % 10 = 0),
x as (select conversation_id, 'messages' as section, n, c as v from per union all select conversation_id, 'explanations', n, c from per
 union all select conversation_id, 'conversation', 1, sp from per union all select conversation_id, 'summary', 1, t from per
 union all select conversation_id, 'emotional_arc', 1, cast(0.1 as double) from per union all select conversation_id, 'timeline', n, total from per
 union all select conversation_id, 'transition_matrix', 1, n - 1 from per where n > 1
 union all select conversation_id, 'turning_points', count(*), sum(abs(delta)) from tp group by 1
 union all select conversation_id, 'escalation', 1, end_tension from traj
 union all select conversation_id, 'escalation_phases', count(*), count(*) filter (phase <> 'neutral') from phases group by 1
 union all select conversation_id, 'speaker_profiles', count(*), sum(t) from prof group by 1
 union all select conversation_id, 'speaker_labels', sum(2 + s), sum(3 * n) from prof group by 1
 union all select conversation_id, 'digest', 1, count(*) filter (flagged) from prof group by 1
 union all select conversation_id, 'what_changed', count(*), sum(tension - before_tension) from exp where prev_emotion is not null group by 1
 union all select conversation_id, 'topics', count(*), sum(messages_analyzed) from topics group by 1
 union all select conversation_id, unnest(['conversation', 'summary', 'escalation', 'digest']), 1, 0 from empty)
select conversation_id, section, cast(n as bigint) as n, round(cast(v as double), 4) as value from x""",
)
def analyze_exports(spark, sf):
    """Files to report: ingested, scored on the model's own history, analysed; some files hold no message. Per conversation and section, the
    rows and one checked number."""
    empty = views.table(spark, sf, "conversations").filter("conv_id % 10 = 0").select(F.concat(F.lit("empty-"), F.col("conv_id").cast("string")).alias("file_id"))
    docs = mixed_documents(spark, sf).unionByName(empty.distinct().withColumn("raw", F.lit("")))
    messages = exports.ingest(docs).withColumns({"ts": F.col("ts").try_cast("timestamp_ntz"), "pos": F.col("message_id") - 1})
    messages = settle(messages, "ingested")  # scoring reads them twice
    tables = whole.analyze(whole.score(messages, history_model()), conversations=docs.select(F.col("file_id").alias("conversation_id")))
    out = None
    for section, checked in CHECKED.items():
        per = tables[section].groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.expr(checked).cast("double"), 4).alias("value"))
        part = per.select("conversation_id", F.lit(section).alias("section"), "n", "value")
        out = part if out is None else out.unionByName(part)
    return out
