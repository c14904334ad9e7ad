"""Queries over text evidence, hidden signals, fusion and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import fixed, views
from talkframe.functions import text
from talkframe.functions.lookup import mapped
from talkframe.operators import explain
from talkframe.plans import enrich
from talkframe.queries import sqltext as t
from talkframe.queries.context import MEMORY_SQL
from talkframe.queries.ordered import RECOVERY_SQL, TRAJECTORY_SQL, TURNING_SQL, sql_map
from talkframe.queries.registry import over_messages, over_signals, query

CONV = "conversation_id"
READ_SQL = ", ".join([t.GAPS_SQL, t.BEHAVE_SQL, MEMORY_SQL, t.SIG_SQL, t.CONTEXT_SQL, t.HID_SQL, t.FUSED_SQL, t.EXPLAIN_SQL])


def joined(name: str, sep: str = "|"):
    return F.array_join(name, sep).alias(name.split(".")[-1])


def read(spark, sf):
    return enrich.read_messages(views.messages(spark, sf))


@query(
    "process_text",
    f"""select 'page' as kind, page_id as id, {t.process('html')} as processed from pages
union all select 'message', conv_id * 100 + turn, {t.process('text')} from conversations""",
)
def process_text(spark, sf):
    pages = views.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.process_text(F.col("html")).alias("processed")
    )
    chat = views.table(spark, sf, "conversations").select(
        F.lit("message").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        text.process_text(F.col("text")).alias("processed"),
    )
    return pages.unionByName(chat)


@query(
    "norm_text",
    over_messages(f"""select conversation_id, message_id, {t.normal("concat(text, ' (ref ', emotion, ')  X')")} as normal from messages"""),
)
def norm_text(spark, sf):
    noisy = F.concat("text", F.lit(" (ref "), "emotion", F.lit(")  X"))
    return views.messages(spark, sf).select(CONV, "message_id", text.normal_text(noisy).alias("normal"))


@query(
    "norm_speaker",
    "select page_id, regexp_replace(trim(concat('  ', chr(8206), url, chr(8207), ' ')), '^[\\x{200E}\\x{200F}]+|[\\x{200E}\\x{200F}]+$', '', 'g') as speaker from pages",
)
def norm_speaker(spark, sf):
    raw = F.concat(F.lit("  ‎"), "url", F.lit("‏ "))
    return views.table(spark, sf, "pages").select("page_id", text.speaker_name(raw).alias("speaker"))


@query(
    "parse_ts",
    """with v as (select event_id, case event_id % 6 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when 2 then concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z') when 3 then strftime(ts, '%H:%M')
  when 4 then concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '+02:00') else 'yesterday' end as raw, ts from events)
select event_id, raw, case event_id % 6 when 3 then null when 5 then null
  when 4 then cast(epoch_us(date_trunc('second', ts)) // 1000000 - 7200 as bigint)
  else cast(epoch_us(date_trunc('second', ts)) // 1000000 as bigint) end as epoch from v""",
)
def parse_ts(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    t_form = F.replace(stamp, F.lit(" "), F.lit("T"))
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, t_form).when(kind == 1, stamp).when(kind == 2, F.concat(t_form, F.lit("Z")))
        .when(kind == 3, F.date_format("ts", "HH:mm")).when(kind == 4, F.concat(t_form, F.lit("+02:00")))
        .otherwise("yesterday")
    )
    rows = views.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", "raw", F.unix_seconds(text.parse_timestamp(F.col("raw"))).alias("epoch"))


@query(
    "emoji_features",
    over_messages(f"""{t.GAPS_SQL}, {t.BEHAVE_SQL}
select conversation_id, message_id, array_to_string({t.emoji('text')}, '|') as tokens,
  round(emoji_polarity, 6) as emoji_polarity, emoji_sarcasm from behave"""),
)
def emoji_features(spark, sf):
    rows = text.behaviour(views.messages(spark, sf))
    return rows.select(
        CONV, "message_id", F.array_join(text.emoji_tokens(F.col("text")), "|").alias("tokens"),
        F.round("emoji_polarity", 6).alias("emoji_polarity"), "emoji_sarcasm",
    )


@query(
    "lexicon_hits",
    f"""with w as (select conv_id, turn, unnest({t.words('lower(text)')}) as w from conversations
  union all select -1 - doc_id, 0, unnest({t.words('lower(text)')}) from documents),
b as (select conv_id, turn, regexp_replace(w, '^[.,!?]+|[.,!?]+$', '', 'g') as w from w),
l as (select unnest([{', '.join(t.q(x) for x in fixed.POSITIVE + fixed.NEGATIVE)}]) as term)
select conv_id, turn, w as term, case when w in {t.inlist(fixed.POSITIVE)} then 'positive' else 'negative' end as category, count(*) as n
from b where w in (select term from l) group by all""",
)
def lexicon_hits(spark, sf):
    chat = views.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    docs = views.table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    found = chat.unionByName(docs).select("conv_id", "turn", F.explode(text.words(F.lower("text"))).alias("w"))
    bare = found.select("conv_id", "turn", F.regexp_replace("w", r"^[.,!?]+|[.,!?]+$", "").alias("term"))
    lexicon = {**{w: "positive" for w in fixed.POSITIVE}, **{w: "negative" for w in fixed.NEGATIVE}}
    hits = bare.withColumn("category", mapped(F.col("term"), lexicon)).filter(F.col("category").isNotNull())
    return hits.groupBy("conv_id", "turn", "term", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "micro_signals",
    over_messages(f"""{t.GAPS_SQL}, {t.BEHAVE_SQL}, {t.SIG_SQL}
select conversation_id, message_id, sn_words as n_words, array_to_string(pos_hits, '|') as positive_hits,
 array_to_string(neg_hits, '|') as negative_hits, array_to_string(sarc_words, '|') as sarcasm_words,
 array_to_string(irony_words, '|') as irony_words, pa_phrase as concessive_phrase, array_to_string(exagg, '|') as exaggeration,
 array_to_string(repeated, '|') as repeated_words, coop as cooperative, belief as belief_update,
 array_to_string(inter, '|') as interjections, cast(len(pos_hits) - len(neg_hits) as integer) as praise_minus_negative,
 exclamations, ellipses, array_to_string(semoji, '|') as sarcasm_emoji, round(emoji_polarity, 6) as emoji_polarity,
 laughter = 1 as laughter, cast(swears as integer) as swears, quoted as quoted_echo, sshort as is_short from sig"""),
)
def micro_signals(spark, sf):
    rows = text.signals(views.messages(spark, sf)).select(CONV, "message_id", "signals.*")
    out = []
    for f in rows.schema.fields:
        if f.dataType.typeName() == "array":
            out.append(F.array_join(f.name, "|").alias(f.name))
        elif f.name == "emoji_polarity":
            out.append(F.round(f.name, 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return rows.select(*out)


@query(
    "behavior_flags",
    over_messages(f"""{READ_SQL}
select conversation_id, message_id, round(intensity, 6) as intensity, is_short = 1 as short_response,
 negative_hits as negative_lexicon, positive_hits as positive_lexicon, exaggeration_hits as exaggeration_words,
 round(emoji_polarity, 6) as emoji_polarity, round(gap_hours, 6) as response_gap_hours, round(caps_share, 6) as caps_ratio
from hid"""),
)
def behavior_flags(spark, sf):
    rows = read(spark, sf)
    return rows.select(
        CONV, "message_id", F.round("intensity", 6).alias("intensity"), (F.col("is_short") == 1).alias("short_response"),
        F.col("negative_hits").alias("negative_lexicon"), F.col("positive_hits").alias("positive_lexicon"),
        F.col("exaggeration_hits").alias("exaggeration_words"), F.round("emoji_polarity", 6).alias("emoji_polarity"),
        F.round("gap_hours", 6).alias("response_gap_hours"), F.round("caps_share", 6).alias("caps_ratio"),
    )


@query(
    "emotion_dims",
    over_signals(f"""
select conversation_id, message_id, {sql_map('emotion', fixed.INTENSITY, 0.1)} as intensity,
 {sql_map('emotion', fixed.VALENCE, 0)} as valence, {sql_map('emotion', fixed.AROUSAL, 0)} as arousal,
 {sql_map('tone', fixed.WARMTH, 0)} as warmth from signals"""),
)
def emotion_dims(spark, sf):
    return views.signals(spark, sf).select(
        CONV, "message_id", mapped(F.col("emotion"), fixed.INTENSITY, 0.1).alias("intensity"),
        mapped(F.col("emotion"), fixed.VALENCE, 0.0).alias("valence"),
        mapped(F.col("emotion"), fixed.AROUSAL, 0.0).alias("arousal"),
        mapped(F.col("tone"), fixed.WARMTH, 0.0).alias("warmth"),
    )


@query(
    "hidden_contradiction",
    over_messages(f"""{READ_SQL}
select conversation_id, message_id, round(contradiction, 6) as contradiction, round(mismatch, 6) as mismatch from hid"""),
)
def hidden_contradiction(spark, sf):
    return read(spark, sf).select(
        CONV, "message_id", F.round("contradiction", 6).alias("contradiction"), F.round("mismatch", 6).alias("mismatch")
    )


def _hidden(name: str):
    sql = over_messages(f"""{READ_SQL}
select conversation_id, message_id, round({name}_score, 6) as probability, round(abs({name}_score - 0.5) * 2, 6) as confidence,
 {name}_p as learned_p, array_to_string({name}_notes, '; ') as supporting from hid""")

    def run(spark, sf):
        score = F.col(f"{name}_score")
        return read(spark, sf).select(
            CONV, "message_id", F.round(score, 6).alias("probability"),
            F.round(F.abs(score - 0.5) * 2, 6).alias("confidence"), F.col(f"{name}_p").alias("learned_p"),
            F.array_join(f"{name}_notes", "; ").alias("supporting"),
        )

    query(f"hidden_{name}", sql)(run)


for _name in ("sarcasm", "irony", "pa"):
    _hidden(_name)


@query(
    "fuse_messages",
    over_messages(f"{READ_SQL}\nselect conversation_id, message_id, round(confidence, 6) as confidence from fus"),
)
def fuse_messages(spark, sf):
    return read(spark, sf).select(CONV, "message_id", F.round("confidence", 6).alias("confidence"))


@query(
    "explain_messages",
    over_messages(f"""{READ_SQL}
select conversation_id, message_id, {t.display('sentiment')} as sentiment, {t.display('emotion')} as emotion, {t.display('tone')} as tone,
 sentiment_confidence, emotion_confidence, round(sarcasm_score, 6) as sarcasm_probability,
 round(pa_score, 6) as passive_aggression_probability, tension, array_to_string(detected, '; ') as detected_evidence,
 array_to_string(inferred, '; ') as inferred_interpretation, round(confidence, 6) as model_confidence from exp"""),
)
def explain_messages(spark, sf):
    out = explain.explain_messages(read(spark, sf))
    rounded = {c: F.round(c, 6) for c in ("sarcasm_probability", "passive_aggression_probability", "model_confidence")}
    lists = {c: F.array_join(c, "; ") for c in ("detected_evidence", "inferred_interpretation")}
    return out.withColumns({**rounded, **lists})


@query(
    "what_changed",
    over_messages(f"""{READ_SQL}
select conversation_id, message_id as at_message, prev_emotion as before_emotion, prev_tone as before_tone,
 prev_sentiment as before_sentiment, before_tension, emotion as after_emotion, tone as after_tone,
 sentiment as after_sentiment, tension as after_tension, tension - before_tension as tension_delta,
 concat(prev_emotion, ' → ', emotion) as emotion_shift,
 case when len(contributing) > 0 then array_to_string(contributing, '; ') else {t.q(fixed.EVIDENCE['change_none'])} end as contributing
from exp where prev_emotion is not null"""),
)
def what_changed(spark, sf):
    return explain.what_changed(read(spark, sf)).withColumn("contributing", F.array_join("contributing", "; "))


@query(
    "digest",
    over_signals(f"""{TRAJECTORY_SQL.strip()}, {RECOVERY_SQL.strip()}, {TURNING_SQL.strip()},
best as (select *, row_number() over (partition by conversation_id order by abs(delta) desc, pos) as best_rk,
  count(*) over (partition by conversation_id) as n_tp from tp),
prof as (select conversation_id, speaker_id, avg(case when tension >= 60 then 1.0 else 0.0 end) as hi,
  avg(case when p >= 0.5 then 1.0 else 0.0 end) as sa from signals group by 1, 2),
pc as (select conversation_id, count(*) as n_speakers, count(*) filter (hi > 0.5 or sa > 0.25) as n_flagged,
  coalesce(string_agg(speaker_id, ', ' order by speaker_id) filter (hi > 0.5 or sa > 0.25), '') as flagged from prof group by 1),
dd as (select t.*, pc.n_speakers, pc.n_flagged, pc.flagged, coalesce(n_tp, 0) as n_turning_points,
   rec.recovered or deescalation_point is not null as rcv, coalesce(abs(b.delta) >= 5, false) as turned,
   b.message_id as bm, b.delta as bd, concat(b.prev_emotion, ' → ', b.emotion) as ft, substr(b.text, 1, 140) as tr, b.speaker_id as bs,
   substr(pk.text, 1, 140) as pt, pk.speaker_id as ps
  from traj t join pc using (conversation_id) join rec using (conversation_id)
  left join best b on b.conversation_id = t.conversation_id and b.best_rk = 1
  join signals pk on pk.conversation_id = t.conversation_id and pk.message_id = t.peak_message),
o as (select *, concat(printf('%d messages, %d participant(s): trajectory is %s, peak tension %s/100, %d turning point(s) detected.',
    n, n_speakers, trajectory, cast(round(peak_tension, 1) as varchar), n_turning_points),
   case when rcv then ' The conversation de-escalated after its peak.' else '' end,
   case when n_flagged > 0 then concat(' Elevated-tension/sarcasm share: ', flagged, '.') else '' end) as overview from dd)
select conversation_id, n as n_messages, n_speakers, n_flagged, flagged,
 case when turned then 'turning_point' when trajectory = 'escalating' then 'escalation_peak' end as headline_kind,
 case when turned then bm when trajectory = 'escalating' then peak_message end as headline_message,
 case when turned then case when bd > 0 then 'tension spike' else 'tension dip' end end as direction,
 case when turned then round(bd, 6) end as tension_change, case when turned then ft end as from_to,
 case when turned then tr when trajectory = 'escalating' then pt end as trigger,
 case when turned then bs when trajectory = 'escalating' then ps end as speaker,
 trajectory, escalation_rate, peak_tension, n_turning_points, rcv as recovered, overview,
 case when turned then concat('Detected ', case when bd > 0 then 'tension spike' else 'tension dip' end, ' after message ', bm, ' (', ft, ').')
  else overview end as headline
from o"""),
)
def digest(spark, sf):
    out = explain.digest(views.placed_signals(spark, sf))
    return out.withColumns({**{c: F.round(c, 6) for c in ("tension_change", "escalation_rate")}, "flagged": F.array_join("flagged", ", ")})
