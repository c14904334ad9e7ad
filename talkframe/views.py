"""Conversation-shaped views of the given tables.

``signals``  one labelled, ordered series per user and week, from ``events``.
``messages`` chat text with labels, scores and timestamps, from ``conversations``.

The same column expressions are used for the Spark view and for the SQL text of the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.operators.sequence import number
from talkframe.session import prepare, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
_SIGNAL_BASE = f"""
  user_id * 10 + cast(floor((day(ts) - 1) / 7) as bigint) as conversation_id,
  case when event_id % 2 = 0 then 'A' else 'B' end as speaker_id,
  ts,
  case event_type when 'click' then 'neutral' when 'view' then 'confusion' when 'signup' then 'joy'
       when 'purchase' then 'excitement' else 'anger' end as emotion,
  case event_type when 'signup' then 'positive' when 'purchase' then 'positive'
       when 'error' then 'negative' else 'neutral' end as sentiment,
  case event_type when 'click' then 'casual' when 'view' then 'concerned' when 'signup' then 'friendly'
       when 'purchase' then 'humorous' else 'aggressive' end as tone,
  least(value, cast(100 as double)) as tension,
  event_id, user_id, event_type,
  cast({_K} as double) / 100 as p,
  cast(value > 50 as int) as gold,
  cast(0.5 as double) + cast({_K} as double) / 200 as confidence,
  cast((event_id * 13) % 101 as double) / 100 as irony_p,
  cast((event_id * 29) % 101 as double) / 100 as pa_p
"""
_SIGNAL_EXTRA = """
  concat(emotion, ' ', tone, ' ', event_type) as text,
  case when event_id % 10 = 0 then 'neutral' else emotion end as pred_emotion,
  case when event_id % 7 = 0 then 'neutral' else sentiment end as pred_sentiment,
  abs(tension + cast((event_id * 7) % 21 as double) - 10) as gold_tension
"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(*[F.expr(e) for e in _columns(_SIGNAL_BASE)])
    ordered = number(events, ["conversation_id"], ["ts", "event_id"], F.expr("unix_timestamp(cast(ts as timestamp)) div 3600"))
    return ordered.select("*", (F.col("pos") + 1).alias("message_id"), *[F.expr(e) for e in _columns(_SIGNAL_EXTRA)])


def placed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signals`` with their positions written once, for plans that read them several times."""
    return settle(signals(spark, sf_dir), "signals")


_PHRASES = """case cast((conv_id*31+turn*7) % 12 as int)
    when 0 then 'Fine. ' when 1 then 'WOW great, great work!!! '
    when 2 then 'Thanks, see https://example.org/a?b=1 now ' when 3 then 'This is broken again... '
    when 4 then '🙄 sure ' when 5 then '😀😀 lol ' when 6 then 'Why?? WHY is it late? '
    when 7 then 'He said "done ' when 8 then 'ok ' when 9 then 'I never fail, honestly nice 👍 ' else '' end"""


def _pick(values: list, at: str) -> str:
    return f"split_part('{','.join(values)}', ',', cast({at} as int) + 1)"


_MESSAGE = f"""
  conv_id as conversation_id,
  turn + 1 as message_id,
  turn as pos,
  role as speaker_id,
  concat({_PHRASES}, case when (conv_id*31+turn*7) % 12 in (0,4,8) then '' else text end) as text,
  {_pick(fixed.EMOTIONS, '(conv_id*7 + turn*5) % 13')} as emotion,
  {_pick(fixed.TONES, '(conv_id*3 + turn*11) % 14')} as tone,
  {_pick(fixed.SENTIMENTS, '(conv_id*5 + turn*7) % 3')} as sentiment,
  cast((conv_id*37 + turn*23) % 101 as double) as tension,
  cast((conv_id*17 + turn*29) % 100 as double) / 100 as p_positive,
  cast(99 - (conv_id*17 + turn*29) % 100 as double) * 7 / 1000 as p_negative,
  cast((conv_id*13 + turn*41) % 101 as double) / 100 as sarcasm_p,
  cast((conv_id*19 + turn*43) % 101 as double) / 100 as irony_p,
  cast((conv_id*23 + turn*47) % 101 as double) / 100 as pa_p,
  cast(50 + (conv_id*11 + turn*3) % 50 as double) / 100 as emotion_confidence,
  cast(40 + (conv_id*29 + turn*31) % 60 as double) / 100 as sentiment_confidence,
  cast((conv_id*41 + turn*53) % 2 as int) as sarcasm,
  cast((conv_id*43 + turn*59) % 3 = 0 as int) as irony,
  cast((conv_id*47 + turn*61) % 5 = 0 as int) as passive_aggression
"""
_WHEN = "case when (conv_id*31+turn*7) % 17 = 3 then null else {base} end as ts"
_SPARK_WHEN = _WHEN.format(
    base="timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn*((conv_id*37)%150) as int))"
)
_DUCK_WHEN = _WHEN.format(base="timestamp '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn*((conv_id*37)%150))")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(*[F.expr(e) for e in [*_columns(_MESSAGE), _SPARK_WHEN]])


def _columns(block: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, cur = [], 0, False, ""
    for ch in block:
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
                continue
        cur += ch
    out.append(cur.strip())
    return out


# --- SQL text of the same views, for the checks ---------------------------------------------------------------
SIGNALS_SQL = f"""signals as (
 select *, {_SIGNAL_EXTRA} from (
  select *, row_number() over (partition by conversation_id order by ts, event_id) as message_id,
    row_number() over (partition by conversation_id order by ts, event_id) - 1 as pos
  from (select {_SIGNAL_BASE} from events) b) o)"""
MESSAGES_SQL = f"messages as (select {_MESSAGE}, {_DUCK_WHEN} from conversations)"
