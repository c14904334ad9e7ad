"""Queries over ordered tension / emotion series."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import fixed, views
from talkframe.operators import temporal
from talkframe.queries.registry import over_signals, query


def sql_map(column: str, table: dict, default: object = "null") -> str:
    whens = " ".join(f"when '{k}' then {v!r}" for k, v in table.items())
    kind = "varchar" if any(isinstance(v, str) for v in table.values()) else "double"
    return f"cast(case {column} {whens} else {default} end as {kind})"


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


INTENSITY_SQL = sql_map("emotion", fixed.INTENSITY, fixed.UNKNOWN_INTENSITY)
LAG_SQL = """lagged as (
 select *, lag(emotion) over w as prev_emotion, lag(tension) over w as prev_tension, lag(tone) over w as prev_tone,
   lag(sentiment) over w as prev_sentiment
 from signals window w as (partition by conversation_id order by message_id))"""


@query(
    "emotion_transitions",
    over_signals(f"""
{LAG_SQL},
t as (select *, tension - prev_tension as d,
  abs({INTENSITY_SQL} - {sql_map("prev_emotion", fixed.INTENSITY, fixed.UNKNOWN_INTENSITY)}) as m
  from lagged where prev_emotion is not null and prev_emotion <> emotion)
select conversation_id, message_id as at_message, speaker_id as speaker, prev_emotion as from_emotion,
  emotion as to_emotion, prev_tension as tension_before, tension as tension_after,
  round(d, 6) as tension_delta, round(m, 6) as magnitude, substr(text, 1, 120) as trigger_text
from t where m > cast(0.22 as double) or abs(d) > 12"""),
)
def emotion_transitions(spark, sf):
    out = temporal.transitions(views.signals(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("tension_delta", "magnitude")})


@query(
    "transition_matrix",
    over_signals(f"""
{LAG_SQL}
select conversation_id, prev_emotion as from_emotion, emotion as to_emotion, count(*) as n
from lagged where prev_emotion is not null group by all"""),
)
def transition_matrix(spark, sf):
    return temporal.transition_matrix(views.signals(spark, sf))


TURNING_SQL = f"""
{LAG_SQL},
d as (select *, tension - prev_tension as delta, count(*) over (partition by conversation_id) as n from lagged),
d5 as (select * from d where n >= 5 and prev_tension is not null),
med as (select conversation_id, quantile_cont(delta, 0.5) as med, stddev_pop(delta) as sd from d5 group by 1),
mad as (select conversation_id, any_value(med) as med, any_value(sd) as sd,
  cast(1.4826 as double) * quantile_cont(abs(delta - med), 0.5) as s0 from d5 join med using (conversation_id) group by 1),
z as (select d5.*, (delta - med) / (case when s0 < 1e-3 then greatest(sd, 1) else s0 end) as z
  from d5 join mad using (conversation_id)),
c as (select *, row_number() over (partition by conversation_id order by abs(z) desc, pos) as rk
  from z where abs(delta) >= 1e-9 and (abs(z) >= 1.6 or abs(delta) >= 15)),
pick(conversation_id, rk, kept) as (
  select distinct conversation_id, cast(0 as bigint), cast([] as bigint[]) from c
  union all
  select c.conversation_id, c.rk,
    case when len(kept) < 5 and not list_contains(kept, c.pos - 1) then list_append(kept, c.pos) else kept end
  from pick join c on c.conversation_id = pick.conversation_id and c.rk = pick.rk + 1),
chosen as (select distinct conversation_id, unnest(kept) as pos from pick),
tp as (select c.* from c join chosen using (conversation_id, pos))"""


@query(
    "turning_points",
    over_signals(f"""{TURNING_SQL}
select conversation_id, message_id, speaker_id as speaker, prev_emotion as before_emotion, prev_tone as before_tone,
  prev_tension as before_tension, emotion as after_emotion, tone as after_tone, tension as after_tension,
  round(delta, 6) as tension_change, round(z, 6) as robust_z, substr(text, 1, 140) as trigger_text
from tp"""),
)
def turning_points(spark, sf):
    out = temporal.turning_points(views.placed_signals(spark, sf)).drop("pos")
    return out.withColumns({c: F.round(c, 6) for c in ("tension_change", "robust_z")})


@query(
    "arc_peaks",
    over_signals(f"""
y0 as (select conversation_id, message_id, pos, {INTENSITY_SQL} as y from signals),
y as (select *, 'peak' as kind from y0 union all select conversation_id, message_id, pos, -y, 'drop' from y0),
f as (select *, count(*) over g as n, min(y) over g as low,
   greatest(lag(y) over o, lead(y) over o) as beside,
   min(y) over (partition by conversation_id, kind order by pos rows between 3 preceding and current row) as l,
   min(y) over (partition by conversation_id, kind order by pos rows between 1 following and 3 following) as r
  from y window g as (partition by conversation_id, kind), o as (partition by conversation_id, kind order by pos)),
h as (select *, row_number() over (partition by conversation_id, kind order by pos) as rk from f
  where pos between 1 and n - 2 and y - beside >= -1e-9
    and y - least(case when pos >= 3 then l else low end, case when pos + 4 <= n then r else low end) >= cast(0.18 as double)),
walk(conversation_id, kind, rk, slot, last_pos, last_y) as (
  select conversation_id, kind, rk, cast(1 as bigint), pos, y from h where rk = 1
  union all
  select h.conversation_id, h.kind, h.rk,
    case when h.pos - last_pos <= 2 then slot else slot + 1 end,
    case when h.pos - last_pos <= 2 and h.y <= last_y then last_pos else h.pos end,
    case when h.pos - last_pos <= 2 and h.y <= last_y then last_y else h.y end
  from walk join h on h.conversation_id = walk.conversation_id and h.kind = walk.kind and h.rk = walk.rk + 1),
fin as (select conversation_id, kind, slot, arg_max(last_pos, rk) as pos from walk group by all)
select h.conversation_id, h.kind, h.message_id, abs(h.y) as intensity
from h join fin using (conversation_id, kind, pos)"""),
)
def arc_peaks(spark, sf):
    return temporal.extrema(views.placed_signals(spark, sf)).drop("pos")


RECOVERY_SQL = f"""
yy as (select conversation_id, pos, {INTENSITY_SQL} as y, count(*) over (partition by conversation_id) as n,
   first_value(pos) over (partition by conversation_id order by {INTENSITY_SQL} desc, pos) as peak from signals),
rec as (select conversation_id, coalesce(max(n) >= 6 and max(y) >= cast(0.55 as double)
   and count(*) filter (pos > peak) >= 2 and round(max(y) - avg(y) filter (pos > peak), 9) > cast(0.25 as double), false) as recovered
  from yy group by 1)"""


@query("arc_recovery", over_signals(f"{RECOVERY_SQL}\nselect * from rec"))
def arc_recovery(spark, sf):
    return temporal.recovery(views.signals(spark, sf))


@query(
    "arc_summary",
    over_signals(f"""{RECOVERY_SQL},
a as (select conversation_id, avg(y) as m, max(y) as pk, stddev_pop(y) as sd, arg_max(y, pos) as last,
  avg(y) filter (pos < greatest(1, n // 3)) as head from yy group by 1)
select conversation_id, round(m, 6) as mean_intensity, pk as peak_intensity,
  round(1 - least(sd / cast(0.4 as double), 1), 6) as stability,
  case when round(head - last, 9) > cast(0.08 as double) then 'de-escalating'
       when round(last - head, 9) > cast(0.08 as double) then 'escalating' else 'stable' end as direction, recovered
from a join rec using (conversation_id)"""),
)
def arc_summary(spark, sf):
    out = temporal.arc_summary(views.placed_signals(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_intensity", "stability")})


TRAJECTORY_SQL = """
b as (select *, count(*) over (partition by conversation_id) as n,
   lag(tension, 1) over w as t1, lag(tension, 2) over w as t2, lag(tension, 3) over w as t3,
   lag(message_id, 3) over w as from_id,
   first_value(pos) over (partition by conversation_id order by tension desc, pos) as peak
  from signals window w as (partition by conversation_id order by pos)),
st as (select conversation_id, avg(tension) filter (pos < n // 3) as start_mean from b group by 1),
agg as (select conversation_id, any_value(n) as n, any_value(peak) as peak, max(tension) as pk, min(tension) as low,
  case when any_value(n) = 1 then 0 else regr_slope(tension, pos) end as slope, any_value(start_mean) as sm,
  avg(tension) filter (pos >= n // 3 and pos < 2 * n // 3) as mm, avg(tension) filter (pos >= 2 * n // 3) as em,
  min(tension) filter (pos >= peak) as dip,
  min(from_id) filter (tension > t1 and t1 > t2 and t2 > t3 and tension > start_mean + 8) as onset,
  arg_min(tension, pos) as tf, arg_max(tension, pos) as tl, quantile_cont(tension, 0.5) as md
  from b join st using (conversation_id) group by 1),
dp as (select b.conversation_id, min(message_id) as dip_id from b join agg using (conversation_id)
  where b.pos >= agg.peak and tension = dip group by 1),
traj as (select conversation_id, n,
  case when n < 4 then 'stable' when em - sm > 12 and slope > cast(0.35 as double) then 'escalating'
   when sm - em > 12 and slope < -cast(0.35 as double) then 'de-escalating' when pk - low > 40 then 'volatile'
   else 'stable' end as trajectory,
  case when n >= 4 then onset end as escalation_start_message, round(slope, 6) as escalation_rate,
  pk as peak_tension, peak + 1 as peak_message,
  case when n >= 4 and n - peak > 2 and dip < pk - 20 then dip_id end as deescalation_point,
  round(case when n >= 4 then sm else tf end, 6) as start_tension,
  round(case when n >= 4 then mm else md end, 6) as middle_tension,
  round(case when n >= 4 then em else tl end, 6) as end_tension,
  round(case when n >= 4 then least(cast(0.99 as double), abs(slope) / cast(2.5 as double) + (pk - low) / 200) else 0 end, 6) as confidence
 from agg join dp using (conversation_id))"""
_TRAJ_ROUND = ("escalation_rate", "start_tension", "middle_tension", "end_tension", "confidence")


@query("trajectory", over_signals(f"{TRAJECTORY_SQL}\nselect * from traj"))
def trajectory(spark, sf):
    out = temporal.trajectory(views.placed_signals(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in _TRAJ_ROUND})


@query(
    "escalation_phases",
    over_signals(f"""{TRAJECTORY_SQL}
select conversation_id, message_id,
 case when message_id = peak_message then 'peak'
  when message_id > escalation_start_message and message_id < peak_message then 'escalating'
  when message_id > peak_message and trajectory in ('de-escalating', 'volatile') then 'de-escalating'
  when message_id >= escalation_start_message then 'escalating' else 'neutral' end as phase
from signals join traj using (conversation_id)"""),
)
def escalation_phases(spark, sf):
    return temporal.phases(views.signals(spark, sf))
