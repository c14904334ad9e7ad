"""SQL fragments for checking the text functions."""

from __future__ import annotations

from talkframe import fixed


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(values: list) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q(f'^{fixed.SPACE}+|{fixed.SPACE}+$')}, '', 'g')"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(fixed.SPACE + '+')}), lambda w: w <> '')"


def runs(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(fixed.NOT_WORD)}), lambda w: w <> '')"


def emoji(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(fixed.EMOJI_RUN)})"


def bare(expr: str) -> str:
    return f"regexp_replace({expr}, {q(fixed.EMOJI_RUN)}, ' ', 'g')"


def count(expr: str, pattern: str) -> str:
    return f"cast(len(regexp_extract_all({expr}, {q(pattern)})) as integer)"


def contains_any(expr: str, needles: list) -> str:
    return "(" + " or ".join(f"contains({expr}, {q(n)})" for n in needles) + ")"


def polarity(tokens: str) -> str:
    whens = " ".join(f"when {q(k)} then {v}" for k, v in fixed.EMOJI_POLARITY.items())
    return f"coalesce(list_sum(list_transform({tokens}, lambda e: cast(case e {whens} else 0 end as double))), 0)"


def slang(expr: str) -> str:
    plain = f"list_filter(regexp_split_to_array(regexp_replace(lower({expr}), '[^a-z'' ]', ' ', 'g'), ' +'), lambda w: w <> '')"
    whens = " ".join(f"when {q(k)} then {q(v)}" for k, v in fixed.SLANG.items())
    return f"flatten(list_transform({plain}, lambda w: string_split(case w {whens} else w end, ' ')))"


def normal(expr: str) -> str:
    inner = f"regexp_replace({expr}, {q(fixed.SPACE + '*' + chr(92) + '([^)]*' + chr(92) + ')' + fixed.SPACE + '*')}, ' ', 'g')"
    return f"regexp_replace({strip(f'lower({inner})')}, {q(fixed.SPACE + '+')}, ' ', 'g')"


def process(expr: str) -> str:
    out = f"regexp_replace({expr}, {q(fixed.URL)}, ' link ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '!{{2,}}', '!!', 'g'), '\\?{{2,}}', '??', 'g')"
    return strip(f"regexp_replace({out}, {q(fixed.SPACE + '+')}, ' ', 'g')")


# Behaviour numbers of ``messages`` as a view named ``behave``; needs view ``gaps`` with gap_hours.
GAPS_SQL = """gaps as (
 select *, case when ts is null or lag(ts) over w is null then 0
   else least(greatest((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6, 0), 86400) / 3600 end as gap_hours
 from messages window w as (partition by conversation_id order by message_id))"""
_BW = f"list_transform({words(bare('text'))}, lambda w: regexp_replace(lower(w), '^[.,!?]+|[.,!?]+$', '', 'g'))"


def _hits(values: list) -> str:
    return f"cast(len(list_filter({_BW}, lambda w: w in {inlist(values)})) as integer)"


BEHAVE_SQL = f"""behave as (select *,
  cast(len({words(bare('text'))}) as integer) as n_words, cast(length(text) as integer) as n_chars,
  {count('text', '!')} as exclamations, {count('text', chr(92) + '?')} as questions,
  {count('text', fixed.REPEATED_PUNCTUATION)} as repeated_punctuation,
  coalesce(list_sum(list_transform(list_filter({runs('text')}, lambda w: regexp_matches(w, {q(fixed.CAPS_WORD)})), lambda w: length(w))), 0)
    / cast(greatest(length(text), 1) as double) as caps_share,
  {_hits(fixed.POSITIVE)} as positive_hits, {_hits(fixed.NEGATIVE)} as negative_hits,
  {_hits(fixed.EXAGGERATION)} as exaggeration_hits, {polarity(emoji('text'))} as emoji_polarity,
  cast(len(list_filter({emoji('text')}, lambda e: e in {inlist(fixed.EMOJI_SARCASM)})) as integer) as emoji_sarcasm,
  cast(len(list_filter({runs('text')}, lambda w: regexp_matches(lower(w), {q(fixed.LAUGH_WORD)}))) > 0 as integer) as laughter,
  {count('text', fixed.ELLIPSIS)} as ellipses,
  cast((length(text) - length(replace(text, '"', ''))) % 2
    + len(list_filter({runs('text')}, lambda w: regexp_matches(lower(w), {q(fixed.SWEAR_WORD)}))) as integer) as odd_quote_or_swear,
  cast(len({words(bare('text'))}) <= 2 as integer) as is_short
 from gaps)"""

# The 20 signals of ``behave`` rows as a view named ``sig``.
_STOP = inlist(fixed.REPEAT_STOP_WORDS)
_SENSE = " ".join(
    f"and not (w = {q(k)} and {contains_any('low', v)})" for k, v in fixed.SINCERE_FRAMES.items()
)
_PHRASE = "coalesce(" + ", ".join(f"case when starts_with(low, {q(p)}) then {q(p)} end" for p in fixed.CONCESSIVE_PHRASES) + ")"
SIG_SQL = f"""low as (select *, {strip(f"lower({bare('text')})")} as low from behave),
lw as (select *, list_transform({words('low')}, lambda w: regexp_replace(w, '^[.,!?"'']+|[.,!?"'']+$', '', 'g')) as w from low),
sig as (select *,
  cast(len(w) as integer) as sn_words,
  list_filter(w, lambda w: w in {inlist(fixed.POSITIVE)}) as pos_hits,
  list_filter(w, lambda w: w in {inlist(fixed.NEGATIVE)}) as neg_hits,
  list_filter(w, lambda w: w in {inlist(fixed.SARCASM_MARKERS)} {_SENSE}) as sarc_words,
  list_filter(w, lambda w: w in {inlist(fixed.IRONY_MARKERS)}) as irony_words,
  {_PHRASE} as pa_phrase,
  list_filter(w, lambda w: w in {inlist(fixed.EXAGGERATION)}) as exagg,
  list_sort(list_distinct(list_filter(w, lambda x: x <> '' and x not in {_STOP} and len(list_filter(w, lambda y: y = x)) >= 2))) as repeated,
  {contains_any('low', fixed.COOPERATIVE)} as coop, {contains_any('low', fixed.BELIEF_UPDATE)} as belief,
  list_filter(['wow', 'oh', 'ah'], lambda x: list_contains(w, x)) as inter,
  list_filter({emoji('text')}, lambda e: e in {inlist(fixed.EMOJI_SARCASM)}) as semoji,
  len(list_filter({runs('text')}, lambda w: regexp_matches(lower(w), {q(fixed.SWEAR_WORD)}))) as swears,
  contains(low, '"') as quoted, len(w) <= 2 as sshort
 from lw)"""
_NEG = " + ".join(f"cast(contains(lower(context_text), {q(w)}) as integer)" for w in fixed.NEGATIVE_CONTEXT)
_EV = {k: q(v) for k, v in fixed.EVIDENCE.items()}


def _fmt(key: str, value: str) -> str:
    head, _, tail = fixed.EVIDENCE[key].partition("%s")
    return f"concat({q(head)}, {value}, {q(tail)})"


def _first(col: str, n: int) -> str:
    return f"array_to_string({col}[1:{n}], ', ')"


def _notes(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"case when {c} then {v} end" for c, v in pairs)
    return f"list_filter([{items}], lambda x: x is not null)"


# Hidden signals of ``sig`` x context as a view named ``hid``; needs views ``mem`` (on behave) joined in.
CONTEXT_SQL = """co as (select a.conversation_id, a.message_id, b.text, row_number() over
   (partition by a.conversation_id, a.message_id order by b.tension desc, b.message_id) as rk
  from messages a join messages b on a.conversation_id = b.conversation_id and b.message_id < a.message_id - 4),
cj as (select conversation_id, message_id, string_agg(text, ' :: ' order by rk) as older from co where rk <= 3 group by 1, 2),
cr as (select conversation_id, message_id, coalesce(string_agg(text, ' || ') over
  (partition by conversation_id order by message_id rows between 4 preceding and 1 preceding), '') as recent from messages),
ctx as (select conversation_id, message_id, case when older is null then recent else concat(older, ' || ', recent) end as context_text
 from cr left join cj using (conversation_id, message_id)),
prevs as (select conversation_id, message_id, lag(tension) over w as before_tension, coalesce(lag(tension) over w, 0) as prev_tension,
  lag(emotion) over w as prev_emotion, lag(tone) over w as prev_tone, lag(sentiment) over w as prev_sentiment
 from messages window w as (partition by conversation_id order by message_id))"""
HID_SQL = f"""h0 as (select sig.*, m.last_emotion, m.recent_tension, c.context_text, p.before_tension, p.prev_tension,
   p.prev_emotion, p.prev_tone, p.prev_sentiment
  from sig join mem m using (conversation_id, message_id) join ctx c using (conversation_id, message_id)
  join prevs p using (conversation_id, message_id)),
h1 as (select *, case when round(p_positive - p_negative, 9) > cast(0.1 as double) then
    greatest(case when context_text <> '' then least(({_NEG}) / 3, 1) else 0 end,
      least(greatest(prev_tension - 35, 0) / 45, 1) * cast(0.6 as double)) * cast(0.3 as double)
    + case when exclamations >= 1 then cast(0.2 as double) else 0 end
    + least(len(sarc_words) / 2, 1) * cast(0.15 as double)
    + case when len(inter) > 0 then cast(0.15 as double) else 0 end
   else cast(0 as double) end * case when belief then cast(0.5 as double) else 1 end as contradiction from h0),
h2 as (select *, contradiction * case when coop then cast(0.25 as double) else 1 end as mismatch,
   least(len(list_filter(repeated, lambda x: list_contains(pos_hits, x) or list_contains(sarc_words, x))) / 2, 1) * cast(0.25 as double) as rep,
   greatest(tension - prev_tension, 0) / 100 as spike,
   round(tension - coalesce(nullif(recent_tension, 0), prev_tension), 9) > 8 as rising,
   sshort and exclamations = 0 and emoji_polarity <= 0 as cold from h1),
hid as (select *,
  1 - least((1 - sarcasm_p) * (1 - least(mismatch + rep, cast(0.95 as double))) * (1 - spike * cast(0.3 as double))
     * case when coop then cast(2.5 as double) else 1 end, 1) as sarcasm_score,
  1 - (1 - irony_p) * (1 - least(mismatch + case when quoted then cast(0.2 as double) else 0 end, cast(0.95 as double))) as irony_score,
  1 - (1 - pa_p) * (1 - least(case when pa_phrase is not null then cast(0.35 as double) else 0 end
     + case when cold then cast(0.15 as double) else 0 end + case when rising then cast(0.2 as double) else 0 end, cast(0.95 as double))) as pa_score,
  {_notes(
      ("round(mismatch, 9) > cast(0.3 as double)", _EV["sarcasm_context"]),
      ("len(sarc_words) > 0", _fmt("sarcasm_markers", _first("sarc_words", 3))),
      ("len(repeated) > 0", _fmt("sarcasm_repeat", _first("repeated", 2))),
      ("coop", _EV["sarcasm_cooperative"]), ("belief", _EV["sarcasm_belief"]),
      ("len(semoji) > 0", _fmt("sarcasm_emoji", _first("semoji", 2))),
      ("exclamations > 0", _EV["sarcasm_exclaim"]),
      ("spike > cast(0.05 as double)", f"printf({_EV['sarcasm_spike']}, spike * 100)"),
  )} as sarcasm_notes,
  {_notes(
      ("round(mismatch, 9) > cast(0.3 as double)", _EV["irony_context"]),
      ("len(inter) > 0", _EV["irony_interjection"]), ("quoted", _EV["irony_quote"]),
  )} as irony_notes,
  {_notes(
      ("pa_phrase is not null", _fmt("pa_phrase", "pa_phrase")), ("cold", _EV["pa_cold"]), ("rising", _EV["pa_rising"]),
  )} as pa_notes,
  least(greatest(exclamations * cast(0.18 as double) + repeated_punctuation * cast(0.22 as double) + caps_share * cast(2.2 as double)
    + negative_hits * cast(0.15 as double) + odd_quote_or_swear * cast(0.3 as double) + exaggeration_hits * cast(0.1 as double), 0), 1) as intensity
 from h2)"""
_W = fixed.FUSION_WEIGHTS
FUSED_SQL = f"""fus as (select *, least(greatest(greatest(sentiment_confidence, emotion_confidence)
    * (cast({_W['text']} as double) + cast({_W['context']} as double) + cast({_W['memory']} as double)) * cast(2.2 as double)
    + intensity * cast({_W['behavior']} as double) + sarcasm_score * cast({_W['hidden']} as double), 0), cast(0.995 as double))
    * cast(0.55 as double) + emotion_confidence * cast(0.45 as double) as confidence from hid)"""


def display(col: str) -> str:
    return f"concat(upper(substr({col}, 1, 1)), substr({col}, 2))"


EXPLAIN_SQL = f"""exp as (select *,
  {_notes(
      ("len(neg_hits) > 0", _fmt("negative", _first("neg_hits", 3))),
      ("len(pos_hits) > 0", _fmt("positive", _first("pos_hits", 3))),
      ("exclamations > 0", f"printf({_EV['exclaim']}, exclamations)"),
      ("ellipses > 0", _EV["ellipsis"]),
      ("len(exagg) > 0", _fmt("exaggeration", _first("exagg", 3))),
      ("emoji_polarity <> 0", f"printf({_EV['emoji']}, emoji_polarity)"),
      ("len(sarc_words) > 0", _fmt("markers", _first("sarc_words", 3))),
      ("pa_phrase is not null", _fmt("phrase", "pa_phrase")),
      ("swears > 0", f"printf({_EV['swear']}, swears)"),
      ("caps_share > cast(0.12 as double)", _EV["caps"]), ("is_short = 1", _EV["short"]),
  )} as detected,
  {_notes(
      ("tension - before_tension > 8", f"printf({_EV['rose']}, tension - before_tension)"),
      ("tension - before_tension < -8", f"printf({_EV['eased']}, tension - before_tension)"),
      ("prev_emotion <> emotion", "concat('emotional shift ', prev_emotion, ' → ', emotion)"),
      ("prev_sentiment <> sentiment", "concat('sentiment shift ', prev_sentiment, ' → ', sentiment)"),
      ("last_emotion in ('frustration', 'anger', 'sadness')", _fmt("speaker_state", "last_emotion")),
      ("len(sarcasm_notes) > 0", _fmt("sarcasm", "array_to_string(sarcasm_notes[1:2], '; ')")),
      ("len(pa_notes) > 0", _fmt("pa", "array_to_string(pa_notes[1:2], '; ')")),
      ("context_text <> ''", _EV["window"]),
  )} as inferred,
  {_notes(
      ("len(neg_hits) > 0", _EV["change_negative"]),
      ("exclamations > 0 or swears > 0", _EV["change_intensity"]),
      ("pa_phrase is not null or pa_score > 0.5", _EV["change_cold"]),
      ("sarcasm_score > 0.5", _EV["change_sarcasm"]),
      ("last_emotion in ('frustration', 'anger')", _EV["change_carry"]), ("is_short = 1", _EV["change_short"]),
  )} as contributing from fus)"""
