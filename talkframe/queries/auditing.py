"""Queries over splits, duplicates, leakage, label checks, fusion search and error taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import fixed, views
from talkframe.functions.text import normal_text
from talkframe.operators import audit, errors, fusion, metrics, records, splits, vectors
from talkframe.operators import sequence as seq
from talkframe.plans import enrich
from talkframe.queries import sqltext as t
from talkframe.queries.aggregates import rounded
from talkframe.queries.evaluation import HASH_SQL
from talkframe.queries.evidence import READ_SQL
from talkframe.queries.evaluation import independence_sql
from talkframe.queries.registry import over_messages, over_signals, query

CONV = "conversation_id"
BINARY = ["sarcasm", "irony", "passive_aggression"]


def in_sql(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BROKEN = """
b as (select *, case when (conversation_id + message_id) % 7 = 0 then 'concerned' else emotion end as e2,
  case when (conversation_id + message_id) % 11 = 0 then 150.0 else tension end as t2,
  case when (conversation_id + message_id) % 13 = 0 then 2 else sarcasm end as s2,
  case when (conversation_id + message_id) % 17 = 0 then '  ' else text end as x2,
  case when (conversation_id + message_id) % 19 = 0 then null else speaker_id end as p2 from messages)"""


@query(
    "validate_records",
    over_messages(_BROKEN.strip() + f"""
select conversation_id, message_id, 'bad emotion' as violation from b where e2 not in {in_sql(fixed.EMOTIONS)}
union all select conversation_id, message_id, 'tension out of range' from b where t2 < 0 or t2 > 100
union all select conversation_id, message_id, 'sarcasm must be 0/1' from b where s2 not in (0, 1)
union all select conversation_id, message_id, 'empty text' from b where trim(x2) = ''
union all select conversation_id, message_id, 'missing speaker_id' from b where p2 is null
union all select conversation_id, message_id, 'missing tone' from b where (conversation_id + message_id) % 29 = 0
union all select conversation_id, message_id, 'escalation must be 0/1' from b where (conversation_id + message_id) % 23 = 0"""),
)
def validate_records(spark, sf):
    k = F.col(CONV) + F.col("message_id")
    rows = views.messages(spark, sf).withColumns(
        {
            "emotion": F.when(k % 7 == 0, "concerned").otherwise(F.col("emotion")),
            "tension": F.when(k % 11 == 0, 150.0).otherwise(F.col("tension")),
            "sarcasm": F.when(k % 13 == 0, 2).otherwise(F.col("sarcasm")),
            "text": F.when(k % 17 == 0, "  ").otherwise(F.col("text")),
            "speaker_id": F.when(k % 19 != 0, F.col("speaker_id")),
            "tone": F.when(k % 29 != 0, F.col("tone")),
            "escalation": F.when(k % 23 == 0, 3).otherwise((F.col("tension") >= 60).cast("int")),
        }
    )
    return audit.validate_records(rows)


@query(
    "validate_conversations",
    over_signals("""
x as (select conversation_id, pos as arrival, case when event_id % 23 = 0 then message_id - 1 when event_id % 29 = 0 then message_id - 2 else message_id end as m from signals),
l as (select *, lag(m) over (partition by conversation_id order by arrival) as p from x)
select conversation_id, m as message_id, 'duplicate id' as violation from x group by 1, 2 having count(*) > 1
union all select conversation_id, m, 'not ascending' from l where m < p"""),
)
def validate_conversations(spark, sf):
    e = F.col("event_id")
    ids = F.when(e % 23 == 0, F.col("message_id") - 1).when(e % 29 == 0, F.col("message_id") - 2).otherwise(F.col("message_id"))
    rows = views.signals(spark, sf).select(CONV, F.col("pos").alias("arrival"), ids.alias("message_id"))
    return audit.validate_conversations(rows)


@query(
    "hash_split",
    over_signals(HASH_SQL.format(src="signals").strip() + "\nselect conversation_id, split from split"),
)
def hash_split(spark, sf):
    return splits.hash_split(views.signals(spark, sf))


@query(
    "stratified_split",
    over_signals("""
s as (select event_id, event_type, user_id % 2 as condition, event_id % 3 as script from signals),
r as (select *, row_number() over (partition by event_type, condition, script order by event_id desc) as rk from s)
select event_id, case when script > 1 then 'test' when rk = 1 then 'test_seen' when rk = 2 then 'val' else 'train' end as split from r"""),
)
def stratified_split(spark, sf):
    rows = views.signals(spark, sf).select(
        "event_id", "event_type", (F.col("user_id") % 2).alias("condition"), (F.col("event_id") % 3).alias("script")
    )
    return splits.stratified_split(rows, ["event_type", "condition"], "script", "event_id").select("event_id", "split")


@query(
    "band_split",
    over_signals("""
s as (select event_id, case when emotion in ('joy', 'affection', 'excitement', 'relief') then 'pos'
   when emotion in ('frustration', 'anger', 'sadness', 'anxiety', 'fear', 'disgust') then 'neg' else 'neu' end as band from signals),
h as (select *, ((((cast(concat('0x', substr(md5(cast(event_id as varchar)), 1, 16)) as ubigint) % 100000000)::hugeint * 9551616)
   + (cast(concat('0x', substr(md5(cast(event_id as varchar)), 17, 16)) as ubigint) % 100000000)::hugeint) % 100000000)::bigint as h from s),
r as (select *, row_number() over (partition by band order by h, event_id) - 1 as rk, count(*) over (partition by band) as n from h)
select event_id, band, case when rk < floor(n * cast(0.7 as double)) then 'train'
  when rk < floor(n * cast(0.7 as double)) + floor(n * cast(0.15 as double)) then 'val' else 'test' end as split from r"""),
)
def band_split(spark, sf):
    band = (
        F.when(F.col("emotion").isin("joy", "affection", "excitement", "relief"), "pos")
        .when(F.col("emotion").isin("frustration", "anger", "sadness", "anxiety", "fear", "disgust"), "neg").otherwise("neu")
    )
    return splits.band_split(views.signals(spark, sf).select("event_id", band.alias("band")), "band", "event_id")


@query("dedup_text", f"select min(doc_id) as doc_id, count(*) as copies from documents group by {t.normal('text')}")
def dedup_text(spark, sf):
    return splits.dedup_text(views.table(spark, sf, "documents"), "text", "doc_id").drop("text_key")


@query(
    "dup_messages",
    f"""with k as (select {t.normal('text')} as k, count(*) as n from conversations group by 1)
select cast(sum(n) as bigint) as messages, count(*) as distinct_texts, round(sum(n) / count(*), 6) as reuse_factor, max(n) as max_repeats from k""",
)
def dup_messages(spark, sf):
    return rounded(audit.duplicate_messages(views.table(spark, sf, "conversations")), "reuse_factor")


@query(
    "dup_conversations",
    over_signals(f"""
g as (select conversation_id, string_agg({t.normal('text')}, '␟' order by pos) as s from signals group by 1),
k as (select s, count(*) as n from g group by 1)
select cast(sum(n - 1) as bigint) as duplicate_conversations, count(*) as distinct_signatures from k"""),
)
def dup_conversations(spark, sf):
    return audit.duplicate_conversations(views.signals(spark, sf))


@query(
    "split_overlap",
    over_signals(HASH_SQL.format(src="signals").strip() + f""",
x as (select s.*, split from signals s join split using (conversation_id)),
g as (select conversation_id, any_value(split) as split, string_agg({t.normal('text')}, '␟' order by pos) as s from x group by 1),
i as (select 'id' as kind, cast(conversation_id as varchar) as item, split from g union all select 'signature', s, split from g
  union all select 'text', {t.normal('text')}, split from x),
f as (select kind, item, max(case when split = 'train' then 1 else 0 end) as a, max(case when split = 'val' then 1 else 0 end) as b,
  max(case when split = 'test' then 1 else 0 end) as c from i group by 1, 2)
select kind, cast(sum(a * b) as bigint) as train_val, cast(sum(a * c) as bigint) as train_test, cast(sum(b * c) as bigint) as val_test from f group by 1"""),
)
def split_overlap(spark, sf):
    return audit.split_overlap(splits.with_split(views.signals(spark, sf)))


@query(
    "cell_balance",
    """with c as (select lang, source, count(*) as n from documents group by cube (lang, source))
select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, n,
 min(n) filter (lang is not null and source is not null) over () as cell_min, max(n) filter (lang is not null and source is not null) over () as cell_max from c""",
)
def cell_balance(spark, sf):
    cells = views.table(spark, sf, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    whole = seq.Window.partitionBy()  # one row per cell and margin
    cell = F.when(F.col("g") == 0, F.col("n"))
    return cells.select(
        F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n",
        F.min(cell).over(whole).alias("cell_min"), F.max(cell).over(whole).alias("cell_max"),
    )


@query(
    "probe_balance",
    over_signals("""
c as (select concat(event_type, '-', event_id % 50) as u, pred_sentiment as s, count(*) as k from signals group by 1, 2)
select k as label_count, count(*) as n_pairs from c group by 1"""),
)
def probe_balance(spark, sf):
    u = F.concat("event_type", F.lit("-"), (F.col("event_id") % 50).cast("string"))
    c = views.signals(spark, sf).groupBy(u.alias("u"), "pred_sentiment").agg(F.count(F.lit(1)).alias("label_count"))
    return c.groupBy("label_count").agg(F.count(F.lit(1)).alias("n_pairs"))


def _imbalance_sql() -> str:
    heads = {"sentiment": fixed.SENTIMENTS, "emotion": fixed.EMOTIONS, "tone": fixed.TONES}
    out = []
    for h, labels in heads.items():
        out.append(
            f"select '{h}' as head, max(k) as largest, min(k) as smallest, round(max(k) / any_value(n), 6) as share, "
            f"round(max(k) / greatest(min(k), 1), 6) as ratio, max(k) / any_value(n) < 0.9 as ok from "
            f"(select l, count(m.{h}) as k, (select count(*) from messages) as n from (select unnest([{', '.join(t.q(v) for v in labels)}]) as l) z "
            f"left join messages m on m.{h} = l group by l)"
        )
    for b in BINARY:
        out.append(
            f"select '{b}', greatest(sum({b}), count(*) - sum({b}))::bigint, least(sum({b}), count(*) - sum({b}))::bigint, round(avg({b}), 6), "
            f"round((count(*) - sum({b})) / greatest(sum({b}), 1), 6), avg({b}) between 0.02 and 0.6 from messages"
        )
    return " union all ".join(out)


@query("class_imbalance", over_messages(_imbalance_sql()))
def class_imbalance(spark, sf):
    heads = {"sentiment": fixed.SENTIMENTS, "emotion": fixed.EMOTIONS, "tone": fixed.TONES}
    return rounded(audit.class_imbalance(views.messages(spark, sf), heads, BINARY), "share", "ratio")


def design_table(rows):
    """One design row per normalised text: the labels of its first message."""
    first = F.min(F.struct(CONV, "message_id", *BINARY)).alias("f")
    d = rows.groupBy(F.md5(normal_text(F.col("text"))).alias("text_key")).agg(first)
    return d.select("text_key", *[F.col(f"f.{b}").alias(f"design_{b}") for b in BINARY])


DESIGN_SQL = f"""
nm as (select *, {t.normal('text')} as k from messages),
design as (select k, arg_min(sarcasm, conversation_id * 1000 + message_id) as d_sarcasm, arg_min(irony, conversation_id * 1000 + message_id) as d_irony,
  arg_min(passive_aggression, conversation_id * 1000 + message_id) as d_passive_aggression from nm group by 1)"""


@query(
    "design_lookup",
    over_messages(DESIGN_SQL.strip() + """
select conversation_id, message_id, d_sarcasm as design_sarcasm, d_irony as design_irony, d_passive_aggression as design_passive_aggression
from nm join design using (k)"""),
)
def design_lookup(spark, sf):
    rows = views.messages(spark, sf)
    found = records.design_lookup(rows, design_table(rows), F.md5(normal_text(F.col("text"))))
    return found.select(CONV, "message_id", *[f"design_{b}" for b in BINARY])


@query(
    "noise_rate",
    over_messages(DESIGN_SQL.strip() + """,
x as (select cast(sarcasm <> d_sarcasm as integer) as a, cast(irony <> d_irony as integer) as b, cast(passive_aggression <> d_passive_aggression as integer) as c
  from nm join design using (k))
select count(*) as messages, cast(sum(greatest(a, b, c)) as bigint) as flipped, cast(sum(a) as bigint) as flips_sarcasm, cast(sum(b) as bigint) as flips_irony,
 cast(sum(c) as bigint) as flips_passive_aggression, round(avg(greatest(a, b, c)), 6) as rate,
 avg(greatest(a, b, c)) between 0.015 * 0.25 and 0.015 * 2.5 as passed from x"""),
)
def noise_rate(spark, sf):
    rows = views.messages(spark, sf)
    return rounded(audit.label_noise(rows, design_table(rows), BINARY), "rate")


@query(
    "bounds_check",
    over_signals("""
select 'p' as field, count(*) filter (p < 0 or p > 1) as violations, count(*) as checked from signals
union all select 'confidence', count(*) filter (confidence < 0 or confidence > 1), count(*) from signals
union all select 'tension', count(*) filter (tension < 0 or tension > 100), count(*) from signals
union all select 'gold_tension', count(*) filter (gold_tension < 0 or gold_tension > 100), count(*) from signals"""),
)
def bounds_check(spark, sf):
    return audit.bounds(views.signals(spark, sf), ["p", "confidence"], ["tension", "gold_tension"])


@query(
    "audit_gates",
    over_signals(HASH_SQL.format(src="signals").strip() + f""",
x as (select s.*, split from signals s join split using (conversation_id)),
g as (select conversation_id, any_value(split) as split, string_agg({t.normal('text')}, '␟' order by pos) as s from x group by 1),
m as (select avg(tension) filter (split = 'train') as ma, avg(tension) filter (split = 'test') as mb, var_samp(tension) filter (split = 'train') as va,
  var_samp(tension) filter (split = 'test') as vb, count(*) filter (split = 'train') as na, count(*) filter (split = 'test') as nb from x),
{", ".join(independence_sql("x", h) for h in ("sentiment", "emotion", "tone"))},
gates as (select 'separation' as gate, (select count(*) from (select conversation_id from x group by 1 having count(distinct split) > 1) q) = 0 as passed
  union all select 'contamination', (select count(*) from (select s from g group by 1 having max(case when split = 'test' then 1 else 0 end) = 1 and count(distinct split) > 1) q) = 0
  union all select 'duplicate_conversations', (select count(*) from g) = (select count(distinct s) from g)
  union all select 'split_balance', (select abs((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))) < cast(0.2 as double) from m)
  {" ".join(f"union all select 'independence_{h}', ok from p_{h}" for h in ("sentiment", "emotion", "tone"))})
select gate, passed from gates union all select 'verdict', bool_and(passed) from gates"""),
)
def audit_gates(spark, sf):
    return audit.release_gates(splits.with_split(views.placed_signals(spark, sf)))


_PAIRS = ", ".join(f"({i}, cast({float(a)!r} as double), cast({float(b)!r} as double))" for i, (a, b) in enumerate(fusion.candidates()))


@query(
    "fusion_search",
    over_messages(f"""{READ_SQL},
fx as (select abs(tension - (case when (conversation_id + message_id) % 4 = 0 then tension else (tension * 7) % 101 end)) as miss,
  greatest(sentiment_confidence, emotion_confidence) as tx, intensity as bh, sarcasm_score as hd from hid),
tau as (select greatest(quantile_cont(miss, 0.5), 1) as tau from fx),
cand(i, b, h) as (values {_PAIRS}),
loss as (select i, any_value(b) as b, any_value(h) as h, avg((least(greatest(tx * cast(0.66 as double) * cast(2.2 as double) + bh * b + hd * h, 0), cast(0.995 as double))
   - exp(-((miss / tau) ** 2))) ** 2) as loss from fx, tau, cand group by i),
pick as (select (select loss from loss where i = 0) as fb, (select min(loss) from loss where i > 0) as best),
win as (select loss.*, best < fb - 1e-9 as tuned from loss, pick where case when best < fb - 1e-9 then i > 0 and loss = best else i = 0 end)
select round(b, 6) as behavior, round(h, 6) as hidden, cast(0.3 as double) as text, cast(0.22 as double) as context, cast(0.14 as double) as memory,
 cast(0.1 as double) as temporal, round(loss, 6) as loss, tuned from win"""),
)
def fusion_search(spark, sf):
    read = enrich.read_messages(views.messages(spark, sf))
    gold = F.when((F.col(CONV) + F.col("message_id")) % 4 == 0, F.col("tension")).otherwise((F.col("tension") * 7) % 101)
    evidence = {"text": F.greatest("sentiment_confidence", "emotion_confidence"), "behavior": F.col("intensity"), "hidden": F.col("sarcasm_score")}
    return rounded(fusion.search(read, F.col("tension"), gold, evidence), "behavior", "hidden", "loss")


@query(
    "error_taxonomy",
    over_messages(f"""{READ_SQL}, {DESIGN_SQL.strip()},
gx as (select *, case when (conversation_id + message_id) % 3 = 0 then 'neutral' else emotion end as g_emotion,
   case when (conversation_id + message_id) % 5 = 0 then 'neutral' else sentiment end as g_sentiment,
   case when (conversation_id + message_id) % 7 = 0 then 'casual' else tone end as g_tone,
   case when len(sarc_words) > 0 or sarcasm_score > 0.5 then 'sarcasm interference' when sshort then 'short-message ambiguity'
     when emoji_polarity <> 0 then 'emoji polarity conflict' when len(neg_hits) > 0 and len(pos_hits) > 0 then 'mixed polarity'
     else 'context disagreement' end as kind from hid),
er as (select kind, 0 as noise from gx where g_emotion <> emotion union all select kind, 0 from gx where g_sentiment <> sentiment
  union all select kind, 0 from gx where g_tone <> tone),
bx as (select h.*, d_sarcasm, d_irony, d_passive_aggression from hid h join nm on nm.conversation_id = h.conversation_id and nm.message_id = h.message_id join design using (k)),
br as (select 'sarcasm' as head, sarcasm as g, cast(sarcasm_score >= 0.5 as integer) as p, d_sarcasm as d from bx
  union all select 'irony', irony, cast(irony_score >= 0.5 as integer), d_irony from bx
  union all select 'passive_aggression', passive_aggression, cast(pa_score >= 0.5 as integer), d_passive_aggression from bx),
al as (select kind, noise from er union all
  select concat(head, ':', case when g = 1 then 'false_negative' else 'false_positive' end), cast(d <> g as integer) from br where g <> p)
select kind as error_type, count(*) as errors, cast(sum(noise) as bigint) as noise_attributed, cast(count(*) - sum(noise) as bigint) as remaining from al group by 1"""),
)
def error_taxonomy(spark, sf):
    base = views.messages(spark, sf)
    k = F.col(CONV) + F.col("message_id")
    read = enrich.read_messages(base).withColumns(
        {
            "g_emotion": F.when(k % 3 == 0, "neutral").otherwise(F.col("emotion")),
            "g_sentiment": F.when(k % 5 == 0, "neutral").otherwise(F.col("sentiment")),
            "g_tone": F.when(k % 7 == 0, "casual").otherwise(F.col("tone")),
        }
    )
    labels = errors.label_errors(read, {"emotion": "g_emotion", "sentiment": "g_sentiment", "tone": "g_tone"})
    binary = errors.binary_errors(
        read,
        {"sarcasm": ("sarcasm_score", "sarcasm_p"), "irony": ("irony_score", "irony_p"), "passive_aggression": ("pa_score", "pa_p")},
        design_table(base),
    )
    return errors.taxonomy(labels, binary)


@query(
    "embedding_norm",
    """with n as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * y))), 1e-12)) as u from embeddings),
e as (select label, unnest(range(0, 64)) as dim, unnest(u) as x from n)
select label, cast(dim as integer) as dim, round(avg(x), 6) as value from e group by 1, 2""",
)
def embedding_norm(spark, sf):
    rows = views.table(spark, sf, "embeddings").select("label", vectors.unit(F.col("embedding")).alias("u"))
    return rounded(vectors.mean_pool(rows, ["label"], "u"), "value")


@query(
    "tfidf_terms",
    f"""with tk as (select conv_id * 100 + turn as id, list_filter({t.runs(f"lower({t.process('text')})")}, lambda w: length(w) >= 2) as k from conversations),
g as (select id, unnest(case when len(k) > 1 then list_concat(k, list_transform(range(1, len(k)), lambda i: concat(k[i], ' ', k[i + 1]))) else k end) as term from tk),
tf as (select id, term, count(*) as tf from g group by 1, 2),
st as (select term, count(*) as df, sum(tf) as total from tf group by 1 having count(*) >= 2),
vo as (select term, df from (select *, row_number() over (order by total desc, term) as rk from st) z where rk <= 12000),
w as (select id, term, df, (1 + ln(tf)) * (ln((1 + (select count(*) from conversations)) / (1 + df)) + 1) as w from tf join vo using (term))
select id, term, df, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from w""",
)
def tfidf_terms(spark, sf):
    docs = views.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    counts = vectors.term_counts(docs, "id")
    out = vectors.tfidf(counts, vectors.vocabulary(counts, docs.count()), "id")
    return rounded(out.select("id", "term", "df", "weight"), "weight")
