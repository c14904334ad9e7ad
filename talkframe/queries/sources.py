"""Queries over sources, sinks and label adapters. Exports are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import fixed, views
from talkframe.operators import records, temporal
from talkframe.queries import sqltext as t
from talkframe.queries.ordered import sql_map
from talkframe.queries.registry import over_messages, over_signals, query
from talkframe.session import settle, work_dir
from talkframe.sources import adapters, exports, tables

CONV = "conversation_id"
# One line per message: white space collapsed, because an export line cannot hold a line break.
_FLAT = "trim(regexp_replace({c}, '[\\s]+', ' ', 'g'))"
FLAT_SQL = f"flat as (select conv_id, turn, role, {_FLAT.format(c='text')} as said from conversations)"


def flat(spark, sf):
    said = F.trim(F.regexp_replace("text", r"[\s]+", " "))
    return views.table(spark, sf, "conversations").select("conv_id", "turn", "role", said.alias("said"))


def documents(rows, item, join=None):
    """Exports of at most 1,000 messages each: one text per file."""
    part = F.expr("turn div 1000")
    packed = rows.select("conv_id", part.alias("part"), "turn", item.alias("item")).groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "item"))).alias("a")
    )
    items = F.transform("a", lambda x: x["item"])
    raw = F.array_join(items, "\n") if join is None else F.concat(F.lit("["), F.array_join(items, join), F.lit("]"))
    return packed.select((F.col("conv_id") * 1000 + F.col("part")).cast("string").alias("file_id"), raw.alias("raw"))


def _out(df):
    return df.select(CONV, "message_id", "speaker_id", "ts", "text", "platform")


_CID = "cast(conv_id * 1000 + turn // 1000 as varchar) as conversation_id, turn % 1000 + 1 as message_id"


def phone_lines(rows):
    d, m, hh = F.col("conv_id") % 28 + 1, F.col("turn") % 12 + 1, (F.col("conv_id") + F.col("turn")) % 24
    date = F.when(F.col("conv_id") % 2 == 0, F.format_string("%d/%d/24", d, m)).otherwise(F.format_string("%d/%d/24", m, d))
    clock = F.format_string("%d:%02d %s", (hh + 11) % 12 + 1, F.col("turn") % 60, F.when(hh < 12, "AM").otherwise("PM"))
    more = F.when(F.col("turn") % 3 == 1, "\n  carried on \n<Media omitted>").otherwise("")
    return F.concat(date, F.lit(", "), clock, F.lit(" - "), F.col("role"), F.lit(": "), F.col("said"), more)


_PHONE_SQL = f"""select {_CID}, role as speaker_id,
 strftime(make_timestamp(2024, case when conv_id % 2 = 0 or conv_id % 28 + 1 > 12 then turn % 12 + 1 else conv_id % 28 + 1 end,
   case when conv_id % 2 = 0 or conv_id % 28 + 1 > 12 then conv_id % 28 + 1 else turn % 12 + 1 end, (conv_id + turn) % 24, turn % 60, 0), '%Y-%m-%d %H:%M:%S') as ts,
 concat(said, case when turn % 3 = 1 then chr(10) || 'carried on' else '' end) as text, 'whatsapp' as platform from flat"""


@query("ingest_whatsapp", f"with {FLAT_SQL} {_PHONE_SQL}")
def ingest_whatsapp(spark, sf):
    rows = flat(spark, sf)
    return _out(exports.parse_phone(exports.lines(documents(rows, phone_lines(rows)))))


_CLOCK_SQL = f"""select {_CID}, role as speaker_id, printf('%02d:%02d', conv_id % 24, turn % 60) as ts,
 concat(said, case when turn % 3 = 1 then chr(10) || 'and more' else '' end) as text, 'discord' as platform from flat"""


def clock_lines():
    stamp = F.format_string("[%02d:%02d] ", F.col("conv_id") % 24, F.col("turn") % 60)
    return F.concat(stamp, F.col("role"), F.lit(": "), F.col("said"), F.when(F.col("turn") % 3 == 1, "\n\n and more").otherwise(""))


def author_items():
    return F.to_json(F.struct(
        F.struct(F.col("role").alias("username")).alias("author"), F.format_string("2024-01-01T%02d:00:00", F.col("turn") % 24).alias("timestamp"),
        F.col("said").alias("content")))


@query(
    "ingest_discord",
    f"""with {FLAT_SQL} select * from ({_CLOCK_SQL}) q where cast(conversation_id as bigint) // 1000 % 2 = 1
union all select {_CID}, role, printf('2024-01-01T%02d:00:00', turn % 24), said, 'discord' from flat where conv_id % 2 = 0""",
)
def ingest_discord(spark, sf):
    rows = flat(spark, sf)
    texts = documents(rows.filter("conv_id % 2 = 1"), clock_lines())
    arrays = documents(rows.filter("conv_id % 2 = 0"), author_items(), ",")
    return _out(exports.ingest(texts.unionByName(arrays), platform="discord"))


def epoch_items():
    return F.to_json(F.struct(
        F.col("role").alias("user"), F.col("said").alias("text"), (F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).cast("string").alias("ts"),
        F.when(F.col("turn") % 4 == 3, "channel_join").alias("subtype")))


_EPOCH_SQL = f"""select cast(conv_id * 1000 + turn // 1000 as varchar) as conversation_id,
 row_number() over (partition by conv_id, turn // 1000 order by turn) as message_id, role as speaker_id,
 strftime(timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn), '%Y-%m-%d %H:%M:%S') as ts, said as text, 'slack' as platform
 from flat where turn % 4 <> 3 and said <> ''"""


@query("ingest_slack", f"with {FLAT_SQL} {_EPOCH_SQL}")
def ingest_slack(spark, sf):
    return _out(exports.parse_epoch_json(documents(flat(spark, sf), epoch_items(), ",")))


_SPEAK_SQL = f"""select {_CID}, case when turn % 5 = 4 then 'user' else role end as speaker_id, cast(null as varchar) as ts,
 case when turn % 5 = 4 then concat('https://example.org: ', said) else said end as text, 'generic' as platform from flat"""


def speaker_lines():
    return F.when(F.col("turn") % 5 == 4, F.concat(F.lit("https://example.org: "), F.col("said"))).otherwise(F.concat("role", F.lit(": "), "said"))


@query("ingest_generic", f"with {FLAT_SQL} {_SPEAK_SQL}")
def ingest_generic(spark, sf):
    """Written as text files, read back, one message per line."""
    docs = documents(flat(spark, sf), speaker_lines())
    path = work_dir(spark, "lines")
    docs.select(F.concat("file_id", F.lit("\t"), F.replace("raw", F.lit("\n"), F.lit("\x02"))).alias("value")).write.text(path)
    back = spark.read.text(path).select(
        F.substring_index("value", "\t", 1).alias("file_id"), F.replace(F.regexp_replace("value", "^[^\t]*\t", ""), F.lit("\x02"), F.lit("\n")).alias("raw")
    )
    return _out(exports.parse_speaker_lines(exports.lines(back)))


_JSON_SQL = f"""select {_CID}, case when turn % 3 = 2 then 'user' else role end as speaker_id,
 printf('2024-01-01T%02d:00:00', turn % 24) as ts, said as text, 'json' as platform from flat"""


def json_items():
    return F.to_json(F.struct(
        F.when(F.col("turn") % 3 == 0, F.col("role")).alias("speaker"), F.when(F.col("turn") % 3 == 1, F.col("role")).alias("speaker_id"),
        F.format_string("2024-01-01T%02d:00:00", F.col("turn") % 24).alias("timestamp"), F.col("said").alias("text")))


@query("ingest_json", f"with {FLAT_SQL} {_JSON_SQL}")
def ingest_json(spark, sf):
    docs = documents(flat(spark, sf), json_items(), ",")
    wrapped = F.when(F.col("file_id").cast("long") % 2000 == 0, F.concat(F.lit('{"messages": '), "raw", F.lit("}"))).otherwise(F.col("raw"))
    return _out(exports.parse_json(docs.withColumn("raw", wrapped)))


_CSV_SQL = f"""select {_CID}, case when turn % 3 = 2 then 'user' else role end as speaker_id, printf('2024-01-01T%02d:00:00', turn % 24) as ts,
 said as text, 'csv' as platform from flat"""


def csv_lines():
    quoted = F.concat(F.lit('"'), F.replace("said", F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", F.when(F.col("turn") % 3 != 2, F.col("role")).otherwise(""), F.format_string("2024-01-01T%02d:00:00", F.col("turn") % 24), quoted)
    return F.concat(F.when(F.col("turn") % 1000 == 0, "speaker,timestamp,text\n").otherwise(""), row)


@query("ingest_csv", f"with {FLAT_SQL} {_CSV_SQL}")
def ingest_csv(spark, sf):
    return _out(exports.parse_csv_text(documents(flat(spark, sf), csv_lines())))


_BARE = "replace(said, ',', ';')"


def odd_csv_lines():
    """CSV lines by turn: quoted; quoted with a line break; bare with stray quotes; bare, with text behind the closing quote.

    Headers by conversation: plain, in another order, and with a repeated name whose last column counts.
    """
    inner, bare, turn = F.replace("said", F.lit('"'), F.lit('""')), F.expr(_BARE), F.col("turn") % 4
    text = (
        F.when(turn == 0, F.concat(F.lit('"'), inner, F.lit('"'))).when(turn == 1, F.concat(F.lit('"'), inner, F.lit(',\n""more"""')))
        .when(turn == 2, F.concat(F.lit('a 5" '), bare, F.lit(' "'))).otherwise(F.concat(F.lit('"x, "'), bare, F.lit('"y"')))
    )
    kind, stamp, said = F.col("conv_id") % 5, F.format_string("2024-01-01T%02d:00:00", F.col("turn") % 24), F.replace(text, F.lit("\r"), F.lit(""))
    row = (
        F.when(kind == 0, F.concat_ws(",", "role", stamp, said)).when(kind == 1, F.concat_ws(",", stamp, said, "role"))
        .otherwise(F.concat_ws(",", "role", F.lit('"decoy, 1"'), stamp, said, F.lit("more")))
    )
    head = F.when(kind == 0, "speaker,timestamp,text\n").when(kind == 1, "timestamp,text,speaker\r\n").otherwise("speaker,text,timestamp,text\n\n")
    return F.concat(F.when(F.col("turn") % 1000 == 0, head).otherwise(""), row, F.when(F.col("turn") % 7 == 3, "\r").otherwise(""))


MIXED_SQL = f"""{FLAT_SQL}, c as (select {_CID}, role as speaker_id, printf('2024-01-01T%02d:00:00', turn % 24) as ts,
  case turn % 4 when 0 then said when 1 then said || ',' || chr(10) || '"more"' when 2 then 'a 5" ' || {_BARE} || ' "' else 'x, ' || {_BARE} || '"y"' end as text,
  'csv' as platform from flat where conv_id % 5 < 3),
mixed as (select * from c union all select * from ({_PHONE_SQL} where conv_id % 5 = 3) q union all select * from ({_SPEAK_SQL} where conv_id % 5 = 4) r)"""


def mixed_documents(spark, sf):
    """Files of several kinds."""
    rows = flat(spark, sf)
    docs = documents(rows.filter("conv_id % 5 < 3"), odd_csv_lines())
    docs = docs.unionByName(documents(rows.filter("conv_id % 5 = 3"), phone_lines(rows)))
    return docs.unionByName(documents(rows.filter("conv_id % 5 = 4"), speaker_lines()))


@query("ingest_mixed", f"with {MIXED_SQL} select * from mixed")
def ingest_mixed(spark, sf):
    """Files of several kinds at once; every message written comes back."""
    return _out(exports.ingest(mixed_documents(spark, sf)))


@query(
    "detect_platform",
    f"""with {FLAT_SQL}, a as (select * from ({_PHONE_SQL}) q union all select * from ({_CLOCK_SQL}) q union all select * from ({_SPEAK_SQL}) q
 union all select * from ({_JSON_SQL}) q union all select * from ({_CSV_SQL}) q)
select * from a where platform = case cast(conversation_id as bigint) // 1000 % 5 when 0 then 'whatsapp' when 1 then 'discord' when 2 then 'generic'
 when 3 then 'json' else 'csv' end""",
)
def detect_platform(spark, sf):
    rows = flat(spark, sf)
    kinds = [(phone_lines(rows), None), (clock_lines(), None), (speaker_lines(), None), (json_items(), ","), (csv_lines(), None)]
    docs = None
    for i, (item, join) in enumerate(kinds):
        part = documents(rows.filter(F.col("conv_id") % 5 == i), item, join)
        docs = part if docs is None else docs.unionByName(part)
    return _out(exports.ingest(docs))


@query(
    "ingest_rejects",
    """with d as (select source, lang, sum(strlen(text) + 1) as bytes from documents group by 1, 2) select source, lang, cast(bytes as bigint) as bytes from d where bytes > 65536""",
)
def ingest_rejects(spark, sf):
    """Files larger than the limit, found from the listing without reading them."""
    docs = views.table(spark, sf, "documents").select("source", "lang", F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")).alias("value"))
    path = work_dir(spark, "uploads")
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    listed = exports.rejected_exports(spark, path, max_bytes=0)
    name = F.regexp_extract("file_id", "source=([^/]*)/", 1), F.regexp_extract("file_id", "lang=([^/]*)/", 1)
    whole = listed.groupBy(name[0].alias("source"), name[1].alias("lang")).agg(F.sum("bytes").alias("bytes"))
    return whole.filter(F.col("bytes") > 65536)


_LINE_SCHEMA = "conv_id long, turn long, role string, text string"


@query("scan_jsonl", "select conv_id, turn, role, text from conversations")
def scan_jsonl(spark, sf):
    t_ = views.table(spark, sf, "conversations")
    path = work_dir(spark, "jsonl")
    blank = F.when(F.col("turn") % 2 == 0, "").otherwise("  ")
    t_.select(F.explode(F.array(F.to_json(F.struct("conv_id", "turn", "role", "text")), blank)).alias("value")).write.text(path)
    return tables.read_jsonl(spark, path, _LINE_SCHEMA)


@query("sink_jsonl_roundtrip", over_messages("select conversation_id, message_id, speaker_id, text, emotion, tension from messages"))
def sink_jsonl_roundtrip(spark, sf):
    rows = views.messages(spark, sf).select(CONV, "message_id", "speaker_id", "text", "emotion", "tension")
    path = tables.write_jsonl(rows, work_dir(spark, "sink"))
    return tables.read_jsonl(spark, path, rows.schema)


@query(
    "sink_report_roundtrip",
    over_signals("""select conversation_id, count(*) as n, max(tension) as peak_tension,
 count(*) filter (tension >= 60) as hot from signals group by 1"""),
)
def sink_report_roundtrip(spark, sf):
    rows = views.signals(spark, sf)
    report = {
        "trajectory": temporal.trajectory(rows).select(CONV, "n", "peak_tension"),
        "timeline": records.timeline(rows),
    }
    path = tables.write_report(report, work_dir(spark, "report"))
    hot = tables.read_report(spark, path, "timeline").groupBy(CONV).agg(F.count(F.when(F.col("tension") >= 60, 1)).alias("hot"))
    return tables.read_report(spark, path, "trajectory").join(hot, CONV)


@query(
    "erase_conversations",
    over_signals("select conversation_id, message_id, tension from signals where conversation_id not in (select user_id * 10 + 1 from events where user_id % 3 = 0)"),
)
def erase_conversations(spark, sf):
    rows = views.signals(spark, sf)
    gone = rows.filter(F.col("user_id") % 3 == 0).select((F.col("user_id") * 10 + 1).alias(CONV))
    return records.erase(rows.select(CONV, "message_id", "tension"), gone)


def _labelled_sql(src: str) -> str:
    return f"""select conversation_id, message_id, speaker_id, text, emotion, {sql_map('emotion', fixed.EMOTION_SENTIMENT)} as sentiment, tone, sarcasm,
 least({sql_map('emotion', fixed.EMOTION_TENSION)} + 15 * sarcasm, 100) as tension,
 cast(least({sql_map('emotion', fixed.EMOTION_TENSION)} + 15 * sarcasm, 100) >= 60 as integer) as escalation from {src}"""


def _labelled(df):
    return df.select(CONV, "message_id", "speaker_id", "text", "emotion", "sentiment", "tone", "sarcasm", "tension", "escalation")


_PRIORITY = ", ".join(f"({fixed.SOURCE_LABELS.index(n)}, {i}, '{e}')" for i, (n, e) in enumerate(fixed.LABEL_PRIORITY))


@query(
    "adapt_priority_labels",
    f"""with src as (select conv_id * 100 + turn as line_no, trim(text) as text, [(conv_id * 7 + turn) % 29, (conv_id * 3 + turn * 5) % 29] as labels from conversations),
l as (select line_no, unnest(labels) as lab from src), p(lab, pr, emo) as (values {_PRIORITY}),
b as (select line_no, arg_min(emo, pr) as emo from l join p using (lab) group by 1),
r as (select concat('goe_', line_no) as conversation_id, cast(1 as bigint) as message_id, 'anon' as speaker_id, text, coalesce(emo, 'neutral') as emotion,
  'casual' as tone, 0 as sarcasm from src left join b using (line_no) where text <> '')
{_labelled_sql('r')}""",
)
def adapt_priority_labels(spark, sf):
    c, u = F.col("conv_id"), F.col("turn")
    rows = views.table(spark, sf, "conversations").select(
        (c * 100 + u).alias("line_no"), "text", F.array(((c * 7 + u) % 29).cast("int"), ((c * 3 + u * 5) % 29).cast("int")).alias("labels")
    )
    return _labelled(adapters.priority_labels(rows))


def _count_words(values):
    return " + ".join(f"cast(contains(lower(text), {t.q(w)}) as integer)" for w in values)


@query(
    "adapt_author_threads",
    over_messages(f"""
a as (select conversation_id * 100 + message_id as line_no, text, case when message_id % 7 = 6 then concat('anon', conversation_id * 100 + message_id)
   else concat('author', conversation_id % 13) end as author, sarcasm as lab from messages where trim(text) <> ''),
n as (select *, {_count_words(fixed.THREAD_POSITIVE)} as pc, {_count_words(fixed.THREAD_NEGATIVE)} as nc from a),
r as (select concat('sarc_', author) as conversation_id, row_number() over (partition by author order by line_no) as message_id, author as speaker_id, {t.strip('text')} as text,
  case when nc > pc then 'frustration' when pc > nc then 'joy' else 'neutral' end as emotion, case when lab = 1 then 'sarcastic' else 'casual' end as tone, lab as sarcasm from n)
{_labelled_sql('r')}""").replace("),\na as", "),\na as"),
)
def adapt_author_threads(spark, sf):
    m = views.messages(spark, sf)
    line = (F.col(CONV) * 100 + F.col("message_id")).alias("line_no")
    author = F.when(F.col("message_id") % 7 != 6, F.concat(F.lit("author"), (F.col(CONV) % 13).cast("string"))).alias("author")
    return _labelled(adapters.author_threads(m.select(line, F.col("sarcasm").alias("label"), F.col("text").alias("comment"), author)))


_DD = ", ".join(f"'{e}'" for e in fixed.DIALOGUE_EMOTIONS)


@query(
    "adapt_dialogues",
    f"""with {FLAT_SQL},
x as (select conv_id, turn, said, (conv_id + turn) % 7 as e, count(*) over (partition by conv_id, turn // 1000) as n from flat),
r as (select concat('dd_d', conv_id * 1000 + turn // 1000) as conversation_id, turn % 1000 + 1 as message_id, case when turn % 2 = 0 then 'A' else 'B' end as speaker_id, said as text,
  ([{_DD}])[e + 1] as emotion, 0 as sarcasm from x where conv_id % 4 <> 1 or turn % 1000 < n - 1),
s as (select *, case {sql_map('emotion', fixed.EMOTION_SENTIMENT)} when 'positive' then 'friendly' when 'negative' then 'frustrated' else 'casual' end as tone from r)
{_labelled_sql('s')}""",
)
def adapt_dialogues(spark, sf):
    """Line-aligned files, one dialogue of at most 1,000 turns per line; every fourth conversation is one emotion short."""
    line = (F.col("conv_id") * 1000 + F.expr("turn div 1000")).alias("line_no")
    packed = flat(spark, sf).groupBy("conv_id", line).agg(
        F.sort_array(F.collect_list(F.struct("turn", "said", ((F.col("conv_id") + F.col("turn")) % 7).cast("string").alias("e")))).alias("a")
    )
    u = packed.select("line_no", F.array_join(F.transform("a", lambda x: x["said"]), " __eou__ ").alias("line"))
    short = F.when(F.col("conv_id") % 4 == 1, F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(0)))).otherwise(F.col("a"))
    e = packed.select("line_no", F.array_join(F.transform(short, lambda x: x["e"]), " ").alias("line"))
    return _labelled(adapters.dialogues(u, e))


@query(
    "adapt_files",
    f"""with {FLAT_SQL}, k as (select *, row_number() over (order by conv_id, turn) - 1 as nr from flat),
pl as (select 2 * nr as line_no, said as text, [(conv_id * 7 + turn) % 29, (conv_id * 3 + turn * 5) % 29] as labels from k),
l as (select line_no, unnest(labels) as lab from pl), p(lab, pr, emo) as (values {_PRIORITY}),
b as (select line_no, arg_min(emo, pr) as emo from l join p using (lab) group by 1),
g as (select concat('goe_', line_no) as conversation_id, cast(1 as bigint) as message_id, 'anon' as speaker_id, text, coalesce(emo, 'neutral') as emotion,
  'casual' as tone, 0 as sarcasm from pl left join b using (line_no) where text <> ''),
th as (select 2 * nr as line_no, said as text, concat('author', conv_id % 13) as author, cast((conv_id + turn) % 3 = 0 as integer) as lab from k where said <> ''),
n as (select *, {_count_words(fixed.THREAD_POSITIVE)} as pc, {_count_words(fixed.THREAD_NEGATIVE)} as nc from th),
s1 as (select concat('sarc_', author) as conversation_id, row_number() over (partition by author order by line_no) as message_id, author as speaker_id, text,
  case when nc > pc then 'frustration' when pc > nc then 'joy' else 'neutral' end as emotion, case when lab = 1 then 'sarcastic' else 'casual' end as tone, lab as sarcasm from n),
x as (select *, dense_rank() over (order by conv_id, turn // 1000) - 1 as line, count(*) over (partition by conv_id, turn // 1000) as len from flat),
d as (select concat('dd_d', line) as conversation_id, row_number() over (partition by line order by turn) as message_id, turn, said as text,
  ([{_DD}])[(conv_id + turn) % 7 + 1] as emotion, 0 as sarcasm from x where said <> ''),
d1 as (select conversation_id, message_id, case when message_id % 2 = 1 then 'A' else 'B' end as speaker_id, text, emotion,
  case {sql_map('emotion', fixed.EMOTION_SENTIMENT)} when 'positive' then 'friendly' when 'negative' then 'frustrated' else 'casual' end as tone, sarcasm from d),
r as (select * from g union all select * from s1 union all select * from d1)
{_labelled_sql('r')}""",
)
def adapt_files(spark, sf):
    """Label corpora read from files: JSON lines in several parts with blank lines between, and three line-aligned text files."""
    rows = flat(spark, sf)
    c, u = F.col("conv_id"), F.col("turn")

    def written(df, name, parts, *order):
        path = work_dir(spark, name)
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.explode("lines").alias("value")).write.text(path)
        return path

    marks = F.array(((c * 7 + u) % 29).cast("int"), ((c * 3 + u * 5) % 29).cast("int"))
    first = F.to_json(F.struct(F.col("said").alias("text"), marks.alias("labels")))
    second = F.to_json(F.struct(((c + u) % 3 == 0).cast("int").alias("label"), F.col("said").alias("comment"), F.concat(F.lit("author"), (c % 13).cast("string")).alias("author")))
    goe = written(rows.withColumn("lines", F.array(first, F.lit("  "))), "labels", 3, "conv_id", "turn")
    sarc = written(rows.withColumn("lines", F.array(second, F.lit(""))), "threads", 2, "conv_id", "turn")
    packed = rows.filter("said <> ''").groupBy("conv_id", F.expr("turn div 1000").alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "said"))).alias("a"))
    packed = packed.unionByName(rows.groupBy("conv_id", F.expr("turn div 1000").alias("part")).agg(F.max(F.col("said") != "").alias("s")).filter("not s")
                                .select("conv_id", "part", F.array().cast(packed.schema["a"].dataType).alias("a")))

    def aligned(item, join, name, parts):
        return written(packed.withColumn("lines", F.array(F.array_join(F.transform("a", item), join))), name, parts, "conv_id", "part")

    said = aligned(lambda x: x["said"], " __eou__ ", "utterances", 3)
    felt = aligned(lambda x: ((F.col("conv_id") + x["turn"]) % 7).cast("string"), " ", "emotions", 2)
    acts = aligned(lambda x: F.lit("1"), " ", "acts", 1)
    out = adapters.read_priority_labels(spark, goe).unionByName(adapters.read_author_threads(spark, sarc)).unionByName(adapters.read_dialogues(spark, said, felt, acts))
    return _labelled(out)


@query(
    "erase_partitions",
    over_signals("""g as (select distinct user_id * 10 + 1 as conversation_id from events where user_id % 40 = 0),
b as (select conversation_id, conversation_id % 32 as bucket, conversation_id in (select conversation_id from g) as gone from signals)
select cast(bucket as integer) as bucket, count(*) filter (not gone) as messages, bool_or(gone) as rewritten from b group by 1 having count(*) filter (not gone) > 0"""),
)
def erase_partitions(spark, sf):
    """Erased in place: only buckets that held an erased conversation get new files."""
    rows = views.signals(spark, sf)
    key, path = F.col(CONV), work_dir(spark, "bucketed")
    tables.write_bucketed(rows.select(CONV, "message_id", "tension"), path, key, 32)
    gone = rows.filter(F.col("user_id") % 40 == 0).select((F.col("user_id") * 10 + 1).alias(CONV))

    def files():
        return spark.read.parquet(path).select("bucket", F.col("_metadata.file_path").alias("file")).distinct()

    before = settle(files(), "files")
    tables.erase_in_place(spark, path, gone, key, 32)
    same = files().join(before, ["bucket", "file"], "left_semi").groupBy("bucket").agg(F.lit(False).alias("rewritten"))
    left = spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("messages"))
    return left.join(same, "bucket", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(True)))
