"""Chat exports to one ``messages`` table: phone exports, clock-stamped text, speaker lines, JSON arrays, CSV.

A file is one value of its row; its lines are numbered block by block. A file no chat reader finds a message in is read as speaker
lines, so nothing is lost to a wrong guess. Output columns:
``conversation_id, message_id, speaker_id, ts, text, platform``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.text import speaker_name, strip_space
from talkframe.operators import sequence as seq
from talkframe.session import settle

FILE = "file_id"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
ELEMENT = (
    "struct<speaker:string,speaker_id:string,user:string,username:string,author:string,timestamp:string,ts:string,"
    "text:string,content:string,subtype:string>"
)
COLUMNS = ["conversation_id", "message_id", "speaker_id", "ts", "text", "platform"]


def read_exports(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file_id, raw) per file; bytes that are not UTF-8 are replaced. No file is left out unless ``max_bytes`` asks for it (the guard of an
    upload service is ``fixed.MAX_EXPORT_BYTES``; ``rejected_exports`` lists what it turns away)."""
    files = spark.read.format("binaryFile").load(path)
    files = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias(FILE), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))


def rejected_exports(spark: SparkSession, path: str, max_bytes: int = fixed.MAX_EXPORT_BYTES) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > max_bytes)
    return files.select(F.col("path").alias(FILE), F.col("length").alias("bytes"))


def lines(docs: DataFrame) -> DataFrame:
    return docs.select(FILE, F.posexplode(F.split("raw", LINE_BREAK)).alias("line_no", "line"))


def _merge_lines(parsed: DataFrame, keep: Column, head: list[str]) -> DataFrame:
    """Number the headers of each file and append the kept lines after each header to its text."""
    size = seq.block_rows(parsed)
    rows = parsed.withColumn("_bk", F.expr(f"line_no div {size}"))
    rows = seq.prefix(rows, {"message_id": ("sum", F.col("is_header").cast("long"))}, [FILE], ["line_no"], "_bk")
    rows = rows.filter((F.col("message_id") > 0) & (F.col("is_header") | keep))
    more = F.sort_array(F.collect_list(F.when(~F.col("is_header"), F.struct("line_no", strip_space(F.col("line")).alias("s")))))
    out = rows.groupBy(FILE, "message_id").agg(F.max(F.when(F.col("is_header"), F.struct(*head))).alias("h"), more.alias("m"))
    text = F.array_join(F.concat(F.array(F.col("h.said")), F.transform("m", lambda x: x["s"])), "\n")
    return out.select(F.col(FILE).alias("conversation_id"), "message_id", "h.*", text.alias("text")).drop("said")


def _part(pattern: str, i: int) -> Column:
    return F.regexp_extract("line", pattern, i)


def parse_phone(source: DataFrame) -> DataFrame:
    """Phone exports: 12 or 24 hour clock, day-first or month-first (decided per file), continuation lines."""
    p = fixed.PHONE_HEADER
    named = {"a": 1, "b": 2, "y": 3, "hh": 4, "mi": 5, "ss": 6}
    rows = source.withColumns(
        {
            "is_header": F.col("line").rlike(p),
            **{k: _part(p, i).try_cast("int") for k, i in named.items()},
            "half": F.upper(_part(p, 7)),
            "speaker_id": speaker_name(_part(p, 8)),
            "said": strip_space(_part(p, 9)),
        }
    )
    rows = rows.withColumn("_blk", F.expr(f"line_no div {seq.block_rows(source)}"))
    clear = F.col("is_header") & ((F.col("a") > 12) | (F.col("b") > 12))
    rows = seq.attach(rows, {"order": ("min", F.when(clear, F.struct("line_no", (F.col("a") > 12).alias("day_first"))))}, [FILE])
    day_first = F.coalesce(F.col("order.day_first"), F.lit(True))
    hour = F.when(F.col("half") == "", F.col("hh")).otherwise(F.col("hh") % 12 + F.when(F.col("half") == "P", 12).otherwise(0))
    rows = rows.withColumns(
        {
            "year": F.when(F.col("y") < 100, F.col("y") + 2000).otherwise(F.col("y")),
            "month": F.when(day_first, F.col("b")).otherwise(F.col("a")),
            "day": F.when(day_first, F.col("a")).otherwise(F.col("b")),
            "hour": hour,
            "second": F.coalesce("ss", F.lit(0)).cast("double"),
        }
    ).withColumn("ts", F.expr("try_make_timestamp_ntz(year, month, day, hour, mi, second)"))
    system = F.lit(False)
    for marker in fixed.SYSTEM_MARKERS:
        system = system | F.col("line").contains(marker)
    keep = (strip_space(F.col("line")) != "") & ~system
    rows = rows.select(FILE, "line_no", "line", "is_header", "speaker_id", "ts", "said")
    out = _merge_lines(rows, keep, ["speaker_id", "ts", "said"])
    return out.withColumn("platform", F.lit("whatsapp")).withColumn("ts", F.col("ts").cast("string")).select(*COLUMNS)


def parse_clock(source: DataFrame) -> DataFrame:
    """``[hh:mm] Author: text`` lines with continuation lines; the time stays text."""
    p = fixed.CLOCK_HEADER
    rows = source.withColumns(
        {"is_header": F.col("line").rlike(p), "ts": _part(p, 1), "speaker_id": speaker_name(_part(p, 2)), "said": strip_space(_part(p, 3))}
    )
    out = _merge_lines(rows, strip_space(F.col("line")) != "", ["speaker_id", "ts", "said"])
    return out.withColumn("platform", F.lit("discord")).select(*COLUMNS)


def parse_speaker_lines(source: DataFrame, platform: str = "generic") -> DataFrame:
    """One message per non-blank line; ``Speaker: text`` unless the speaker part is long or looks like a link."""
    rows = source.withColumn("line", strip_space(F.col("line"))).filter("line != ''")
    p = fixed.SPEAKER_LINE
    named = F.col("line").rlike(p) & ~_part(p, 1).rlike("^(https?|www)")
    rows = seq.number(rows, [FILE], ["line_no"], F.expr(f"line_no div {seq.block_rows(source)}"))
    return rows.select(
        F.col(FILE).alias("conversation_id"),
        (F.col("pos") + 1).alias("message_id"),
        F.when(named, speaker_name(_part(p, 1))).otherwise("user").alias("speaker_id"),
        F.lit(None).cast("string").alias("ts"),
        F.when(named, strip_space(_part(p, 2))).otherwise(F.col("line")).alias("text"),
        F.lit(platform).alias("platform"),
    )


def elements(raw: Column) -> Column:
    """The message array of a JSON export: a top-level array, or the ``messages`` array of an object."""
    listed = F.from_json(raw, f"array<{ELEMENT}>")
    wrapped = F.from_json(raw, f"struct<messages:array<{ELEMENT}>>")["messages"]
    return F.when(F.ltrim(raw).startswith("["), listed).otherwise(wrapped)


def _exploded(docs: DataFrame, items: Column) -> DataFrame:
    return docs.select(F.col(FILE).alias("conversation_id"), F.posexplode(items).alias("at", "m")).withColumn(
        "message_id", (F.col("at") + 1).cast("long")
    )


def parse_json(docs: DataFrame) -> DataFrame:
    rows = _exploded(docs, elements(F.col("raw")))
    speaker = F.coalesce(F.nullif("m.speaker", F.lit("")), F.nullif("m.speaker_id", F.lit("")), F.lit("user"))
    return rows.select(
        "conversation_id", "message_id", speaker.alias("speaker_id"), F.col("m.timestamp").alias("ts"),
        F.coalesce("m.text", F.lit("")).alias("text"), F.lit("json").alias("platform"),
    )


def parse_author_json(docs: DataFrame) -> DataFrame:
    rows = _exploded(docs, elements(F.col("raw")))
    author = F.coalesce(F.when(F.col("m.author").startswith("{"), F.get_json_object("m.author", "$.username")), F.col("m.author"))
    return rows.select(
        "conversation_id", "message_id", speaker_name(author).alias("speaker_id"), F.col("m.timestamp").alias("ts"),
        strip_space(F.coalesce("m.content", F.lit(""))).alias("text"), F.lit("discord").alias("platform"),
    )


def epoch_messages(items: Column) -> Column:
    return F.filter(items, lambda m: F.coalesce(m["subtype"], F.lit("")).eqNullSafe("") & (strip_space(F.coalesce(m["text"], F.lit(""))) != ""))


def parse_epoch_json(docs: DataFrame) -> DataFrame:
    """JSON arrays with ``user`` and epoch ``ts``; rows with a subtype or no text are dropped before numbering."""
    rows = _exploded(docs, epoch_messages(elements(F.col("raw"))))
    stamp = F.timestamp_seconds(F.col("m.ts").try_cast("double"))
    return rows.select(
        "conversation_id", "message_id", speaker_name(F.coalesce("m.user", "m.username", F.lit("unknown"))).alias("speaker_id"),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("ts"), strip_space(F.col("m.text")).alias("text"), F.lit("slack").alias("platform"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports, each with its own header."""
    return parse_csv_text(read_exports(spark, path))


def detect_platform(docs: DataFrame, platform: str | None = None, sniff: bool = True, head_lines: int = 5) -> DataFrame:
    """Add ``platform``: the reader for each file, as declared or judged by its first ``head_lines`` lines and characters.

    ``sniff`` looks for CSV and plain JSON first, as an upload does; without it only the chat formats are told apart. A slack or
    discord file, declared or guessed, must hold a message of that kind; otherwise the next format is tried, ``generic`` last.
    """
    raw = F.col("raw")
    start = F.regexp_replace(raw, f"^{fixed.SPACE}+", "")
    every = F.split(raw, LINE_BREAK)
    items = elements(raw)
    first = F.get(items, F.lit(0))
    array = start.startswith("[")
    told = F.coalesce(F.exists(epoch_messages(items), lambda m: F.lit(True)), F.lit(False)) & array
    clock = F.exists(every, lambda x: x.rlike(fixed.CLOCK_HEADER))
    discord = F.when(first["author"].isNotNull(), "discord-json").when(clock, "discord").otherwise("generic")
    if platform is not None:
        kind = {"discord": discord, "slack": F.when(told, "slack").otherwise("generic")}.get(platform, F.lit(platform))
        return docs.withColumn("platform", kind)
    chat = (
        F.when(F.exists(F.slice(every, 1, head_lines), lambda x: x.rlike(fixed.PHONE_HEADER)), "whatsapp")
        .when(told & (raw.contains('"user"') | raw.contains('"text"')), "slack")
        .when(raw.rlike(r"(?m)^\[?[0-9]{1,2}:[0-9]{2}"), discord)
        .otherwise("generic")
    )
    if sniff:
        table = start.startswith("speaker,") | start.startswith("timestamp,")
        listed = (array | start.startswith("{")) & first["text"].isNotNull()
        chat = F.when(table, "csv").when(listed, "json").otherwise(chat)
    return docs.withColumn("platform", chat)


#: A quote opens a field only where the field starts; inside, two stand for one; text after the closing one is plain up to the comma.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_ENDS_OPEN = rf'\A(?:(?:{_QUOTED}"(?:[^",][^,]*+)?+|[^",][^,]*+|),)*+{_QUOTED}\z'
_CELL = rf',(?:{_QUOTED}(?:"[^,]*+)?+|[^,]*+)'
_CELL_PARTS = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?(.*)\z'


def open_before(rows: DataFrame, ends_open: Column, ends_open_if_open: Column) -> DataFrame:
    """Adds ``_open``: whether a quoted field is open where each line (file_id, line_no, _b) starts.

    A line maps the state before it to the state after it: it sets, clears, keeps or turns it. Such maps are composed over all earlier
    lines as the last line that sets or clears and the number of turns since then, both running values carried from block to block.
    """
    size = seq.block_rows(rows)
    fixed_to = F.when(ends_open == ends_open_if_open, ends_open)
    rows = rows.withColumns({"_b": F.expr(f"line_no div {size}"), "_fixed": fixed_to, "_turn": (ends_open & ~ends_open_if_open).cast("long")})
    rows = seq.prefix(rows, {"_turns": ("sum", F.col("_turn"))}, [FILE], ["line_no"], "_b")
    last = F.when(F.col("_fixed").isNotNull(), F.struct("line_no", F.col("_fixed").alias("open"), F.col("_turns").alias("turns")))
    rows = seq.prefix(rows, {"_last": ("max", last)}, [FILE], ["line_no"], "_b", inclusive=False)
    turned = (F.col("_turns") - F.col("_turn") - F.coalesce("_last.turns", F.lit(0))) % 2 == 1
    return rows.withColumn("_open", F.coalesce("_last.open", F.lit(False)) != turned).drop("_fixed", "_turn", "_turns", "_last")


def cells_of(record: Column) -> Column:
    """The fields of one CSV record."""
    def value(cell: Column) -> Column:
        body = F.substring(cell, 2, 1 << 30)
        inside = F.replace(F.regexp_extract(body, _CELL_PARTS, 1), F.lit('""'), F.lit('"'))
        return F.when(body.startswith('"'), F.concat(inside, F.regexp_extract(body, _CELL_PARTS, 2))).otherwise(body)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(0)), value)


def parse_csv_text(docs: DataFrame) -> DataFrame:
    """CSV exports held as text, as the usual reader of such files takes them: a quote inside an unquoted field is a plain character, a
    quoted field may hold commas, doubled quotes and line breaks, empty lines are skipped. Columns are found by each file's own header, in
    any order and number; of a repeated name the last column counts, missing cells are empty.
    """
    rows = docs.select(FILE, F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))
    rows = open_before(rows, F.col("line").rlike(_ENDS_OPEN), F.concat(F.lit('"'), "line").rlike(_ENDS_OPEN))
    rows = rows.filter(F.col("_open") | ~F.col("line").isin("", "\r"))
    rows = seq.prefix(rows, {"_at": ("sum", (~F.col("_open")).cast("long"))}, [FILE], ["line_no"], "_b")
    record = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    records = rows.groupBy(FILE, "_at").agg(record.alias("record"))
    records = records.select(FILE, "_at", cells_of(F.regexp_replace("record", r"\r\z", "")).alias("cells"), F.expr(f"_at div {seq.block_rows(docs)}").alias("_blk"))

    def place(name: str) -> Column:
        return F.when(F.array_contains("cells", name), F.size("cells") - F.array_position(F.reverse("cells"), name)).cast("int").alias(name)

    names = ("speaker", "speaker_id", "timestamp", "text")
    records = seq.attach(records, {"head": ("min", F.when(F.col("_at") == 1, F.struct(*map(place, names))))}, [FILE]).filter("_at > 1")
    cell = {n: F.get("cells", F.col(f"head.{n}")) for n in names}
    return records.select(
        F.col(FILE).alias("conversation_id"), (F.col("_at") - 1).alias("message_id"),
        F.coalesce(F.nullif(cell["speaker"], F.lit("")), F.nullif(cell["speaker_id"], F.lit("")), F.lit("user")).alias("speaker_id"),
        cell["timestamp"].alias("ts"), F.coalesce(cell["text"], F.lit("")).alias("text"), F.lit("csv").alias("platform"),
    )


def ingest(docs: DataFrame, platform: str | None = None, sniff: bool = True) -> DataFrame:
    """Every export through the reader that fits it, as one table. Files are judged once and settled with their reader's name."""
    seen = settle(detect_platform(docs, platform, sniff).select(FILE, "raw", "platform"), "exports")

    def of(kind: str) -> DataFrame:
        return seen.filter(F.col("platform") == kind).select(FILE, "raw")

    out = parse_speaker_lines(lines(of("generic")))
    for part in (
        parse_csv_text(of("csv")), parse_json(of("json")), parse_phone(lines(of("whatsapp"))), parse_epoch_json(of("slack")),
        parse_author_json(of("discord-json")), parse_clock(lines(of("discord"))),
    ):
        out = out.unionByName(part)
    return out
