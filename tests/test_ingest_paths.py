"""Exports lose no message: fall-through of wrong guesses, CSV as CSV, malformed JSON lines, and the scored chain."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from talkframe.operators import learn, metrics
from talkframe.plans import analyze
from talkframe.queries.learning import history_model
from talkframe.sources import exports, tables


def files(spark, **docs):
    return spark.createDataFrame(list(docs.items()), "file_id string, raw string")


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("conversation_id", "message_id").select("conversation_id", *cols).collect()]


def test_misleading_clock_line_keeps_every_line(spark):
    got = exports.ingest(files(spark, a="Notes of today\n10:30 meeting moved\nAnn: ok then"))
    assert rows(got, "speaker_id", "text") == [("a", "user", "Notes of today"), ("a", "user", "10:30 meeting moved"), ("a", "Ann", "ok then")]


@pytest.mark.parametrize("platform", ["slack", "discord"])
def test_declared_platform_falls_back_to_speaker_lines(spark, platform):
    got = exports.ingest(files(spark, a="Ann: hello\nBob: hi"), platform=platform)
    assert rows(got, "speaker_id", "text") == [("a", "Ann", "hello"), ("a", "Bob", "hi")]


def test_csv_headers_of_any_width_and_order_and_quoted_breaks(spark):
    docs = files(
        spark,
        a='speaker,mood,timestamp,room,text\nann,sad,2024-01-01,r1,"line one\nline two"\nbob,ok,2024-01-02,r2,"say ""hi"", now"\n',
        b="timestamp,text,speaker\n2024-02-02,hello,bob\n",
    )
    got = exports.ingest(docs)
    assert rows(got, "message_id", "speaker_id", "ts", "text", "platform") == [
        ("a", 1, "ann", "2024-01-01", "line one\nline two", "csv"), ("a", 2, "bob", "2024-01-02", 'say "hi", now', "csv"),
        ("b", 1, "bob", "2024-02-02", "hello", "csv"),
    ]


def test_csv_records_across_blocks(spark):
    spark.conf.set("talkframe.blockRows", "2")
    try:
        body = "".join(f'p{i},"a{i}\nb{i}"\n' for i in range(7))
        got = exports.parse_csv_text(files(spark, a="speaker,text\n" + body))
        assert rows(got, "message_id", "speaker_id", "text") == [("a", i + 1, f"p{i}", f"a{i}\nb{i}") for i in range(7)]
    finally:
        spark.conf.unset("talkframe.blockRows")


def test_stray_quotes_swallow_nothing(spark):
    got = exports.parse_csv_text(files(spark, a='speaker,text\nAnn,a 5" screen\nBob,hi\n\nCy,"yo" there, x\nDi,"open\nto the end\n'))
    assert rows(got, "speaker_id", "text") == [("a", "Ann", 'a 5" screen'), ("a", "Bob", "hi"), ("a", "Cy", "yo there"), ("a", "Di", "open\nto the end\n")]


def test_repeated_header_names(spark):
    got = exports.parse_csv_text(files(spark, a="speaker,text,text\nAnn,one,two\nBob,three\n"))
    assert rows(got, "speaker_id", "text") == [("a", "Ann", "two"), ("a", "Bob", "")]


def test_csv_is_read_as_by_the_standard_reader(spark):
    """Random quotes, breaks, commas and headers, with blocks of three lines."""
    rng = random.Random(5)
    docs, want = {}, []
    for i in range(60):
        names = rng.sample(["speaker", "speaker_id", "timestamp", "text", "mood", "text"], rng.randint(2, 6))
        lines = ["".join(rng.choice(['"', '""', ",", "a", "b", " ", "\n", ',"', '",', "é"]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        raw = "x,speaker,".join(["", ",".join(names)]) + "\n" + "\n".join(lines)
        docs[f"f{i:02d}"] = raw
        for n, r in enumerate(csv.DictReader(io.StringIO(raw))):
            want.append((f"f{i:02d}", n + 1, r.get("speaker") or r.get("speaker_id") or "user", r.get("timestamp"), r.get("text") or ""))
    spark.conf.set("talkframe.blockRows", "3")
    try:
        got = exports.parse_csv_text(files(spark, **docs))
        assert rows(got, "message_id", "speaker_id", "ts", "text") == want
    finally:
        spark.conf.unset("talkframe.blockRows")


def test_no_file_is_too_large_unless_asked(spark, tmp_path):
    (tmp_path / "big.txt").write_text("Ann: " + "x" * 100)
    assert exports.read_exports(spark, str(tmp_path)).count() == 1
    assert exports.read_exports(spark, str(tmp_path), max_bytes=10).count() == 0
    assert exports.rejected_exports(spark, str(tmp_path), max_bytes=10).count() == 1


def test_malformed_json_line_raises(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n  \n{"x": oops\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.read_jsonl(spark, str(tmp_path), "x int").collect()


def test_polarity_needs_both_probabilities(spark):
    """A neutral winner can still be praise: positive .40 against negative .15."""
    head = learn.Head("labels", ["negative", "neutral", "positive"], [[0.0] * 26] * 3, [float(x) for x in F_LOG])
    model = learn.Model(["behaviour", "memory"], learn.Terms(), {"sentiment": head})
    df = spark.createDataFrame([("a", 1, 0, "ann", "fine")], "conversation_id string, message_id long, pos long, speaker_id string, text string")
    r = analyze.score(df.withColumn("ts", F.lit(None).cast("timestamp_ntz")), model).first()
    assert r["sentiment"] == "neutral"
    assert (r["p_positive"], r["p_negative"]) == pytest.approx((0.40, 0.15))
    assert [x["label"] for x in r["sentiment_top3"]] == ["neutral", "positive", "negative"]


F_LOG = [-1.8971199848858813, -0.7985076962177716, -0.916290731874155]  # logs of .15, .45, .40


def test_exports_to_report(spark, tmp_path):
    """Files to every report table, one row per message throughout."""
    (tmp_path / "chat.txt").write_text("Ann: late again!!\nBob: sorry...\nAnn: fine\nBob: ok\nAnn: thanks\n")
    messages = exports.ingest(exports.read_exports(spark, str(tmp_path))).withColumn("ts", F.col("ts").try_cast("timestamp_ntz"))
    scored = analyze.score(messages, history_model())
    report = analyze.analyze(scored.withColumns({c: F.lit("neutral") for c in ("emotion", "tone")}))
    assert report["messages"].count() == 5
    assert report["conversation"].first()["speakers"] == ["Ann", "Bob"]
    assert report["summary"].first()["top_emotions"][0]["n"] == 5
    assert report["digest"].count() == 1
    assert {"speaker_labels", "timeline", "explanations"} <= set(report)


def test_label_margins_separate_classes(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [([float(x), float(y)], "right" if x > 2 else "up" if y > 2 else "none") for x in (0, 1, 4, 5) for y in (0, 1, 4, 5) if x < 3 or y < 3]
    df = spark.createDataFrame(rows, "f array<double>, label string").select(array_to_vector("f").alias("features"), "label")
    df = df.coalesce(1)
    head = learn.fit_label_margins(df, "label", max_iter=8)
    got = learn.apply(df, learn.Model([], learn.Terms(), {"label": head})).select("label", "label_hat").collect()
    assert sum(r["label"] == r["label_hat"] for r in got) >= len(rows) - 2
