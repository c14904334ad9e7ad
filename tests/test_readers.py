"""Line numbers over several files and splits, aligned files, label corpora."""

import json

import pytest

from talkframe.sources import adapters, tables


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path, small_splits):
    want = []
    for name, n in (("a", 100), ("b", 0), ("c", 37)):
        lines = [f"{name} line {i} " + "x" * (i % 17) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    got = tables.read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert [(r["line_no"], r["line"]) for r in got.orderBy("line_no").collect()] == list(enumerate(want))


def test_blank_lines_count_and_bad_lines_raise(spark, tmp_path):
    rows = [{"text": "hi", "labels": [17]}, None, {"text": " "}, {"text": "no labels"}]
    (tmp_path / "g.jsonl").write_text("".join("\n" if r is None else json.dumps(r) + "\n" for r in rows))
    got = adapters.read_priority_labels(spark, str(tmp_path / "g.jsonl")).orderBy("conversation_id").collect()
    assert [(r["conversation_id"], r["text"]) for r in got] == [("goe_0", "hi"), ("goe_3", "no labels")]
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\n{"text": oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        adapters.read_priority_labels(spark, str(tmp_path / "bad.jsonl")).collect()


def test_aligned_files_of_different_splits(spark, tmp_path, small_splits):
    (tmp_path / "u.txt").write_text("".join(f"hello {i} __eou__ you {i} __eou__\n" for i in range(50)))
    (tmp_path / "e.txt").write_text("".join(f"{i % 7} {(i + 1) % 7} 3\n" for i in range(48)))  # two lines short
    got = adapters.read_dialogues(spark, str(tmp_path / "u.txt"), str(tmp_path / "e.txt"))
    rows = {(r["conversation_id"], r["message_id"]): (r["speaker_id"], r["text"], r["emotion"]) for r in got.collect()}
    assert len(rows) == 96 and rows["dd_d47", 2] == ("B", "you 47", "sadness" if 48 % 7 == 5 else rows["dd_d47", 2][2])
    names = ["neutral", "anger", "disgust", "fear", "joy", "sadness", "surprise"]
    assert all(rows[f"dd_d{i}", k + 1] == ("AB"[k], f"{'hello' if k == 0 else 'you'} {i}", names[(i + k) % 7]) for i in range(48) for k in (0, 1))


def test_json_document_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b\n")], "id int, text string")
    path = tables.write_json(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_json(spark, path, rows.schema).collect())) == [(1, "a"), (2, "b\n")]
