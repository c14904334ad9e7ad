"""The speaker state of a stream in several bounded micro-batches."""

import random

from compare import compare

import __spark_entry__ as entry
from talkframe.streaming import live


def drained(spark, monkeypatch, run):
    """The result of ``run`` and the row counts of its micro-batches."""
    seen, drain = [], live.run_available

    def watched(result, name):
        out = drain(result, name)
        seen.extend(p["numInputRows"] for p in out[1] if p["numInputRows"])
        return out

    monkeypatch.setattr(live, "run_available", watched)
    return run(), seen


def test_query_carries_state_across_batches(spark, sf_dir, duck, monkeypatch):
    out, seen = drained(spark, monkeypatch, lambda: entry.queries()["stream_memory"](spark, sf_dir))
    assert compare(out, duck, entry.oracle_sql()["stream_memory"]) is None
    assert len(seen) >= 4


def test_a_long_speaker_is_never_gathered(spark, monkeypatch):
    """One speaker has two thirds of all rows; every batch stays near its bound and the state is that of the whole order."""
    rows = [("c", i, "a" if i % 3 else "b", f"e{i % 4}", f"t{i % 5}", f"s{i % 2}", float(i % 7), int(i % 6 > 0)) for i in range(400)]
    random.Random(3).shuffle(rows)
    table = spark.createDataFrame(rows, "conversation_id string, message_id long, speaker_id string, emotion string, tone string, sentiment string, "
                                        "tension double, is_short int")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    try:
        out, seen = drained(spark, monkeypatch, lambda: live.run_available(live.speaker_memory(live.in_order(table, batch_rows=80)), "memory")[0])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(seen) == 5 and max(seen) <= 160 and sum(seen) == 400
    state, want = {}, {}
    for _, i, who, emotion, tone, sentiment, tension, short in sorted(rows, key=lambda r: r[1]):
        last, tensions, streak = state.get(who, ((None, None, None), [], 0))
        want[i] = (*last, sum(tensions) / len(tensions) if tensions else None, streak)
        state[who] = ((emotion, tone, sentiment), [*tensions, tension][-5:], streak + 1 if short else 0)
    assert {r["message_id"]: tuple(r)[3:] for r in out.collect()} == want
