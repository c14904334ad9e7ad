"""Many short conversations share a call of the state processors."""

import pandas as pd

from talkframe.functions import text
from talkframe.queries.learning import history_model
from talkframe.streaming import live


class Map(dict):
    def __init__(self):
        super().__init__()
        self.calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)


class Handle(dict):
    def getMapState(self, name, *_):
        return self.setdefault(name, Map())


def test_speakers_of_a_bucket_are_read_and_written_once():
    handle, state = Handle(), live.SpeakerState("conversation_id long, speaker_id string")
    state.init(handle)
    rows = [(c, m, "ab"[m % 2], f"e{m}", "t", "s", float(m), 1) for m in (3, 1, 0, 2) for c in range(50)]
    columns = ["conversation_id", "message_id", "speaker_id", "emotion", "tone", "sentiment", "tension", "is_short"]
    pieces = [pd.DataFrame(rows[:90], columns=columns), pd.DataFrame(rows[90:], columns=columns)]
    out = pd.concat(state.handleInputRows((7,), iter(pieces), None))
    assert len(out) == 200 and handle["speakers"].calls == 2 * 100
    got = {(r.conversation_id, r.message_id): (r.last_emotion, r.recent_tension, r.short_streak) for r in out.itertuples()}
    assert all(got[c, m][2] == m // 2 for c in range(50) for m in range(4))
    assert all(got[c, m][:2] == (f"e{m - 2}", m - 2.0) for c in range(50) for m in (2, 3))


def test_null_ids_leave_whole_numbers_whole(spark, tmp_path):
    big = 2**53 + 1
    rows = [(big, 1, "a"), (big, 2, None), (None, 3, "a"), (None, 4, "a"), (None, 5, None)]
    table = spark.createDataFrame([(*r, "e", "t", "s", float(r[1]), 1) for r in rows], "conversation_id long, message_id long, speaker_id string, "
                                  "emotion string, tone string, sentiment string, tension double, is_short int")
    table.write.parquet(str(tmp_path / "in"))
    with live.rocksdb(spark):
        out, _ = live.run_available(live.speaker_memory(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))), "nulls")
    got = sorted((r["message_id"], r["conversation_id"], r["speaker_id"], r["short_streak"]) for r in out.collect())
    assert got == [(1, big, "a", 0), (2, big, None, 0), (3, None, "a", 0), (4, None, "a", 1), (5, None, None, 0)]


def test_waiting_messages_are_stored_together():
    handle, scorer = Handle(), live.ConversationScorer(history_model(), "conversation_id long")
    scorer.init(handle)
    behave = [0.0] * len(text.BEHAVIOUR)
    rows = [(c, p, p + 1, "ab"[p % 2], p * 60_000_000, ["word"], behave) for p in range(32) for c in range(20)]
    columns = ["conversation_id", "pos", "message_id", "speaker_id", "clock", "tokens", "behave"]

    def arrive(*parts):
        return pd.concat(scorer.handleInputRows((7,), iter([pd.DataFrame(p, columns=columns) for p in parts]), None))

    late, early = [r for r in rows if r[1] % 2], [r for r in rows if r[1] % 2 == 0]
    assert len(arrive(late)) == 0 and handle["waiting"].calls == 2 * 20  # positions 1 to 31 of each conversation, in two parts
    mixed = pd.concat([arrive(early[:100], early[100:]), arrive(late)])
    assert not handle["waiting"] and len(mixed) == len(rows)
    handle.clear()
    scorer.init(handle)
    straight = arrive(rows)
    key = ["conversation_id", "message_id"]
    assert mixed.sort_values(key).to_dict("records") == straight.sort_values(key).to_dict("records")
