"""Sweeps go on until every conversation is settled, however long; and no further than that for the settled ones."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkframe.functions.text import BEHAVIOUR
from talkframe.operators import context, learn

CONV = "conversation_id"


def test_sweeps_settle_a_conversation_of_more_than_fifty_messages(spark, monkeypatch):
    """Each message is one more than the one before it, so every sweep settles one message: 52 messages take 53 sweeps."""
    seen = []

    def apply(rows, model, with_confidence):
        seen.append({r[CONV] for r in rows.select(CONV).distinct().collect()})
        before = F.lag("tension").over(Window.partitionBy(CONV).orderBy("pos"))
        return rows.withColumn("tension_hat", F.coalesce(before + 1, F.lit(10.0)))

    def same(rows, *_):
        return rows

    for module, name in ((learn, "design"), (learn, "assemble"), (context, "memory_vector"), (context, "speaker_memory")):
        monkeypatch.setattr(module, name, same)
    monkeypatch.setattr(learn, "apply", apply)
    rows = spark.range(52).select(F.lit(1).alias(CONV), F.col("id").alias("pos")).unionByName(spark.range(3).select(F.lit(2).alias(CONV), F.col("id").alias("pos")))
    rows = rows.select("*", (F.col("pos") + 1).alias("message_id"), F.lit("A").alias("speaker_id"), F.lit("x").alias("text"), *[F.lit(0).alias(c) for c in BEHAVIOUR])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = learn.predict_by_sweeps(rows.coalesce(1), learn.Model([], learn.Terms(), {})).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sorted((r[CONV], r["message_id"], r["tension"]) for r in got) == [(1, m, 9.0 + m) for m in range(1, 53)] + [(2, m, 9.0 + m) for m in range(1, 4)]
    assert seen[:4] == [{1, 2}] * 4 and seen[4:] == [{1}] * 49


def test_terms_weigh_as_counted(spark):
    """Known terms only, 1 + ln(count) times idf, unit length; a text without any is empty."""
    rows = spark.createDataFrame([(0, "bb aa bb xx"), (1, "xx"), (2, None)], "id long, text string")
    out = {r["id"]: r["v"] for r in learn.Terms(["aa", "bb", "aa bb"], [1.0, 2.0, 3.0]).weigh(rows, "text", "v").collect()}
    raw = [1.0, (1 + 0.6931471805599453) * 2, 3.0]
    size = sum(x * x for x in raw) ** 0.5
    assert all(abs(a - b / size) < 1e-12 for a, b in zip(out[0].toArray(), raw))
    assert out[1].numNonzeros() == out[2].numNonzeros() == 0 and out[1].size == 3
