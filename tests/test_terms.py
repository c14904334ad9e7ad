"""Terms of a text: words and neighbours, split once."""

from pyspark.sql import functions as F

from talkframe.operators import vectors


def test_a_text_is_split_once(spark):
    out = spark.createDataFrame([("a b",)], "text string").select(vectors.terms(F.col("text")).alias("t"))
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_words_then_neighbours(spark):
    texts = ["Go to  the SHOP now", "word", "a b", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r["t"] for r in rows.select("id", vectors.terms(F.col("text")).alias("t")).orderBy("id").collect()]
    assert got == [["go", "to", "the", "shop", "now", "go to", "to the", "the shop", "shop now"], ["word"], [], [], None]
    counted = {(r["id"], r["term"]) for r in vectors.term_counts(rows, "id").collect()}
    assert counted == {(i, t) for i, ts in enumerate(got) for t in ts or []}
