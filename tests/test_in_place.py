"""Erasing in place, exact ridge, pooled vectors, live scoring over several arrivals."""

import os

import numpy as np
import pytest
from compare import compare
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from talkframe.operators import context, learn
from talkframe.queries import live as queries
from talkframe.sources import tables


def stored(spark, path):
    return sorted((r["conversation_id"], r["message_id"]) for r in spark.read.parquet(path).collect())


def test_erase_keeps_other_files_and_removes_empty_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(c, m) for c in (1, 2, 5, 6, 9) for m in range(3)], "conversation_id long, message_id long")
    tables.write_bucketed(rows, path, F.col("conversation_id"), 4)
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    gone = spark.createDataFrame([(2,), (5,), (6,), (7,)], "conversation_id long")  # bucket 2 whole, bucket 1 in part, 7 unknown
    assert tables.erase_in_place(spark, path, gone, F.col("conversation_id"), 4) == [1, 2]
    assert stored(spark, path) == [(c, m) for c in (1, 9) for m in range(3)]
    assert not os.path.exists(f"{path}/bucket=2")
    assert sorted(os.listdir(f"{path}/bucket=1")) != before["bucket=1"]
    assert tables.erase_in_place(spark, path, gone, F.col("conversation_id"), 4) == []
    tables.purge(spark, path)
    assert spark.read.parquet(path).columns == ["conversation_id", "message_id", "bucket"] and stored(spark, path) == []


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [1, 10, 0.1] + 5
    y = x @ [2.0, -1.0, 3.0] + 7 + rng.normal(size=60)
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "f array<double>, tension double").repartition(4)
    head = learn.fit_ridge(df.select(array_to_vector("f").alias("features"), "tension"), alpha=2.0)
    c = x - x.mean(axis=0)
    w = np.linalg.solve(c.T @ c + 2 * np.eye(3), c.T @ (y - y.mean()))
    assert head.coef[0] == pytest.approx(w.tolist()) and head.bias[0] == pytest.approx(y.mean() - w @ x.mean(axis=0))


def test_pooled_vectors_cross_blocks(spark):
    rows = spark.createDataFrame([("c", i, i, [float(i), 1.0]) for i in range(20)], "conversation_id string, message_id long, pos long, embedding array<double>")
    spark.conf.set("talkframe.blockRows", "3")
    try:
        got = {r["pos"]: r["context_vector"] for r in context.pooled(rows, k=4).collect()}
    finally:
        spark.conf.unset("talkframe.blockRows")
    assert got[0] == [0.0, 0.0]
    assert all(got[i] == pytest.approx([np.mean(range(max(0, i - 4), i)), 1.0]) for i in range(1, 20))


@pytest.mark.parametrize("files", [1, 7])
def test_live_scores_do_not_depend_on_arrival(spark, sf_dir, duck, files):
    assert compare(queries.stream_score(spark, sf_dir, files), duck, entry.oracle_sql()["stream_score"]) is None
