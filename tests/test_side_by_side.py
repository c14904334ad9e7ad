"""Independent fits over few rows share the cluster, and give what they give one after the other."""

import threading

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from talkframe import session
from talkframe.operators import learn


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(240).repartition(2, "id").select(
        "id", array_to_vector(F.array((i % 7).cast("double"), (i % 3).cast("double"))).alias("features"), ((i % 7 > 3) != (i % 11 == 0)).cast("int").alias("y")
    ).cache()


@pytest.mark.parametrize("svc", [False, True])
def test_folds_meet_and_keep_their_order(rows, monkeypatch, svc):
    meet, platt = threading.Barrier(3, timeout=120), learn._platt

    def waiting(scored):
        meet.wait()  # breaks when a fold has to wait for another one to end
        return platt(scored)

    monkeypatch.setattr(learn, "_platt", waiting)
    together = learn.fit_binary(rows, "y", F.col("id"), svc=svc)
    monkeypatch.setattr(learn, "_platt", platt)
    monkeypatch.setattr(learn, "side_by_side", lambda _, steps: [step() for step in steps])
    alone = learn.fit_binary(rows, "y", F.col("id"), svc=svc)
    for a, b in ((together.coef, alone.coef), (together.curve, alone.curve)):
        assert [x for v in a for x in v] == pytest.approx([x for v in b for x in v], rel=1e-6, abs=1e-9)
    assert together.bias == pytest.approx(alone.bias, rel=1e-6, abs=1e-9)


def test_rows_in_many_parts_are_fitted_one_at_a_time(spark):
    names = session.side_by_side(spark.range(64).repartition(64), [lambda: threading.current_thread().name] * 3)
    assert names == [threading.current_thread().name] * 3


def test_few_rows_are_fitted_in_one_part(spark, monkeypatch):
    """A fit's steps are jobs over all parts: small training rows are gathered, whole, and many rows keep their parts."""
    i = F.col("id")
    train = spark.range(240).repartition(6, "id").select(array_to_vector(F.array((i % 7).cast("double"))).alias("text_block"), (i % 5).cast("double").alias("tension"))
    met = []
    monkeypatch.setattr(learn, "fit_tension", lambda rows: met.append((rows.rdd.getNumPartitions(), rows.count())))
    learn.fit(train, learn.Terms(), "A", ("tension",))
    assert met == [(1, 240)]
    assert session.gathered(train, 50).rdd.getNumPartitions() == 5
    assert session.gathered(train, 10).rdd.getNumPartitions() == 6
    assert session.gathered(train.limit(0)).count() == 0
