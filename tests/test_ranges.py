"""Ranges of equal depth, the rank measures over them, and tails of test statistics."""

import math

import pytest
from pyspark.sql import functions as F

from talkframe.functions.stats import chi2_tail, kolmogorov_tail
from talkframe.operators import metrics
from talkframe.operators import sequence as seq


@pytest.fixture(scope="module")
def crowded(spark):
    """99 % of the scores lie in [0, 0.001]."""
    i = F.col("id")
    score = F.when(i % 100 == 0, i / 20000).otherwise(i / 2e7)
    return spark.range(20000).select(score.alias("s"), (F.xxhash64("id") % 3 == 0).alias("truth"), i.alias("t"))


def test_crowded_scores_are_dealt_evenly(crowded):
    for order in (["s"], ["t"]):
        n = [r["count"] for r in seq.ranged(crowded, order, "r", 16).groupBy("r").count().collect()]
        assert len(n) == 16 and max(n) < 2 * sum(n) / len(n)


def test_ranges_never_decrease(crowded):
    rows = seq.ranged(crowded, ["s"], "r", 8).orderBy("s").select("r").collect()
    assert [r["r"] for r in rows] == sorted(r["r"] for r in rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_rank_measures_of_crowded_scores(crowded, parts):
    rows = sorted((r["s"], r["truth"]) for r in crowded.collect())
    pos = sum(t for _, t in rows)
    ranks = sum(i + 1 for i, (_, t) in enumerate(rows) if t)  # all scores differ
    auc = (ranks - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))
    hit, area = 0, 0.0
    for k, (_, t) in enumerate(reversed(rows)):
        hit += t
        area += t * hit / (k + 1) / pos
    assert metrics.ranking_auc(crowded, F.col("truth"), F.col("s"), parts).first()["auc"] == pytest.approx(auc)
    assert metrics.average_precision(crowded, F.col("truth"), F.col("s"), parts).first()["ap"] == pytest.approx(area)


def test_rank_measures_without_rows_or_scores(spark):
    none = spark.createDataFrame([(None, True), (None, False)], "s double, truth boolean")
    assert metrics.ranking_auc(none, F.col("truth"), F.col("s")).first()["auc"] is None
    assert metrics.average_precision(none.limit(0), F.col("truth"), F.col("s")).first()["ap"] is None


def test_quantiles_by_depth(crowded, spark):
    got = seq.exact_quantiles(crowded, "s", {"a": 0.1, "b": 0.5, "c": 0.999}, keys=[]).first()
    v = sorted(r["s"] for r in crowded.collect())
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.999)):
        at = (len(v) - 1) * p
        low = v[int(at)]
        assert got[name] == pytest.approx(low + (v[math.ceil(at)] - low) * (at - int(at)))


@pytest.mark.parametrize("step", [1, 86_400_000_000])
def test_positions_of_sparse_ids(spark, step):
    """Ids like microseconds of days: numbered as dense ones are."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("conversation_id"), (F.col("id") * step).alias("message_id"))
    got = seq.with_positions(rows).orderBy("conversation_id", "message_id").collect()
    assert [r["pos"] for r in got] == [*range(600), *range(300)]
    dealt = seq.ranged(rows, ["conversation_id", "message_id"], "r", 6).groupBy("r").count().collect()
    assert max(r["count"] for r in dealt) < 2 * 900 / 6


#: Upper tails: closed forms for 1 and 2 degrees, finite sums for even ones.
def chi2(x, dof):
    if dof % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
    q = math.erfc(math.sqrt(x / 2))
    for i in range(1, dof, 2):
        q += math.exp((i / 2) * math.log(x / 2) - x / 2 - math.lgamma(i / 2 + 1)) if x else 0.0
    return q


def test_chi2_tail(spark):
    cases = [(x, d) for d in (1, 2, 3, 4, 7, 10, 25, 101) for x in (0.0, 0.1, 1.0, 3.84, 9.5, 30.0, 99.0, 140.0)]
    rows = spark.createDataFrame(cases, "x double, dof int").withColumn("p", chi2_tail(F.col("x"), F.col("dof")))
    for r in rows.collect():
        assert r["p"] == pytest.approx(chi2(r["x"], r["dof"]), rel=1e-9, abs=1e-13), r
    assert spark.range(1).select(chi2_tail(F.lit(1.0), F.lit(0)).alias("p")).first()["p"] is None


def test_kolmogorov_tail(spark):
    got = spark.createDataFrame([(z / math.sqrt(50.0),) for z in (0.0, 0.05, 0.8276, 1.3581, 1.6276, 9.0)], "d double")
    p = [r["p"] for r in got.select(kolmogorov_tail(F.col("d"), F.lit(100), F.lit(100)).alias("p")).collect()]
    assert p == pytest.approx([1.0, 1.0, 0.5, 0.05, 0.01, 0.0], abs=1e-4)
