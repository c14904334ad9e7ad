"""Values that tie in exact arithmetic fall the same way as in SQL, whatever the last bit of a float."""

import duckdb

from talkframe.operators import sequence as seq
from talkframe.operators import temporal
from talkframe.queries.ordered import TRAJECTORY_SQL, TURNING_SQL

CONV = "conversation_id"


def series(spark, tensions):
    rows = [(c, i, i + 1, "AB"[i % 2], "text", "joy", "casual", "neutral", x) for c, xs in tensions.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(
        rows, f"{CONV} long, pos long, message_id long, speaker_id string, text string, emotion string, tone string, sentiment string, tension double")


def test_median_has_the_bits_of_sql(spark):
    pairs = [(k, x) for k in range(400) for x in ((k * 7919 % 10007) / 100 - 50.01, (k * 104729 % 9973) / 100 - 49.97)]
    got = seq.exact_quantiles(spark.createDataFrame(pairs, f"{CONV} long, v double"), "v", {"med": 0.5}, width=0.01).collect()
    con = duckdb.connect()
    con.execute("create table t (k bigint, v double)")
    con.executemany("insert into t values (?, ?)", pairs)
    want = dict(con.execute("select k, quantile_cont(v, 0.5) from t group by 1").fetchall())
    assert {r[CONV]: r["med"] for r in got} == want


def test_turning_points_of_mirrored_shifts(spark):
    """Two shifts lie equally far from the median, which is their mean; the earlier one comes first."""
    tensions = {1: [12.61, 70.19, 30.94, 5.93, 100.0, 7.04, 51.56, 11.35, 55.87, 11.17, 30.52]}
    rows = series(spark, tensions)
    got = {(r[CONV], r["pos"], round(r["robust_z"], 6)) for r in temporal.turning_points(rows, limit=5).collect()}
    con = duckdb.connect()
    con.execute("create table signals (conversation_id bigint, pos bigint, message_id bigint, speaker_id varchar, text varchar, emotion varchar, tone varchar, sentiment varchar, tension double)")
    con.executemany("insert into signals values (?, ?, ?, ?, ?, ?, ?, ?, ?)", [tuple(r) for r in rows.collect()])
    want = set(con.execute(f"with recursive {TURNING_SQL.strip()} select conversation_id, pos, round(z, 6) from tp").fetchall())
    assert got == want


def test_rise_of_exactly_twelve_is_no_fall(spark):
    """Means that differ by 12 in exact arithmetic, and by 12.000000000000004 when added in order, are not more than 12 apart."""
    xs = [14.67, 49.26, 53.34, 46.4, 28.06, 46.78, 1.37, 14.35, 61.2, 31.44]
    assert (xs[0] + xs[1] + xs[2]) / 3 - (xs[6] + xs[7] + xs[8] + xs[9]) / 4 > 12
    assert [r["trajectory"] for r in temporal.trajectory(series(spark, {1: xs, 2: xs})).collect()] == ["volatile", "volatile"]


def test_thresholds_of_a_trajectory_fall_as_in_sql(spark):
    """A fall of 12, a first rise of 8 above the start and a slope of 0.35 in exact arithmetic: the last bit decides, so the order of addition."""
    tensions = {
        1: [60.81, 100.0, 33.36, 2.24, 95.38],
        2: [18.01, 100.0, 71.97, 28.52],
        3: [34.12, 87.8, 100.0, 100.0, 29.46, 21.42, 24.05, 53.56, 88.48, 52.79, 11.45, 47.67, 64.63],
    }
    rows = series(spark, tensions)
    columns = ["conversation_id", "trajectory", "escalation_start_message"]
    con = duckdb.connect()
    con.execute("create table signals (conversation_id bigint, pos bigint, message_id bigint, speaker_id varchar, text varchar, emotion varchar, tone varchar, sentiment varchar, tension double)")
    con.executemany("insert into signals values (?, ?, ?, ?, ?, ?, ?, ?, ?)", [tuple(r) for r in rows.collect()])
    want = set(con.execute(f"with {TRAJECTORY_SQL.strip()} select {', '.join(columns)} from traj").fetchall())
    for dealt in (rows, rows.orderBy("tension"), rows.orderBy("pos")):
        assert {tuple(r) for r in temporal.trajectory(dealt).select(columns).collect()} == want


def test_levels_of_many_blocks(spark):
    """Partial sums of blocks give the means and the slope of the whole conversation."""
    xs = [(k * 7919 % 10007) / 100 for k in range(1000)]
    whole = temporal.trajectory(series(spark, {1: xs})).first()
    spark.conf.set("talkframe.blockRows", "7")
    try:
        cut = temporal.trajectory(series(spark, {1: xs})).first()
    finally:
        spark.conf.unset("talkframe.blockRows")
    for c in ("start_tension", "end_tension", "escalation_rate"):
        assert abs(whole[c] - cut[c]) < 1e-9
    n, mx, my = len(xs), (len(xs) - 1) / 2, sum(xs) / len(xs)
    slope = sum((i - mx) * (x - my) for i, x in enumerate(xs)) / sum((i - mx) ** 2 for i in range(n))
    assert abs(cut["escalation_rate"] - slope) < 1e-9
