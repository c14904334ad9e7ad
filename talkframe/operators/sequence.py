"""Ordered-sequence building blocks that hold when one conversation has a large share of all rows.

A plain ``Window.partitionBy(conversation_id)`` puts a whole conversation in one task. Here every row has a dense
0-based position ``pos`` in its group and belongs to block ``pos div block_rows``. Rows are only ever brought
together per (group, block):

* ``blocked``  copies the few rows a bounded frame needs across a block edge, so frames run inside a block;
* ``prefix``   running sums / maxima: running value in the block plus the total of the earlier blocks;
* ``attach``   a group total on every row, through per-block partial totals;
* ``merge_close`` a left-to-right greedy scan with a small state at each block edge.

Only tables with one row per (group, block) are ever windowed per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from talkframe.session import block_rows, settle

KEYS = ("conversation_id",)
BLK = "_blk"
OWN = "_own"

_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}

Spec = Mapping[str, tuple[str, Column]]


def blocked(df: DataFrame, before: int = 0, after: int = 0, pos: str = "pos") -> DataFrame:
    """Assign rows to blocks; each row also reaches the blocks whose frames look ``before`` back / ``after`` ahead."""
    size = block_rows(df)
    own = F.expr(f"`{pos}` div {size}")
    if not before and not after:
        return df.withColumn(BLK, own)
    low = F.expr(f"greatest(`{pos}` - {after}, 0L) div {size}")
    high = F.expr(f"(`{pos}` + {before}) div {size}")
    return df.withColumn(BLK, F.explode(F.sequence(low, high))).withColumn(OWN, F.col(BLK) == own)


def block_window(keys: Sequence[str] = KEYS, pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, BLK).orderBy(pos)


def owned(df: DataFrame, keep_block: bool = False) -> DataFrame:
    """Drop the copied rows again once the bounded frames have been evaluated."""
    out = df.filter(OWN).drop(OWN) if OWN in df.columns else df
    return out if keep_block else out.drop(BLK)


def prefix(
    df: DataFrame,
    specs: Spec,
    keys: Sequence[str] = KEYS,
    order: Sequence[str | Column] = ("pos",),
    bucket: str = BLK,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` / ``count`` / ``max`` / ``min`` per group in ``order``.

    ``bucket`` is any column that never decreases in ``order``; a task holds one (group, bucket) at a time.
    """
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *[_AGG[fn](c).over(local).alias(f"_l_{n}") for n, (fn, c) in specs.items()])
    parts = df.groupBy(*keys, bucket).agg(*[_AGG[fn](c).alias(f"_c_{n}") for n, (fn, c) in specs.items()])
    carry = parts.select(
        *keys, bucket, *[_COMBINE[fn](f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, (fn, _) in specs.items()]
    )
    out = rows.join(carry, [*keys, bucket])
    for n, (fn, _) in specs.items():
        here, past = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if fn in ("sum", "count"):
            both = F.coalesce(here, past - past, F.lit(0)) + F.coalesce(past, here - here, F.lit(0))
        else:
            both = (F.greatest if fn == "max" else F.least)(here, past)
        out = out.withColumn(n, both).drop(f"_l_{n}", f"_c_{n}")
    return out


def number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "pos",
) -> DataFrame:
    """Dense 0-based position of each row in its group; ``bucket`` must not decrease in ``order``."""
    out = prefix(df.withColumn("_bk", bucket), {name: ("sum", F.lit(1))}, keys, order, "_bk")
    return out.withColumn(name, (F.col(name) - 1).cast("long")).drop("_bk")


def ranged(df: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Cut the rows into ranges of about equal depth along ``order`` and number them in ``name``, which never decreases in ``order``.

    Spark samples the splitters from the rows themselves, so values may be spread in any way; equal rows share a range. The numbered
    rows are written once: a recomputed task can't move a border. Runs a job.
    """
    dealt = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    return settle(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def _sparse(df: DataFrame, keys: Sequence[str], order: str) -> bool:
    """Whether ids of some group leave most of their blocks nearly empty, so that fixed id ranges would be about as many as rows."""
    span = F.max(order) - F.min(order)
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), span.alias("span")).agg(F.max(F.col("span") > 8 * F.col("n") + block_rows(df)).alias("s"))
    return bool(per.first()["s"])


def with_positions(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "message_id", sparse: bool | None = None) -> DataFrame:
    """Add ``pos`` from ascending ids, unless the table already carries it.

    Dense ids are numbered in fixed id ranges. Sparse ones (times, hashes) are numbered in ranges of equal depth; which of the two holds is
    measured by one aggregate unless ``sparse`` says it.
    """
    if "pos" in df.columns:
        return df
    if _sparse(df, keys, order) if sparse is None else sparse:
        dealt = ranged(df, [*keys, order], "_rng")
        return number(dealt, keys, [order], F.col("_rng")).drop("_rng")
    return number(df, keys, [order], F.expr(f"`{order}` div {block_rows(df)}"))


def attach(df: DataFrame, specs: Spec, keys: Sequence[str] = KEYS, bucket: str = BLK) -> DataFrame:
    """Put group totals on every row without gathering the group: per-block totals, combined, joined back per block."""
    parts = df.groupBy(*keys, bucket).agg(*[_AGG[fn](c).alias(n) for n, (fn, c) in specs.items()])
    whole = Window.partitionBy(*keys)
    totals = parts.select(
        *keys, bucket, *[_COMBINE[fn](n).over(whole).alias(n) for n, (fn, _) in specs.items()]
    )
    return df.join(totals, [*keys, bucket])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark trims each map task to ``k`` rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    width: float | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``.

    Equal values are counted before the shuffle. Counts per value range locate the range that holds each wanted rank, and
    only those ranges are ordered value by value. Ranges have a ``width`` where the spread of the values is known, else equal
    depth.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = ranged(counts, [*keys, "_v"], "_r") if width is None else counts.withColumn("_r", F.floor(F.col("_v") / F.lit(width)))
    upto = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(hi).alias("hi"), step((F.col("_t") - 1) * p).cast("long").alias("k"))
            for name, p in probs.items()
            for hi, step in ((False, F.floor), (True, F.ceil))
        ]
    )
    ranges = (
        counts.groupBy(*keys, "_r")
        .agg(F.sum("_n").alias("_rn"))
        .select(*keys, "_r", "_rn", F.sum("_rn").over(upto).alias("_end"), F.sum("_rn").over(whole).alias("_t"))
        .withColumn("_start", F.col("_end") - F.col("_rn"))
        .withColumn("_want", F.filter(wanted, lambda w: (w.k >= F.col("_start")) & (w.k < F.col("_end"))))
        .filter(F.size("_want") > 0)
        .select(*keys, "_r", "_start", "_want", "_t")
    )
    inside = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counts.join(ranges, [*keys, "_r"])
        .withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_w", F.explode("_want"))
        .filter((F.col("_w.k") < F.col("_upto")) & (F.col("_w.k") >= F.col("_upto") - F.col("_n")))
    )
    picked = hits.groupBy(*keys).agg(
        F.max("_t").alias("_t"),
        *[
            F.max(F.when((F.col("_w.name") == name) & (F.col("_w.hi") == F.lit(hi)), F.col("_v"))).alias(f"_{name}_{int(hi)}")
            for name in probs
            for hi in (False, True)
        ],
    )
    out = []
    for name, p in probs.items():
        at = (F.col("_t") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_0"), F.col(f"_{name}_1")
        part = at - F.floor(at)
        out.append((low * (F.lit(1.0) - part) + high * part).alias(name))  # mirrored values get mirrored results, bit by bit
    return picked.select(*keys, *out)


def merge_close(hits: DataFrame, height: str, keys: Sequence[str] = KEYS, pos: str = "pos", reach: int = 2) -> DataFrame:
    """Greedy left-to-right merge of nearby hits: a hit within ``reach`` of the last kept one replaces it when strictly
    higher and is dropped otherwise. Returns (keys, pos) of the survivors.

    Within a block the scan is an ``aggregate`` over that block's hits. What a block inherits is only *which* of the
    ``reach`` positions before it was kept last, so each block is scanned once per possible inheritance and the block
    results are chained on the per-block table.
    """
    size = block_rows(hits)
    spread = blocked(hits.select(*keys, F.col(pos).cast("long").alias("pos"), F.col(height).alias("_h")), reach, reach)
    ahead = Window.partitionBy(*keys, BLK).orderBy("pos").rangeBetween(1, reach)
    spread = spread.withColumn("_beaten", F.coalesce(F.max("_h").over(ahead) > F.col("_h"), F.lit(False)))
    groups = (
        spread.filter(F.col(OWN) | (F.col("pos") < F.col(BLK) * size))
        .groupBy(*keys, BLK)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "_h", "_beaten", OWN))).alias("_a"))
    )
    first = F.col(BLK) * size
    own_hits = F.filter("_a", lambda h: h[OWN])

    def scan(entry: int) -> Column:
        """Positions that become 'last kept' when the position ``entry`` before the block was kept (0 = none)."""
        past = F.filter("_a", lambda h: ~h[OWN] & (h["pos"] == first - entry))
        known = F.size(past) > 0
        start = F.struct(
            F.when(known, F.get(past, F.lit(0))["pos"]).alias("p"),
            F.when(known, F.get(past, F.lit(0))["_h"]).alias("h"),
            F.array().cast("array<bigint>").alias("kept"),
        )

        def step(acc: Column, h: Column) -> Column:
            near = acc["p"].isNotNull() & (h["pos"] - acc["p"] <= reach)
            take = ~near | (h["_h"] > acc["h"])
            return F.struct(
                F.when(take, h["pos"]).otherwise(acc["p"]).alias("p"),
                F.when(take, h["_h"]).otherwise(acc["h"]).alias("h"),
                F.when(take, F.concat(acc["kept"], F.array(h["pos"]))).otherwise(acc["kept"]).alias("kept"),
            )

        return F.aggregate(own_hits, start, step)

    def leaves(state: Column) -> Column:
        gap = (F.col(BLK) + 1) * size - state["p"]
        return F.when(gap <= reach, gap).otherwise(F.lit(0)).cast("int")

    scanned = groups.select(*keys, BLK, F.array(*[scan(e) for e in range(reach + 1)]).alias("_s"))
    exits = scanned.filter(F.size("_s") > 0).select(
        *keys, BLK, F.array(*[F.coalesce(leaves(F.col("_s")[e]), F.lit(0)) for e in range(reach + 1)]).alias("_x")
    )
    # Only a block whose predecessor ends within reach of the edge inherits anything.
    touched = exits.filter(F.exists("_x", lambda x: x > 0))

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(BLK)
        state, last, out = 0, None, []
        for blk, ex in zip(part[BLK], part["_x"]):
            state = int(ex[state if last == blk - 1 else 0])
            last = blk
            out.append((blk + 1, state))
        rows = pd.DataFrame(out, columns=[BLK, "_entry"])
        for k in keys:
            rows[k] = part[k].iloc[0]
        return rows[[*keys, BLK, "_entry"]]

    fields = [f"`{k}` {hits.schema[k].dataType.simpleString()}" for k in keys]
    entries = touched.groupBy(*keys).applyInPandas(chain, ", ".join([*fields, f"{BLK} bigint", "_entry int"]))
    kept = (
        scanned.join(entries, [*keys, BLK], "left")
        .select(*keys, F.explode(F.col("_s")[F.coalesce("_entry", F.lit(0))]["kept"]).alias("pos"))
    )
    alive = spread.filter(F.col(OWN) & ~F.col("_beaten")).select(*keys, "pos")
    return kept.join(alive, [*keys, "pos"], "left_semi")


def attach_table(df: DataFrame, small: DataFrame, keys: Sequence[str] = KEYS, how: str = "inner") -> DataFrame:
    """Join a one-row-per-group table to blocked rows per block, so a large group never meets in one task."""
    edges = df.select(*keys, BLK).distinct()
    return df.join(edges.join(small, [*keys]), [*keys, BLK], how)
