"""Deterministic train / validation / test splits and duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions.text import normal_text
from talkframe.operators import sequence as seq
from talkframe.session import settle

BUCKETS = 1000
MODULUS = 100_000_000


def hash_key(value: Column, modulus: int = MODULUS) -> Column:
    """The md5 of ``value`` as a 128-bit number, modulo ``modulus``."""
    digest = F.md5(value.cast("string"))
    m = F.lit(modulus).cast("decimal(20,0)")
    high = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % m
    low = F.conv(F.substring(digest, 17, 16), 16, 10).cast("decimal(20,0)") % m
    return ((high.cast("long") * F.lit(2**64 % modulus) + low.cast("long")) % modulus).cast("long")


def _ranked(df: DataFrame, keys: list[str], ident: str, share: tuple[float, float]) -> DataFrame:
    """Rank rows per group by (hash, id) and cut at the given shares; ranks are counted per hash range."""
    rows = df.withColumn("_h", hash_key(F.col(ident)))
    size = MODULUS // BUCKETS
    rows = seq.number(rows, keys, ["_h", ident], F.expr(f"_h div {size}"), "_rank").withColumn("_bk", F.expr(f"_h div {size}"))
    rows = seq.attach(rows, {"_n": ("count", F.lit(1))}, keys, "_bk")
    n_train, n_val = F.floor(F.col("_n") * F.lit(share[0])), F.floor(F.col("_n") * F.lit(share[1]))
    split = F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_val, "val").otherwise("test")
    return rows.withColumn("split", split).drop("_h", "_n", "_bk")


def hash_split(df: DataFrame, ident: str = "conversation_id", share: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """(id, split) for every distinct id, whole conversations only."""
    return _ranked(df.select(ident).distinct(), [], ident, share).drop("_rank")


def with_split(df: DataFrame, ident: str = "conversation_id") -> DataFrame:
    split = settle(hash_split(df, ident), "split")
    return seq.attach_table(seq.blocked(seq.with_positions(df)), split, [ident]).drop(seq.BLK)


def band_split(df: DataFrame, band: str, ident: str, share: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """The same cut within every band."""
    return _ranked(df, [band], ident, share).drop("_rank")


def stratified_split(df: DataFrame, strata: list[str], script: str, order: str) -> DataFrame:
    """Last row of each stratum to ``test_seen``, the one before to ``val``, earlier ones to ``train``; scripts above 1
    go to ``test`` whole."""
    last = seq.top_k(df.filter(F.col(script) <= 1).select(*strata, script, order), [*strata, script], [F.col(order).desc()], 2)
    marked = df.join(last.select(order, "rank"), order, "left")
    split = (
        F.when(F.col(script) > 1, "test").when(F.col("rank") == 1, "test_seen").when(F.col("rank") == 2, "val").otherwise("train")
    )
    return marked.withColumn("split", split).drop("rank")


def dedup_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """First row per normalised text, with how many rows share it."""
    return df.groupBy(F.md5(normal_text(F.col(text))).alias("text_key")).agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias("copies")
    )
