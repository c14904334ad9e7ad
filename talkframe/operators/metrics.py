"""Evaluation measures. Rows are counted down to label pairs or distinct scores first; ranks and cumulative sums then
run over score ranges, so one frequent class or score does not concentrate work."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe.functions.stats import chi2_tail, kolmogorov_tail
from talkframe.operators import sequence as seq


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Counts per (gold, pred) with the share of the gold class and the rank of each confusion by count."""
    pairs = confusion(df, gold, pred)
    # One row per pair of known labels from here on.
    whole = Window.partitionBy("gold")
    wrong = (F.col("gold") != F.col("pred")).cast("int")
    order = Window.partitionBy(wrong).orderBy(F.col("n").desc(), "gold", "pred")
    return pairs.select(
        "gold", "pred", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"),
        F.when(wrong == 1, F.row_number().over(order)).alias("error_rank"),
    )


def per_class(pairs: DataFrame) -> DataFrame:
    """tp / fp / fn per class of the union of gold and predicted labels, from (gold, pred, n)."""
    hit = F.col("gold") == F.col("pred")
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.when(hit, F.col("n")).otherwise(none).alias("tp"), none.alias("fp"),
                 F.when(hit, none).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("pred").alias("label"), none.alias("tp"), F.when(hit, none).otherwise(F.col("n")).alias("fp"),
                 none.alias("fn")),
    )
    return pairs.select(F.inline(sides)).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def classification(pairs: DataFrame) -> DataFrame:
    """Accuracy, macro precision / recall / F1 and support-weighted F1 from (gold, pred, n)."""
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = per_class(pairs).select(
        "tp", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("p"), ratio(tp, tp + fn).alias("r"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f"),
    )
    return c.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("p").alias("precision"),
        F.avg("r").alias("recall"),
        F.avg("f").alias("f1_macro"),
        (F.sum(F.col("support") * F.col("f")) / F.sum("support")).alias("f1_weighted"),
    )


def regression(df: DataFrame, gold: str, pred: str) -> DataFrame:
    e = F.col(pred) - F.col(gold)
    return df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(gold))).alias("r2"),
    )


def _score_counts(df: DataFrame, truth: Column, score: Column, parts: int | None) -> DataFrame:
    """Both classes per distinct score, in ranges ``r`` of equal depth: scores may crowd anywhere. Rows without a score are left out."""
    counts = df.groupBy(score.alias("s")).agg(F.count(F.when(truth, 1)).alias("pos"), F.count(F.when(~truth, 1)).alias("neg"))
    return seq.ranged(counts.filter("s is not null"), ["s"], "r", parts)


def ranking_auc(df: DataFrame, truth: Column, score: Column, parts: int | None = None) -> DataFrame:
    """Area under the ROC curve from average ranks; null unless both classes occur. ``parts``: number of score ranges."""
    counts = _score_counts(df, truth, score, parts)
    ranked = seq.prefix(counts, {"upto": ("sum", F.col("pos") + F.col("neg"))}, [], ["s"], "r")
    n = F.col("pos") + F.col("neg")
    total = ranked.agg(
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"),
        F.sum(F.col("pos") * (F.col("upto") - n + (n + 1) / 2)).alias("ranks"),
    )
    p, q = F.col("p"), F.col("q")
    return total.select(F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q).alias("auc"))


def average_precision(df: DataFrame, truth: Column, score: Column, parts: int | None = None) -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds, highest score first."""
    counts = _score_counts(df, truth, -score, parts)
    cum = seq.prefix(counts, {"tp": ("sum", F.col("pos")), "all": ("sum", F.col("pos") + F.col("neg"))}, [], ["s"], "r")
    total = cum.agg(
        F.sum(F.col("pos") * (F.col("tp") / F.col("all"))).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("q")
    )
    return total.select(F.when(F.col("q") > 0, F.try_divide("area", "p")).alias("ap"))


def brier(df: DataFrame, truth: Column, p: Column) -> DataFrame:
    d = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) - truth.cast("double")
    return df.agg(F.avg(d * d).alias("brier"))


def quantile_edges(df: DataFrame, score: str, bins: int) -> list[float]:
    """Distinct quantile edges (``bins`` + 1 numbers at most)."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    row = seq.exact_quantiles(df, score, probs, keys=[]).first()
    edges = sorted({float(row[f"q{i}"]) for i in range(bins + 1)}) if row else []
    return edges if len(edges) > 1 else [0.0, 1.0]


def reliability(df: DataFrame, correct: Column, score: str, bins: int = 10) -> DataFrame:
    """Mean confidence and accuracy per quantile bin."""
    edges = quantile_edges(df, score, bins)
    at = F.lit(0)
    for edge in edges[1:-1]:
        at = at + (F.col(score) >= edge).cast("int")
    return df.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy")
    )


def calibration(df: DataFrame, correct: Column, score: str, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error of a predictor's own confidence."""
    b = reliability(df, correct, score, bins)
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    n = F.sum("n")
    return b.agg(
        (F.sum(gap * F.col("n")) / n).alias("ece"), F.max(gap).alias("mce"),
        (F.sum(F.col("mean_confidence") * F.col("n")) / n).alias("mean_confidence"),
        (F.sum(F.col("accuracy") * F.col("n")) / n).alias("accuracy"), n.alias("n"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa and two-coder nominal alpha (pooled marginals) from (gold, pred, n)."""
    c = per_class(pairs).select((F.col("tp") + F.col("fn")).alias("a"), (F.col("tp") + F.col("fp")).alias("b"), "tp")
    t = c.agg(
        F.sum("tp").alias("same"), F.sum("a").alias("n"),
        F.sum(F.col("a").cast("double") * F.col("b")).alias("own"),
        F.sum((F.col("a") + F.col("b")).cast("double") * (F.col("a") + F.col("b"))).alias("pooled"),
    )
    po = F.col("same") / F.col("n")
    own = F.col("own") / F.col("n") / F.col("n")
    pooled = F.col("pooled") / F.col("n") / F.col("n") / 4

    def chance(pe: Column) -> Column:
        return F.when(F.abs(F.lit(1.0) - pe) < 1e-12, F.lit(0.0)).otherwise(F.try_divide(po - pe, F.lit(1.0) - pe))

    return t.select(po.alias("observed"), own.alias("expected"), chance(own).alias("kappa"), chance(pooled).alias("alpha"), "n")


def top_k_accuracy(df: DataFrame, gold: str, probabilities: str, k: int = 3) -> DataFrame:
    """Share of rows whose gold label is among the ``k`` most probable ones of a label-to-probability map."""
    ranked = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("l"))))
    top = F.transform(F.slice(ranked, 1, k), lambda s: s["l"])
    return df.agg(
        F.avg((F.get(top, F.lit(0)) == F.col(gold)).cast("double")).alias("exact"),
        F.avg(F.array_contains(top, F.col(gold)).cast("double")).alias("top_k"), F.count(F.lit(1)).alias("n"),
    )


def _exact_two_sided() -> Callable[..., Column]:
    """Pandas UDF: exact two-sided sign test from two counts. Kept self-contained so workers need nothing but pandas."""

    def half_tail(k: int, n: int) -> float:
        # P(X <= k) for n fair coin flips, summed from the largest term down until terms vanish.
        logp = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        term, total, i = 1.0, 1.0, k
        while i > 0 and term > 1e-18 * total:
            term *= i / (n - i + 1)
            total += term
            i -= 1
        return math.exp(logp) * total

    def two_sided(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(
            [1.0 if x + y == 0 else min(1.0, 2 * half_tail(int(min(x, y)), int(x + y))) for x, y in zip(b, c)]
        )

    return F.pandas_udf(two_sided, T.DoubleType())


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Discordant counts of two paired predictors and the exact two-sided p-value."""
    t = df.agg(F.count(F.when(~a & b, 1)).alias("a_wrong_b_right"), F.count(F.when(a & ~b, 1)).alias("a_right_b_wrong"))
    x, y = F.col("a_wrong_b_right"), F.col("a_right_b_wrong")
    return t.select(x, y, (x + y).alias("discordant"), _exact_two_sided()(x, y).alias("p_value"))


def select_on_validation(df: DataFrame, gold: str, candidates: list[str], split: str = "split") -> DataFrame:
    """One row per candidate prediction column: accuracy on the validation and test rows, and whether it is the one to use (best on
    validation, ties to the candidate named first). Test rows have no say in the choice."""
    def hit(c: str, part: str) -> Column:
        return F.avg(F.when(F.col(split) == part, (F.col(c) == F.col(gold)).cast("double")))

    wide = df.agg(*[hit(c, part).alias(f"{c}_{part}") for c in candidates for part in ("val", "test")])
    rows = F.inline(F.array(*[
        F.struct(F.lit(c).alias("model"), F.lit(i).alias("place"), F.col(f"{c}_val").alias("val"), F.col(f"{c}_test").alias("test"))
        for i, c in enumerate(candidates)]))
    best = Window.partitionBy()  # one row per candidate
    return wide.select(rows).withColumn(
        "selected", F.col("place") == F.max(F.struct("val", (-F.col("place")).alias("p"))).over(best)["p"] * -1).drop("place")


def bootstrap_delta(df: DataFrame, a: Column, b: Column, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Accuracy difference of two paired predictors with a percentile interval.

    A resample of paired 0/1 outcomes is fully described by how often each of the four outcome pairs is drawn, so each
    replicate is one multinomial draw from four counts; the rows themselves are read once.
    """
    cell = (a.cast("int") * 2 + b.cast("int")).alias("cell")
    counts = [0, 0, 0, 0]
    for row in df.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).collect():  # four rows at most
        counts[row["cell"]] = row["n"]
    n = sum(counts)

    def draw(batches):
        for pdf in batches:
            out = [
                np.random.default_rng((seed, int(i))).multinomial(n, np.array(counts) / max(n, 1)) for i in pdf["id"]
            ]
            yield pd.DataFrame({"delta": [(d[1] - d[2]) / max(n, 1) for d in out]})

    deltas = df.sparkSession.range(n_boot).mapInPandas(draw, "delta double")
    return deltas.agg(
        F.lit((counts[1] - counts[2]) / max(n, 1)).alias("delta"),
        F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"),
        F.count(F.lit(1)).alias("n_boot"),
    )


def split_independence(df: DataFrame, label: str, splits: tuple = ("train", "val", "test")) -> DataFrame:
    """Chi-square of split against label, its p-value, and the largest class-share deviation of any split."""
    per = df.groupBy(F.col(label).alias("label")).agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in splits])
    whole = Window.partitionBy()  # one row per label
    per = per.select("*", *[F.sum(s).over(whole).alias(f"n_{s}") for s in splits]).withColumn("k", sum(F.col(s) for s in splits))
    n = sum(F.col(f"n_{s}") for s in splits)
    part = F.lit(0.0)
    worst = []
    for s in splits:
        part = part + F.coalesce(F.try_divide(F.col(s).cast("double") * F.col(s) * n, F.col("k").cast("double") * F.col(f"n_{s}")), F.lit(0.0))
        worst.append(F.abs(F.try_divide(F.col(s), F.col(f"n_{s}")) - F.col("k") / n))
    t = per.select(part.alias("part"), F.greatest(*worst).alias("dev"), n.alias("n"), F.lit(1).alias("one"))
    t = t.agg((F.sum("part") - F.max("n")).alias("chi2"), ((F.sum("one") - 1) * (len(splits) - 1)).alias("dof"), F.max("dev").alias("max_deviation"))
    p = chi2_tail(F.col("chi2"), F.col("dof"))
    return t.select("chi2", "dof", p.alias("p_value"), "max_deviation",
                    ((F.col("max_deviation") < 0.06) & (F.coalesce(p, F.lit(1.0)) > 0.01)).alias("ok"))


def split_balance(df: DataFrame, value: str, a: str = "train", b: str = "test", parts: int | None = None) -> DataFrame:
    """Standardised mean difference between two splits, their spreads, the largest gap of their distribution functions and its p-value."""
    counts = df.groupBy(F.col(value).alias("v")).agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(k) for s, k in ((a, "a"), (b, "b"))]
    )
    counts = seq.ranged(counts.filter("v is not null"), ["v"], "r", parts)
    cum = seq.prefix(counts, {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))}, [], ["v"], "r")
    cum = seq.attach(cum, {"na": ("max", F.col("ca")), "nb": ("max", F.col("cb"))}, [], "r")
    gap = F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))
    t = cum.agg(
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.max(gap).alias("ks"),
        *[F.sum(F.col(s) * F.col("v")).alias(f"s{s}") for s in "ab"],
        *[F.sum(F.col(s) * F.col("v") * F.col("v")).alias(f"q{s}") for s in "ab"],
    )
    na, nb = F.col("na"), F.col("nb")
    mean_a, mean_b = F.try_divide("sa", "na"), F.try_divide("sb", "nb")
    # (n - 1) * sample variance = sum of squares - n * mean^2
    within = F.col("qa") - na * mean_a * mean_a + F.col("qb") - nb * mean_b * mean_b
    d = F.try_divide(mean_b - mean_a, F.sqrt(F.try_divide(within, na + nb - 2)))
    sd = [F.sqrt(F.greatest(F.try_divide(q, n) - m * m, F.lit(0.0))) for q, n, m in ((F.col("qa"), na, mean_a), (F.col("qb"), nb, mean_b))]
    return t.select(d.alias("cohens_d"), mean_a.alias("mean_a"), mean_b.alias("mean_b"), sd[0].alias("sd_a"), sd[1].alias("sd_b"), "ks",
                    kolmogorov_tail(F.col("ks"), na, nb).alias("ks_p_value"), (F.abs(d) < 0.2).alias("passed"))
