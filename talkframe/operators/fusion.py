"""Validation-tuned fusion weights: try candidate (behaviour, hidden) weights against how right the tension was."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.operators import sequence as seq


def candidates(n: int = 512, weights: dict = fixed.FUSION_WEIGHTS) -> np.ndarray:
    """The default pair, then an even grid of ``n - 1`` pairs with the same sum: only their ratio is free."""
    default = (weights["behavior"], weights["hidden"])
    hidden = np.linspace(0.0, sum(default), n - 1)
    return np.concatenate([[default], np.stack([sum(default) - hidden, hidden], axis=1)])


def search(df: DataFrame, pred: Column, gold: Column, evidence: dict[str, Column], n: int = 512,
           weights: dict = fixed.FUSION_WEIGHTS) -> DataFrame:
    """One row of weights. ``evidence`` gives the ``text``, ``behavior`` and ``hidden`` streams of a message; ``n`` pairs are tried.

    Each task folds its rows into one vector of squared-error sums (a number per candidate), so rows are neither
    multiplied by the candidates nor shuffled.
    """
    rows = df.select(F.abs(pred - gold).alias("miss"), *[c.alias(k) for k, c in evidence.items()])
    row = seq.exact_quantiles(rows, "miss", {"tau": 0.5}, 0.05, keys=[]).first()
    tau = max(row["tau"] if row else 1.0, 1.0)
    pairs = candidates(n, weights)
    text = weights["text"] + weights["context"] + weights["memory"]

    def fold(batches):
        total, count = np.zeros(len(pairs)), 0
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                target = np.exp(-((part["miss"].to_numpy() / tau) ** 2))
                conf = part["text"].to_numpy()[:, None] * (text * 2.2)
                conf = conf + part["behavior"].to_numpy()[:, None] * pairs[:, 0] + part["hidden"].to_numpy()[:, None] * pairs[:, 1]
                total += ((np.clip(conf, 0, 0.995) - target[:, None]) ** 2).sum(axis=0)
                count += len(part)
        yield pd.DataFrame({"candidate": np.arange(len(pairs)), "loss": total, "n": count})

    losses = rows.mapInPandas(fold, "candidate long, loss double, n long").groupBy("candidate").agg(
        (F.sum("loss") / F.sum("n")).alias("loss")
    )
    best = losses.agg(
        F.min(F.when(F.col("candidate") > 0, F.struct("loss", "candidate"))).alias("best"),
        F.max(F.when(F.col("candidate") == 0, F.col("loss"))).alias("fallback_loss"),
    )
    won = F.col("best.loss") < F.col("fallback_loss") - 1e-9
    table = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in pairs])
    at = F.when(won, F.col("best.candidate")).otherwise(F.lit(0)).cast("int")
    return best.select(
        F.get(F.get(table, at), F.lit(0)).alias("behavior"), F.get(F.get(table, at), F.lit(1)).alias("hidden"),
        *[F.lit(weights[k]).alias(k) for k in ("text", "context", "memory", "temporal")],
        F.least("fallback_loss", F.when(won, F.col("best.loss"))).alias("loss"), won.alias("tuned"),
    )


def resolve_weights(explicit: dict | None = None, tuned: dict | None = None, stored: dict | None = None) -> dict:
    """First of: given by the caller, tuned on validation data, stored with the model, the fixed default."""
    return explicit or tuned or stored or fixed.FUSION_WEIGHTS
