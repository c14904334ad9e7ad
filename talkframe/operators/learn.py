"""Learned heads with Spark ML: text terms, context terms, behaviour and memory blocks; three label heads, three
calibrated binary heads, one tension head; and sequential inference on the model's own history."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe import fixed
from talkframe.functions.text import BEHAVIOUR
from talkframe.operators import context, vectors
from talkframe.operators import sequence as seq
from talkframe.operators.splits import hash_key
from talkframe.session import gathered, settle, side_by_side, work_dir

CONV = "conversation_id"
MEMORY = [f"m{i}" for i in range(10)]
BLOCKS = {"A": ["text"], "B": ["text", "context"], "C": ["text", "context", "memory"], "D": ["text", "context", "behaviour", "memory"]}
MULTI = ("sentiment", "emotion", "tone")
BINARY = ("sarcasm", "irony", "passive_aggression")


@dataclass
class Terms:
    """A fixed vocabulary with its idf weights (at most ``max_features`` entries)."""

    words: list[str] = field(default_factory=list)
    idf: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, ident: list[str], text: str = "text", min_df: int = 2, max_features: int = 12000) -> Terms:
        docs = df.select(F.concat_ws("/", *ident).alias("_doc"), text)
        counts = vectors.term_counts(docs, "_doc", text)
        rows = vectors.vocabulary(counts, df.count(), min_df, max_features).orderBy("term_id").collect()
        return cls([r["term"] for r in rows], [r["idf"] for r in rows])

    def weigh(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add the unit-length tf-idf vector of a text column. Narrow: the vocabulary travels with the tasks."""
        idf, index = np.array(self.idf), {w: i for i, w in enumerate(self.words)}

        def scale(terms):
            counts = Counter(index[t] for t in terms or () if t in index)
            ids = np.array(sorted(counts), int)
            return SparseVector(len(idf), ids, (1.0 + np.log(np.array([counts[i] for i in ids], float))) * idf[ids])

        raw = df.withColumn("_w", F.udf(scale, VectorUDT())(vectors.terms(F.col(text))))
        return Normalizer(inputCol="_w", outputCol=out, p=2.0).transform(raw).drop("_w")


def design(df: DataFrame, terms: Terms, blocks: list[str] = BLOCKS["D"]) -> DataFrame:
    """Add the wanted ones of ``text_block, context_block, behaviour_block, memory_block`` to read messages."""
    for name, column in (("text", "text"), ("context", "context_text")):
        if name in blocks:
            df = terms.weigh(df, column, f"{name}_block")
    for name, cols in (("behaviour", BEHAVIOUR), ("memory", MEMORY)):
        if name in blocks:
            df = VectorAssembler(inputCols=cols, outputCol=f"{name}_block").transform(df)
    return df


def assemble(df: DataFrame, blocks: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=[f"{b}_block" for b in blocks], outputCol=out).transform(df)


@dataclass
class Head:
    """A linear head: ``classes`` (labels, or none), coefficients, intercepts and, per fold, its probability curve."""

    kind: str
    classes: list[str]
    coef: list[list[float]]
    bias: list[float]
    curve: list[list[float]] = field(default_factory=list)


def _balanced(train: DataFrame, label: str) -> tuple[DataFrame, list, int]:
    counts = {r["label"]: r["n"] for r in train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(counts)  # one entry per label
    n = sum(counts.values())
    index, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, c in enumerate(classes):
        index = F.coalesce(index, F.when(F.col(label) == c, F.lit(float(i))))
        weight = F.coalesce(weight, F.when(F.col(label) == c, F.lit(n / (len(classes) * counts[c]))))
    return train.select("features", index.alias("_y"), weight.alias("_wt")), classes, n


def fit_labels(train: DataFrame, label: str, c: float = 4.0, max_iter: int = 100) -> Head | None:
    """Class-balanced multinomial head; None when only one class occurs (a neutral prior is served instead)."""
    rows, classes, n = _balanced(train, label)
    if len(classes) < 2:
        return None
    model = LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="_wt", family="multinomial", maxIter=max_iter, elasticNetParam=0.0,
        regParam=1.0 / (c * n), standardization=False,
    ).fit(rows)
    return Head("labels", [str(x) for x in classes], model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist())


def fit_label_margins(train: DataFrame, label: str, max_iter: int = 100) -> Head | None:
    """Linear support vector baseline of a label head, one class against the rest; the largest margin wins. Spark's machine has the hinge
    loss, not the squared one."""
    rows, classes, n = _balanced(train, label)
    if len(classes) < 2:
        return None
    coef, bias = [], []
    for i in range(len(classes)):
        part = rows.select("features", (F.col("_y") == i).cast("double").alias("_y"), "_wt")
        model = LinearSVC(featuresCol="features", labelCol="_y", weightCol="_wt", regParam=1.0 / n, standardization=False, maxIter=max_iter).fit(part)
        coef.append(model.coefficients.toArray().tolist())
        bias.append(float(model.intercept))
    return Head("labels", [str(x) for x in classes], coef, bias)


def _platt(scored: DataFrame) -> list[float]:
    """Slope and offset of the probability curve over held-out margins, with smoothed targets."""
    n = {int(r["_y"]): r["n"] for r in scored.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    hi, lo = (n.get(1, 0) + 1.0) / (n.get(1, 0) + 2.0), 1.0 / (n.get(0, 0) + 2.0)
    target = F.when(F.col("_y") == 1, hi).otherwise(lo)
    both = scored.select("margin", F.inline(F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - target).alias("w")))))
    both = VectorAssembler(inputCols=["margin"], outputCol="f").transform(both)
    m = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.0, standardization=False, maxIter=100).fit(both)
    return [float(m.coefficients[0]), float(m.intercept)]


def fit_binary(train: DataFrame, label: str, ident: Column, c: float = 1.6, folds: int = 3, svc: bool = False) -> Head | None:
    """Balanced binary head, calibrated on held-out folds; folds are fixed by a hash of ``ident``."""
    rows = train.withColumn("_fold", hash_key(ident) % folds).withColumn("_y", F.col(label).cast("double"))
    classes = [r["_y"] for r in rows.select("_y").distinct().collect()]
    if len(classes) < 2:
        return None

    def fold(k: int) -> tuple | None:
        part, names, n = _balanced(rows.filter(F.col("_fold") != k).select("features", "_y").withColumnRenamed("_y", "_label"), "_label")
        if len(names) < 2:
            return None
        if svc:
            est = LinearSVC(featuresCol="features", labelCol="_y", weightCol="_wt", regParam=1.0 / n, standardization=False, maxIter=100)
            part = part.withColumn("_wt", F.lit(1.0))
        else:
            est = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_wt", regParam=1.0 / (c * n), standardization=False, maxIter=100)
        model = est.fit(part)
        held = model.transform(rows.filter(F.col("_fold") == k))
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
        return model.coefficients.toArray().tolist(), float(model.intercept), _platt(held.select("_y", margin.alias("margin")))

    done = [x for x in side_by_side(rows, [partial(fold, k) for k in range(folds)]) if x]
    coef, bias, curve = ([x[i] for x in done] for i in range(3))
    return Head("binary", ["0", "1"], coef, bias, curve) if coef else None


def fit_tension(train: DataFrame, label: str = "tension", alpha: float = 1.0) -> Head:
    """Ridge regression with penalty ``alpha``, by one solver for every width."""
    s = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(label).alias("sd")).first()
    model = LinearRegression(
        featuresCol="features", labelCol=label, solver="l-bfgs", regParam=alpha * (s["sd"] or 1.0) / s["n"],
        elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12,
    ).fit(train)
    return Head("tension", [], [model.coefficients.toArray().tolist()], [float(model.intercept)])


def gramian(rows: DataFrame, features: str = "features", label: str = "tension") -> np.ndarray:
    """Sums of products of [features, 1, label] over all rows: (p + 2) x (p + 2) numbers, for layouts of up to about a thousand columns.

    Every task adds its batches up to one matrix; matrices are summed entry by entry, map-side first, and only the result reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
                x = np.column_stack([x, np.ones(len(x)), batch.column("y").to_numpy()])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["g"])

    whole = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).filter("x is not null and y is not null")
    cells = whole.mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    flat = [r["v"] for r in cells.orderBy("at").collect()]
    side = math.isqrt(len(flat))
    return np.array(flat).reshape(side, side)


def fit_ridge(train: DataFrame, label: str = "tension", alpha: float = 1.0) -> Head:
    """Ridge regression by its normal equations: the exact counterpart of ``fit_tension`` for dense layouts. The intercept is not penalised."""
    g = gramian(train, label=label)
    n = g[-2, -2]
    mean = g[-2] / n
    c = g - n * np.outer(mean, mean)  # centred products
    w = np.linalg.solve(c[:-2, :-2] + alpha * np.eye(len(g) - 2), c[:-2, -1])
    return Head("tension", [], [w.tolist()], [float(mean[-1] - w @ mean[:-2])])


@dataclass
class Model:
    """Heads over one feature layout, with everything inference needs."""

    blocks: list[str]
    terms: Terms
    heads: dict[str, Head]
    fusion_weights: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> str:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        raw = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        heads = {k: Head(**v) for k, v in raw["heads"].items()}
        return cls(raw["blocks"], Terms(**raw["terms"]), heads, raw["fusion_weights"])


def fit(train: DataFrame, terms: Terms, variant: str = "D", heads: tuple = (*MULTI, *BINARY, "tension")) -> Model:
    """Fit the heads of one feature layout on designed messages."""
    rows = gathered(assemble(train, BLOCKS[variant]))
    ident = F.concat_ws("/", CONV, "message_id")

    def one(h: str) -> Head | None:
        return fit_tension(rows) if h == "tension" else fit_labels(rows, h) if h in MULTI else fit_binary(rows, h, ident)

    found = side_by_side(rows, [partial(one, h) for h in heads])
    fitted = {h: head for h, head in zip(heads, found) if head is not None}
    return Model(BLOCKS[variant], terms, fitted)


def apply(df: DataFrame, model: Model, features: str = "features", with_confidence: bool = False) -> DataFrame:
    """Scores of every head on assembled rows as ``<head>_hat`` columns; label heads can add ``<head>_sure``."""
    heads = model.heads

    def unpack(v):
        ids = v.indices if isinstance(v, SparseVector) else np.nonzero(v.array)[0]
        return [int(i) for i in ids], [float(v[int(i)]) for i in ids] if not isinstance(v, SparseVector) else v.values.tolist()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mats = {h: (np.array(x.coef), np.array(x.bias)) for h, x in heads.items()}
        for pdf in batches:
            out = {c: pdf[c] for c in pdf.columns if c not in ("_i", "_v")}
            rows = list(zip(pdf["_i"], pdf["_v"]))
            for h, (w, b) in mats.items():
                z = np.array([w[:, np.asarray(i, int)] @ np.asarray(v) + b for i, v in rows]).reshape(len(rows), len(b))
                if heads[h].kind == "labels":
                    out[f"{h}_hat"] = [heads[h].classes[j] for j in z.argmax(axis=1)] if len(rows) else []
                    if with_confidence:
                        out[f"{h}_sure"] = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1) if len(rows) else []
                elif heads[h].kind == "tension":
                    out[f"{h}_hat"] = np.clip(z[:, 0], 0, 100)
                else:
                    a = np.array(heads[h].curve)
                    out[f"{h}_hat"] = (1 / (1 + np.exp(-(z * a[:, 0] + a[:, 1])))).mean(axis=1)
            yield pd.DataFrame(out)[names]

    keep = [c for c in df.columns if c != features and not c.endswith("_block")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    kinds += [f"`{h}_hat` {'string' if x.kind == 'labels' else 'double'}" for h, x in heads.items()]
    extra = [h for h, x in heads.items() if with_confidence and x.kind == "labels"]
    kinds += [f"`{h}_sure` double" for h in extra]
    names = [*keep, *[f"{h}_hat" for h in heads], *[f"{h}_sure" for h in extra]]
    flat = F.udf(unpack, "struct<_i: array<int>, _v: array<double>>")(features)
    return df.select(*keep, flat.alias("_s")).select(*keep, "_s._i", "_s._v").mapInPandas(score, ", ".join(kinds))


class Recurrence:
    """Scores one conversation message by message, each prediction being history for the later ones.

    What a conversation leaves behind is small whatever its length: ``recent`` holds the last ``k`` messages, ``older`` the ``picks`` most
    tense ones before them, both as (heat, -position, tokens), and per speaker (emotion, tone, sentiment, last ``window`` tensions).
    """

    def __init__(self, model: Model, k: int = 4, window: int = 5, picks: int = 3):
        self.k, self.window, self.picks, self.heads, self.blocks = k, window, picks, model.heads, model.blocks
        self.index, self.weight = {w: i for i, w in enumerate(model.terms.words)}, np.array(model.terms.idf)
        self.mats = {h: (np.array(x.coef), np.array(x.bias)) for h, x in model.heads.items()}
        self.offset, at = {}, 0
        for b in self.blocks:
            self.offset[b] = at
            at += {"text": len(self.weight), "context": len(self.weight), "behaviour": len(BEHAVIOUR), "memory": len(MEMORY)}[b]

    def sparse(self, tok: list) -> tuple[np.ndarray, np.ndarray]:
        counts = {}
        for t in [*tok, *(f"{a} {b}" for a, b in zip(tok, tok[1:]))]:
            i = self.index.get(t)
            if i is not None:
                counts[i] = counts.get(i, 0) + 1
        ids = np.fromiter(counts, int, len(counts))
        vals = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * self.weight[ids] if len(ids) else np.zeros(0)
        size = np.sqrt((vals**2).sum())
        return ids, vals / size if size > 0 else vals

    @staticmethod
    def remember(speaker: tuple, b: np.ndarray) -> np.ndarray:
        tables = (fixed.AROUSAL, fixed.VALENCE, fixed.WARMTH, fixed.SENTIMENT_CODE)
        arousal, valence, warmth, code = (t.get(x, 0.0) for t, x in zip(tables, (speaker[0], speaker[0], speaker[1], speaker[2])))
        heat = (sum(speaker[3]) / len(speaker[3]) if speaker[3] else 0.0) / 100
        neg, excl = b[7] / 3, b[2] / 3
        return np.array([arousal, valence, warmth, code, heat, valence * neg, warmth * excl, heat * neg,
                         b[14] * (1 - (warmth + 1) / 2), b[15] / 24 * heat])

    def step(self, recent: list, older: list, speaker: tuple, pos: int, tok: list, b: np.ndarray) -> tuple[tuple, list, list, tuple]:
        """(values of ``SCORES``, recent, older, speaker) after one message."""
        parts = {"text": self.sparse(tok)}
        if "context" in self.offset:
            parts["context"] = self.sparse([t for _, _, ts in [*older, *recent] for t in ts])
        if "behaviour" in self.offset:
            parts["behaviour"] = (np.arange(len(b)), b)
        if "memory" in self.offset:
            parts["memory"] = (np.arange(len(MEMORY)), self.remember(speaker, b))
        ids = np.concatenate([self.offset[n] + parts[n][0] for n in self.blocks]).astype(int)
        vals = np.concatenate([parts[n][1] for n in self.blocks])
        res = {}
        for h, (w, c) in self.mats.items():
            z = w[:, ids] @ vals + c
            if self.heads[h].kind == "labels":
                e = np.exp(z - z.max())
                p = e / e.sum()
                res[h], res[f"{h}_confidence"] = self.heads[h].classes[int(z.argmax())], float(p.max())
                res[f"{h}_probs"] = dict(zip(self.heads[h].classes, p.tolist()))
            elif self.heads[h].kind == "tension":
                res[h] = float(min(max(z[0], 0.0), 100.0))
            else:
                cv = np.array(self.heads[h].curve)
                res[f"{h}_p"] = float((1 / (1 + np.exp(-(z * cv[:, 0] + cv[:, 1])))).mean())
        tension = res.get("tension", 0.0)
        scores = (*(res.get(h, "neutral") for h in MULTI), *(res.get(f"{h}_confidence", 0.0) for h in MULTI),
                  *(res.get(f"{h}_probs", {}) for h in MULTI), *(res.get(f"{h}_p", 0.0) for h in BINARY), tension)
        state = (*(res.get(h, "neutral") for h in ("emotion", "tone", "sentiment")), [*speaker[3], tension][-self.window:])
        recent = [*recent, (abs(tension), -pos, tok)]
        if len(recent) > self.k:
            older = sorted([*older, recent[0]], key=lambda s: (-s[0], -s[1]))[: self.picks]
            recent = recent[1:]
        return scores, recent, older, state


NEW_SPEAKER = (None, None, None, [])
SCORES = [*MULTI, *[f"{h}_confidence" for h in MULTI], *[f"{h}_probs" for h in MULTI], *[f"{h}_p" for h in BINARY], "tension"]
SCORE_KINDS = [*["string"] * 3, *["double"] * 3, *["map<string,double>"] * 3, *["double"] * 4]


def read_ahead(df: DataFrame, *more: str) -> DataFrame:
    """What ``Recurrence`` needs of every message: its tokens and behaviour numbers."""
    tokens = vectors.terms(F.col("text"), n=1)
    return df.select(CONV, "pos", "message_id", "speaker_id", *more, tokens.alias("tokens"),
                     F.array(*[F.col(c).cast("double") for c in BEHAVIOUR]).alias("behave"))


def predict_sequential(df: DataFrame, model: Model, k: int = 4, window: int = 5, picks: int = 3) -> DataFrame:
    """Score messages in order, feeding each prediction back as history for the later ones.

    Input: messages with the behaviour columns. The recurrence runs along a conversation, so conversations are the
    unit of distribution; a task streams its sorted rows and holds only the state of a ``Recurrence``, never a whole
    conversation. A very long conversation takes its task long, but no more memory. ``<head>_probs`` holds the
    probability of every class of a label head.
    """
    rows = read_ahead(df).repartition(CONV).sortWithinPartitions(CONV, "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Recurrence(model, k, window, picks)
        conv, recent, older, speakers = None, [], [], {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.conversation_id != conv:
                    conv, recent, older, speakers = r.conversation_id, [], [], {}
                scores, recent, older, speakers[r.speaker_id] = scorer.step(
                    recent, older, speakers.get(r.speaker_id, NEW_SPEAKER), r.pos, list(r.tokens), np.asarray(r.behave, float))
                out.append((r.conversation_id, r.message_id, r.speaker_id, *scores))
            yield pd.DataFrame(out, columns=names)

    names = [CONV, "message_id", "speaker_id", *SCORES]
    kinds = [df.schema[CONV].dataType.simpleString(), "bigint", "string", *SCORE_KINDS]
    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds)))


def predict_by_sweeps(df: DataFrame, model: Model, tolerance: float = 1e-9, k: int = 4, window: int = 5, picks: int = 3,
                      max_sweeps: int | None = None) -> DataFrame:
    """The labels, confidences and scores of ``predict_sequential`` without running along a conversation.

    Every sweep scores messages at once with the previous sweep's predictions as history. A message depends only on earlier ones, so a
    conversation in which a sweep changes nothing has the sequential predictions; it is stored and the next sweep goes on with the others. The
    first i messages are final after i sweeps at the latest, usually far sooner, so as many sweeps as the longest conversation has messages, and
    one, settle every conversation. All work is block-wise, so one long conversation spreads out. Raises when ``max_sweeps`` sweeps, if given, do
    not settle.
    """
    own = [b for b in model.blocks if b in ("text", "behaviour")]  # the same in every sweep
    base = settle(design(df.select(CONV, "pos", "message_id", "speaker_id", "text", *BEHAVIOUR), model.terms, own), "sweep-base")
    state = base.select(
        CONV, "pos", *[F.lit("neutral").alias(h) for h in MULTI], *[F.lit(0.0).alias(f"{h}_confidence") for h in MULTI],
        *[F.lit(0.0).alias(f"{h}_p") for h in BINARY], F.lit(0.0).alias("tension"),
    )
    longest = base.agg(F.max("pos").alias("pos")).first()["pos"]
    settled = work_dir(base.sparkSession, "swept")
    for _ in range((0 if longest is None else longest) + 2 if max_sweeps is None else max_sweeps):
        rows = base.join(state, [CONV, "pos"])
        if "context" in model.blocks:
            rows = context.context_window(rows, k, picks)
        else:
            rows = rows.withColumn("context_text", F.lit(""))
        rows = context.memory_vector(context.speaker_memory(rows, window))
        rows = design(rows, model.terms, [b for b in model.blocks if b not in own])
        scored = apply(assemble(rows, model.blocks), model, with_confidence=True)
        known = set(scored.columns)
        new = scored.select(
            CONV, "pos",
            *[(F.col(f"{h}_hat") if f"{h}_hat" in known else F.lit("neutral")).alias(h) for h in MULTI],
            *[(F.col(f"{h}_sure") if f"{h}_sure" in known else F.lit(0.0)).alias(f"{h}_confidence") for h in MULTI],
            *[(F.col(f"{h}_hat") if f"{h}_hat" in known else F.lit(0.0)).alias(f"{h}_p") for h in BINARY],
            (F.col("tension_hat") if "tension_hat" in known else F.lit(0.0)).alias("tension"),
            *[F.col(c).alias(f"_old_{c}") for c in (*MULTI, "tension")],
        )
        new = settle(new, "sweep")
        moved = F.abs(F.col("tension") - F.col("_old_tension")) > tolerance
        for h in MULTI:
            moved = moved | (F.col(h) != F.col(f"_old_{h}"))
        moving = settle(new.filter(moved).select(CONV).distinct(), "moving")
        new = seq.blocked(new.drop(*[f"_old_{c}" for c in (*MULTI, "tension")]))
        seq.attach_table(new, moving, how="left_anti").drop(seq.BLK).write.mode("append").parquet(settled)
        if moving.isEmpty():
            break
        state = seq.attach_table(new, moving, how="left_semi").drop(seq.BLK)
    else:
        raise RuntimeError(f"predictions did not settle in {max_sweeps} sweeps")
    state = base.sparkSession.read.schema(state.schema).parquet(settled)
    names = [*MULTI, *[f"{h}_confidence" for h in MULTI], *[f"{h}_p" for h in BINARY], "tension"]
    return base.select(CONV, "pos", "message_id", "speaker_id").join(state, [CONV, "pos"]).select(CONV, "message_id", "speaker_id", *names)


def top_classes(probs: str, k: int = 3) -> Column:
    """The ``k`` likeliest classes of a ``<head>_probs`` map as (label, p), likeliest first, ties by label."""
    pairs = F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label"), e["value"].alias("p")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda e: F.struct(e["label"].alias("label"), e["p"].alias("p")))
