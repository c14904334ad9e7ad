"""Queries over the learned heads. The checks are row counts, except for the training features."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe import views
from talkframe.functions import text
from talkframe.operators import context, learn, metrics, splits
from talkframe.plans import analyze, enrich
from talkframe.queries import sqltext as t
from talkframe.queries.aggregates import rounded
from talkframe.queries.context import MEMORY_SQL, MEMORY_VECTOR_SQL
from talkframe.queries.registry import over_messages, query
from talkframe.session import gathered, settle, side_by_side

CONV = "conversation_id"


def features(spark, sf):
    return context.memory_vector(enrich.enrich(views.messages(spark, sf)))


def designed(spark, sf):
    """Messages with feature blocks and their split, written once; and the vocabulary of the training part."""
    rows = splits.with_split(features(spark, sf))
    rows = settle(rows.select(CONV, "pos", "message_id", "speaker_id", "text", "context_text", "split", *learn.MULTI, *learn.BINARY, "tension", *text.BEHAVIOUR, *learn.MEMORY), "features")
    terms = learn.Terms.fit(rows.filter("split = 'train'"), [CONV, "message_id"])
    return settle(learn.design(rows, terms), "design"), terms


@query(
    "train_features",
    over_messages(f"""{t.GAPS_SQL}, {t.BEHAVE_SQL}, {MEMORY_SQL}, {MEMORY_VECTOR_SQL}
select conversation_id, message_id, n_words, n_chars, round(caps_share, 6) as caps_share, negative_hits, is_short, round(gap_hours, 6) as gap_hours,
 a as m0, v as m1, w as m2, s as m3, round(h, 6) as m4, round(v * negative_hits / 3, 6) as m5, round(w * exclamations / 3, 6) as m6,
 round(h * negative_hits / 3, 6) as m7, round(is_short * (1 - (w + 1) / 2), 6) as m8, round(gap_hours / 24 * h, 6) as m9 from dims"""),
)
def train_features(spark, sf):
    out = features(spark, sf).select(CONV, "message_id", "n_words", "n_chars", "caps_share", "negative_hits", "is_short", "gap_hours", *learn.MEMORY)
    return rounded(out, "caps_share", "gap_hours", *learn.MEMORY)


def _score(spark, sf, heads, variant="D"):
    rows, terms = designed(spark, sf)
    model = learn.fit(rows.filter("split = 'train'"), terms, variant, heads)
    return learn.apply(learn.assemble(rows, learn.BLOCKS[variant]), model)


@query("head_multiclass")
def head_multiclass(spark, sf):
    return _score(spark, sf, ("sentiment",)).select(CONV, "message_id", "split", "sentiment", "sentiment_hat")


@query("head_binary")
def head_binary(spark, sf):
    return _score(spark, sf, ("sarcasm",)).select(CONV, "message_id", "split", "sarcasm", "sarcasm_hat")


@query("head_tension")
def head_tension(spark, sf):
    return _score(spark, sf, ("tension",)).select(CONV, "message_id", "split", "tension", "tension_hat")


@query(
    "head_tension_slope",
    over_messages("""m as (select length(text) / cast(100 as double) as x, tension as y from messages),
c as (select avg(x) as mx, avg(y) as my from m),
b as (select sum((x - mx) * (y - my)) / (sum((x - mx) ** 2) + 1) as slope, any_value(my) as my, any_value(mx) as mx from m, c)
select round(slope, 3) as slope, round(my - slope * mx, 3) as intercept from b"""),
)
def head_tension_slope(spark, sf):
    """The ridge head on one column, whose solution SQL can write down."""
    from pyspark.ml.feature import VectorAssembler

    rows = views.messages(spark, sf).select((F.length("text") / 100.0).alias("x"), "tension")
    head = learn.fit_tension(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    fitted = F.struct(F.lit(round(head.coef[0][0], 3)).alias("slope"), F.lit(round(head.bias[0], 3)).alias("intercept"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(fitted.alias("f")).select("f.*")


_COLUMNS = [*text.BEHAVIOUR, *learn.MEMORY]
_MEMORY_EXPR = {"m0": "a", "m1": "v", "m2": "w", "m3": "s", "m4": "h", "m5": "v * negative_hits / 3", "m6": "w * exclamations / 3", "m7": "h * negative_hits / 3",
                "m8": "is_short * (1 - (w + 1) / 2)", "m9": "gap_hours / 24 * h"}
_VALUES = ", ".join(f"cast({_MEMORY_EXPR.get(c, c)} as double)" for c in _COLUMNS)


def dense(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    rows = features(spark, sf).select(*_COLUMNS, "tension")
    return settle(VectorAssembler(inputCols=_COLUMNS, outputCol="features").transform(rows).select("features", "tension"), "dense")


@query(
    "ridge_gramian",
    over_messages(f"""{t.GAPS_SQL}, {t.BEHAVE_SQL}, {MEMORY_SQL}, {MEMORY_VECTOR_SQL},
f as (select [{_VALUES}, cast(1 as double), tension] as v from dims),
ij as (select i, unnest(range(i, {len(_COLUMNS) + 3})) as j from (select unnest(range(1, {len(_COLUMNS) + 3})) as i) x)
select i, j, round(sum(v[i] * v[j]), 6) as value from f, ij group by i, j"""),
)
def ridge_gramian(spark, sf):
    """The normal equations' sums over behaviour, memory, intercept and label."""
    g = learn.gramian(dense(spark, sf))
    cells = [(i + 1, j + 1, float(g[i, j])) for i in range(len(g)) for j in range(i, len(g))]
    return rounded(spark.createDataFrame(cells, "i long, j long, value double"), "value")


@query(
    "head_ridge",
    "select unnest([" + ", ".join(f"'{c}'" for c in [*_COLUMNS, 'intercept']) + "]) as feature, true as stationary, true as iterative_agrees",
)
def head_ridge(spark, sf):
    """The exact tension head: whether each of its normal equations holds on the rows, and whether the iterative head gives the same."""
    rows = dense(spark, sf)
    exact, iterative = learn.fit_ridge(rows), learn.fit_tension(rows)
    g, w = learn.gramian(rows), [*exact.coef[0], exact.bias[0]]
    left = g[:-1, -1] - g[:-1, :-1] @ w  # products of the columns with the residual
    want = [*exact.coef[0], 0.0]
    checks = []
    for i, name in enumerate([*_COLUMNS, "intercept"]):
        close = abs([*iterative.coef[0], iterative.bias[0]][i] - w[i]) <= 0.01 * max(1.0, abs(w[i]))
        checks.append((name, bool(abs(left[i] - want[i]) <= 1e-6 * max(1.0, abs(g[i, -1]))), bool(close)))
    return spark.createDataFrame(checks, "feature string, stationary boolean, iterative_agrees boolean")


@query("baseline_svc")
def baseline_svc(spark, sf):
    rows, terms = designed(spark, sf)
    train = gathered(learn.assemble(rows.filter("split = 'train'"), ["text"]))
    head = learn.fit_binary(train, "sarcasm", F.concat_ws("/", CONV, "message_id"), svc=True)
    model = learn.Model(["text"], terms, {"sarcasm": head} if head else {})
    return learn.apply(learn.assemble(rows, ["text"]), model).select(CONV, "message_id", "split", "sarcasm", "sarcasm_hat")


@query("ablation_metrics")
def ablation_metrics(spark, sf):
    """Sentiment and tension quality on the test split for each feature layout."""
    rows, terms = designed(spark, sf)

    def quality(variant):
        model = learn.fit(rows.filter("split = 'train'"), terms, variant, ("sentiment", "tension"))
        scored = settle(
            learn.apply(learn.assemble(rows.filter("split = 'test'"), learn.BLOCKS[variant]), model).select("sentiment", "sentiment_hat", "tension", "tension_hat"),
            f"scored-{variant}",
        )
        labels = metrics.classification(metrics.confusion(scored, "sentiment", "sentiment_hat")).select(F.lit("sentiment").alias("head"), F.col("f1_macro").alias("value"))
        tension = metrics.regression(scored, "tension", "tension_hat").select(F.lit("tension").alias("head"), F.col("mae").alias("value"))
        return labels.unionByName(tension).withColumn("variant", F.lit(variant))

    return reduce(DataFrame.unionByName, side_by_side(rows, [partial(quality, v) for v in learn.BLOCKS]))


@query("embedding_heads")
def embedding_heads(spark, sf):
    """A label head over given embeddings."""
    from pyspark.ml.functions import array_to_vector

    rows = views.table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    ).withColumn("train", splits.hash_key(F.col("vec_id")) % 10 < 7)
    head = learn.fit_labels(rows.filter("train"), "label")
    return learn.apply(rows, learn.Model([], learn.Terms(), {"label": head})).select("vec_id", "train", "label", "label_hat")


@query(
    "embedding_context",
    """with v as (select vec_id, vec_id // 50 as conversation_id, vec_id % 50 as pos, embedding from embeddings),
n as (select a.conversation_id, a.vec_id, count(b.vec_id) as k, list(b.embedding) as bs from v a left join v b
  on a.conversation_id = b.conversation_id and b.pos between a.pos - 4 and a.pos - 1 group by 1, 2),
e as (select conversation_id, vec_id, k, unnest(range(1, 65)) as i, bs from n),
m as (select conversation_id, vec_id, i, case when k = 0 then 0 else list_sum(list_transform(bs, lambda x: cast(x[i] as double))) / k end as x from e)
select conversation_id, vec_id as message_id, round(sum(x), 5) as total, round(sum(x * i), 4) as weighted, round(sqrt(sum(x * x)), 5) as norm from m group by 1, 2""",
)
def embedding_context(spark, sf):
    """Mean vector of the four messages before each one; the sums show every component and its place."""
    rows = views.table(spark, sf, "embeddings").select(
        F.expr("vec_id div 50").alias(CONV), F.col("vec_id").alias("message_id"), (F.col("vec_id") % 50).alias("pos"), "embedding")
    out = context.pooled(rows)
    total = F.aggregate("context_vector", F.lit(0.0), lambda acc, x: acc + x)
    places = F.transform("context_vector", lambda x, i: x * (i + 1))
    squares = F.transform("context_vector", lambda x: x * x)
    summed = [F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) for c in (places, squares)]
    return out.select(CONV, "message_id", F.round(total, 5).alias("total"), F.round(summed[0], 4).alias("weighted"), F.round(F.sqrt(summed[1]), 5).alias("norm"))


@query("embedding_context_heads", """select unnest(['label', 'high', 'number']) as head, true as no_worse, true as in_bounds""")
def embedding_context_heads(spark, sf):
    """A label, a binary and a tension head over each vector joined with its context: whether they are no worse than their priors, and keep their ranges."""
    from pyspark.ml.functions import array_to_vector

    rows = views.table(spark, sf, "embeddings").select(
        F.expr("vec_id div 50").alias(CONV), F.col("vec_id").alias("message_id"), (F.col("vec_id") % 50).alias("pos"), "embedding", "label")
    rows = context.pooled(rows).select(
        array_to_vector(F.concat(F.col("embedding").cast("array<double>"), F.col("context_vector"))).alias("features"), "message_id",
        F.col("label").cast("string").alias("label"), (F.col("label") >= 1).cast("int").alias("high"), (F.col("label") * 25.0).alias("number"))
    rows = settle(rows, "pooled")
    heads = {"label": learn.fit_labels(rows, "label"), "high": learn.fit_binary(rows, "high", F.col("message_id")), "number": learn.fit_ridge(rows, "number")}
    out = learn.apply(rows, learn.Model([], learn.Terms(), heads))
    n = F.count(F.lit(1))
    most = [r["count"] for r in rows.groupBy("label").count().collect()]
    got = out.agg(
        (F.avg((F.col("label") == F.col("label_hat")).cast("double")) > max(most) / max(sum(most), 1)).alias("label"),
        (F.avg(F.pow(F.col("high") - F.col("high_hat"), 2)) < F.var_pop("high") + 0.02).alias("high"),
        (F.avg(F.pow(F.col("number") - F.col("number_hat"), 2)) < F.var_pop("number")).alias("number"),
        F.bool_and(F.col("high_hat").between(0, 1) & F.col("number_hat").between(0, 100)).alias("fits"), n.alias("n")).first()
    return spark.createDataFrame([(h, bool(got[h]), bool(got["fits"])) for h in heads], "head string, no_worse boolean, in_bounds boolean")


#: Hand-written heads over behaviour and memory, so that SQL can follow the recurrence: tension is ten more than the speaker's mean recent
#: tension; sentiment depends on that mean and on shortness.
_AT = {"heat": len(text.BEHAVIOUR) + 4, "short": text.BEHAVIOUR.index("is_short")}
_SENTIMENT = {"negative": (6.0, 0.5, -1.0), "neutral": (0.0, 0.0, 0.5), "positive": (-3.0, 1.0, 0.25)}  # heat, short, constant


def history_model():
    def row(heat, short):
        out = [0.0] * (len(text.BEHAVIOUR) + 10)
        out[_AT["heat"]], out[_AT["short"]] = heat, short
        return out

    labels = learn.Head("labels", list(_SENTIMENT), [row(a, b) for a, b, _ in _SENTIMENT.values()], [c for _, _, c in _SENTIMENT.values()])
    tension = learn.Head("tension", [], [row(100.0, 0.0)], [10.0])
    return learn.Model(["behaviour", "memory"], learn.Terms(), {"sentiment": labels, "tension": tension})


_Z = {k: f"exp({a} * heat + {b} * is_short + {c})" for k, (a, b, c) in _SENTIMENT.items()}
HISTORY_SQL = f"""{t.GAPS_SQL}, {t.BEHAVE_SQL},
o as (select conversation_id, speaker_id, message_id, is_short, row_number() over (partition by conversation_id, speaker_id order by message_id) as rn from behave),
rec as (select conversation_id, speaker_id, rn, [cast(10 as double)] as five, cast(0 as double) as heat from o where rn = 1
  union all select o.conversation_id, o.speaker_id, o.rn, list_append(five, least(list_avg(five[-5:]) + 10, 100)), list_avg(five[-5:]) / 100
  from rec join o on o.conversation_id = rec.conversation_id and o.speaker_id = rec.speaker_id and o.rn = rec.rn + 1),
z as (select o.*, heat, {', '.join(f'{e} as e_{k}' for k, e in _Z.items())} from o join rec using (conversation_id, speaker_id, rn)),
pr as (select *, e_negative / (e_negative + e_neutral + e_positive) as p_negative, e_positive / (e_negative + e_neutral + e_positive) as p_positive,
  greatest(e_negative, e_neutral, e_positive) as top from z)"""


SEQUENTIAL_SQL = over_messages(f"""{HISTORY_SQL}
select conversation_id, message_id, speaker_id, round(least(heat * 100 + 10, 100), 6) as tension,
 case when e_negative = top then 'negative' when e_neutral = top then 'neutral' else 'positive' end as sentiment,
 round(p_positive, 6) as p_positive, round(p_negative, 6) as p_negative, round(top / (e_negative + e_neutral + e_positive), 6) as sentiment_confidence from pr""")


def sequential_columns(scored):
    numbers = ("tension", "p_positive", "p_negative", "sentiment_confidence")
    return rounded(scored.select(CONV, "message_id", "speaker_id", "tension", "sentiment", "p_positive", "p_negative", "sentiment_confidence"), *numbers)


@query("predict_sequential", SEQUENTIAL_SQL)
def predict_sequential(spark, sf):
    """Scores with the model's own predictions as history, and the probabilities polarity is taken from."""
    return sequential_columns(analyze.score(views.messages(spark, sf).select(CONV, "message_id", "pos", "speaker_id", "ts", "text"), history_model()))


@query("predict_learned", over_messages("select conversation_id, message_id, true as same_labels, true as same_scores, true as in_bounds from messages"))
def predict_learned(spark, sf):
    """The full layout (D: text, context, behaviour, memory) with learned heads on its own history. Its scores have no SQL; the two ways to
    reach them, message by message along a conversation and in sweeps over all messages at once, must agree, and labels must be known."""
    rows, terms = designed(spark, sf)
    model = learn.fit(rows.filter("split = 'train'"), terms, "D", (*learn.MULTI, "sarcasm", "tension"))
    read = settle(rows.select(CONV, "pos", "message_id", "speaker_id", "text", *text.BEHAVIOUR), "read")
    along = learn.predict_sequential(read, model)
    sweeps = learn.predict_by_sweeps(read, model)
    kept = [*learn.MULTI, "tension", *[f"{h}_p" for h in learn.BINARY], *[f"{h}_confidence" for h in learn.MULTI]]
    both = along.join(sweeps.select(CONV, "message_id", *[F.col(c).alias(f"_{c}") for c in kept]), [CONV, "message_id"])
    labels, scores, bounds = F.lit(True), F.lit(True), F.col("tension").between(0, 100)
    for h in learn.MULTI:
        labels = labels & (F.col(h) == F.col(f"_{h}"))
        bounds = bounds & F.map_contains_key(f"{h}_probs", F.col(h)) & F.col(f"{h}_confidence").between(0, 1)
    for c in kept[3:]:
        scores = scores & (F.abs(F.col(c) - F.col(f"_{c}")) < 1e-6)
    for h in learn.BINARY:
        bounds = bounds & F.col(f"{h}_p").between(0, 1)
    return both.select(CONV, "message_id", labels.alias("same_labels"), scores.alias("same_scores"), bounds.alias("in_bounds"))


@query(
    "head_top_classes",
    over_messages(f"""{HISTORY_SQL},
l as (select conversation_id, message_id, unnest(['negative', 'neutral', 'positive']) as label, unnest([e_negative, e_neutral, e_positive]) as e from pr)
select conversation_id, message_id, string_agg(label, ',' order by e desc, label) as top3 from l group by 1, 2"""),
)
def head_top_classes(spark, sf):
    """The likeliest classes of a head, likeliest first."""
    out = analyze.score(views.messages(spark, sf).select(CONV, "message_id", "pos", "speaker_id", "ts", "text"), history_model())
    return out.select(CONV, "message_id", F.array_join(F.transform("sentiment_top3", lambda x: x["label"]), ",").alias("top3"))
