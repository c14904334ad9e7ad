"""Queries over evaluation measures and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe import views
from talkframe.operators import metrics, records, splits
from talkframe.operators import sequence as seq
from talkframe.queries.aggregates import rounded
from talkframe.queries.registry import over_signals, query

CONV = "conversation_id"
HASH_SQL = """
hk as (select conversation_id, ((((cast(concat('0x', substr(md5(cast(conversation_id as varchar)), 1, 16)) as ubigint) % 100000000)::hugeint
    * 9551616) + (cast(concat('0x', substr(md5(cast(conversation_id as varchar)), 17, 16)) as ubigint) % 100000000)::hugeint) % 100000000)::bigint as h
  from (select distinct conversation_id from {src}) x),
hr as (select conversation_id, row_number() over (order by h, conversation_id) - 1 as rk, count(*) over () as n from hk),
split as (select conversation_id, case when rk < floor(n * cast(0.7 as double)) then 'train'
   when rk < floor(n * cast(0.7 as double)) + floor(n * cast(0.15 as double)) then 'val' else 'test' end as split from hr)"""
CLASS_SQL = """
cls as (select gold as label from {c} union select pred from {c}),
pc as (select label, sum(case when gold = label and pred = label then n else 0 end) as tp,
  sum(case when gold <> label and pred = label then n else 0 end) as fp,
  sum(case when gold = label and pred <> label then n else 0 end) as fn from cls, {c} group by 1),
pm as (select tp + fn as support, tp, case when tp + fp = 0 then 0 else tp / (tp + fp) end as p,
  case when tp + fn = 0 then 0 else tp / (tp + fn) end as r, 2 * tp / (2 * tp + fp + fn) as f from pc),
cm as (select round(sum(tp) / sum(support), 6) as accuracy, round(avg(p), 6) as precision, round(avg(r), 6) as recall,
 round(avg(f), 6) as f1_macro, round(sum(support * f) / sum(support), 6) as f1_weighted from pm)"""
_CM = ("accuracy", "precision", "recall", "f1_macro", "f1_weighted")


@query(
    "clf_metrics",
    over_signals(f"""conf as (select emotion as gold, pred_emotion as pred, count(*) as n from signals group by 1, 2),
{CLASS_SQL.format(c='conf').strip()}
select * from cm"""),
)
def clf_metrics(spark, sf):
    return rounded(metrics.classification(metrics.confusion(views.signals(spark, sf), "emotion", "pred_emotion")), *_CM)


@query(
    "escalation_f1",
    over_signals(f"""conf as (select cast(gold_tension >= 60 as integer) as gold, cast(tension >= 60 as integer) as pred, count(*) as n from signals group by 1, 2),
{CLASS_SQL.format(c='conf').strip()}
select * from cm"""),
)
def escalation_f1(spark, sf):
    rows = views.signals(spark, sf).select((F.col("gold_tension") >= 60).cast("int").alias("g"), (F.col("tension") >= 60).cast("int").alias("p"))
    return rounded(metrics.classification(metrics.confusion(rows, "g", "p")), *_CM)


@query(
    "confusion_matrix",
    over_signals("""
c as (select emotion as gold, pred_emotion as pred, count(*) as n from signals group by 1, 2)
select gold, pred, n, round(n / sum(n) over (partition by gold), 6) as share,
 case when gold <> pred then cast(row_number() over (partition by gold <> pred order by n desc, gold, pred) as integer) end as error_rank from c"""),
)
def confusion_matrix(spark, sf):
    return rounded(metrics.confusion_matrix(views.signals(spark, sf), "emotion", "pred_emotion"), "share")


@query(
    "reg_metrics",
    over_signals("""
select round(avg(abs(tension - gold_tension)), 6) as mae, round(sqrt(avg((tension - gold_tension) ** 2)), 6) as rmse,
 round(1 - avg((tension - gold_tension) ** 2) / var_pop(gold_tension), 6) as r2 from signals"""),
)
def reg_metrics(spark, sf):
    return rounded(metrics.regression(views.signals(spark, sf), "gold_tension", "tension"), "mae", "rmse", "r2")


AUC_SQL = """
r as (select y, (rank() over (order by s) + rank() over (order by s) + count(*) over (partition by s) - 1) / 2 as ar from x),
a as (select (sum(ar) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2)
  / (count(*) filter (y) * count(*) filter (not y)) as auc from r)
select round(auc, 6) as auc from a"""


@query("roc_auc", over_signals("x as (select gold = 1 as y, p as s from signals)," + AUC_SQL))
def roc_auc(spark, sf):
    return rounded(metrics.ranking_auc(views.signals(spark, sf), F.col("gold") == 1, F.col("p")), "auc")


@query("valence_auc", over_signals("x as (select sentiment = 'negative' as y, tension as s from signals where sentiment <> 'neutral')," + AUC_SQL))
def valence_auc(spark, sf):
    rows = views.signals(spark, sf).filter(F.col("sentiment") != "neutral")
    return rounded(metrics.ranking_auc(rows, F.col("sentiment") == "negative", F.col("tension")), "auc")


@query(
    "avg_precision",
    over_signals("""
c as (select p as s, sum(gold) as pos, count(*) as n from signals group by 1),
w as (select pos, sum(pos) over (order by s desc) as tp, sum(n) over (order by s desc) as al from c)
select round(sum(pos * (tp / al)) / sum(pos), 6) as ap from w"""),
)
def avg_precision(spark, sf):
    return rounded(metrics.average_precision(views.signals(spark, sf), F.col("gold") == 1, F.col("p")), "ap")


@query(
    "brier",
    over_signals("select round(avg((least(greatest(p, 1e-6), 1 - 1e-6) - gold) ** 2), 6) as brier from signals"),
)
def brier(spark, sf):
    return rounded(metrics.brier(views.signals(spark, sf), F.col("gold") == 1, F.col("p")), "brier")


def _bins_sql(bins: int) -> str:
    probs = ", ".join(f"cast({i} as double) / {bins}" for i in range(bins + 1))
    return f"""
e as (select list_sort(list_distinct(quantile_cont(confidence, [{probs}]))) as e from signals),
b as (select cast(len(list_filter(e[2:-2], lambda x: x <= confidence)) as integer) as bin, confidence as c,
   case when emotion = pred_emotion then 1 else 0 end as ok from signals, e),
g as (select bin, count(*) as n, avg(c) as mc, avg(ok) as acc from b group by 1)"""


@query(
    "calibration",
    over_signals(_bins_sql(10).strip() + """
select round(sum(abs(acc - mc) * n) / sum(n), 9) as ece, round(max(abs(acc - mc)), 9) as mce,
 round(sum(mc * n) / sum(n), 9) as mean_confidence, round(sum(acc * n) / sum(n), 9) as accuracy, cast(sum(n) as bigint) as n from g"""),
)
def calibration(spark, sf):
    out = metrics.calibration(views.signals(spark, sf), F.col("emotion") == F.col("pred_emotion"), "confidence")
    # The means are whole multiples of 5e-7 here, so six decimals would sit on rounding ties.
    return out.withColumns({c: F.round(c, 9) for c in ("ece", "mce", "mean_confidence", "accuracy")})


@query(
    "reliability",
    over_signals(_bins_sql(8).strip() + "\nselect bin, n, round(mc, 6) as mean_confidence, round(acc, 6) as accuracy from g"),
)
def reliability(spark, sf):
    out = metrics.reliability(views.signals(spark, sf), F.col("emotion") == F.col("pred_emotion"), "confidence", 8)
    return rounded(out, "mean_confidence", "accuracy")


AGREE_SQL = """with x as (select cast(quality as varchar) as a, cast(1 - toxic as varchar) as b from labels),
m as (select lab, sum(a) as a, sum(b) as b from (select a as lab, 1 as a, 0 as b from x union all select b, 0, 1 from x) u group by 1),
t as (select (select avg(case when a = b then 1 else 0 end) from x) as po, (select count(*) from x) as n,
  sum(a * b) / (select count(*) ** 2 from x) as pe, sum((a + b) ** 2) / (select 4 * count(*) ** 2 from x) as pp from m)"""


def _coders(spark, sf):
    rows = views.table(spark, sf, "labels").select(F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))
    return metrics.agreement(metrics.confusion(rows, "a", "b"))


@query(
    "cohen_kappa",
    AGREE_SQL + """ select round(po, 6) as observed, round(pe, 6) as expected,
 round(case when abs(1 - pe) < 1e-12 then 0 else (po - pe) / (1 - pe) end, 6) as kappa, n from t""",
)
def cohen_kappa(spark, sf):
    return rounded(_coders(spark, sf).drop("alpha"), "observed", "expected", "kappa")


@query(
    "kripp_alpha",
    AGREE_SQL + """ select round(case when abs(1 - pp) < 1e-12 then 0 else (po - pp) / (1 - pp) end, 6) as alpha,
 round(po, 6) as observed, n from t""",
)
def kripp_alpha(spark, sf):
    return rounded(_coders(spark, sf).select("alpha", "observed", "n"), "alpha", "observed")


def independence_sql(src: str, head: str) -> str:
    """Tables o_, t_, s_ and p_<head>: chi-square of split against one head's labels in ``src``."""
    return f"""o_{head} as (select {head}, count(*) filter (split = 'train') as a, count(*) filter (split = 'val') as b, count(*) filter (split = 'test') as c from {src} group by 1),
t_{head} as (select sum(a) as na, sum(b) as nb, sum(c) as nc, cast(sum(a + b + c) as double) as n, count(*) as k from o_{head}),
s_{head} as (select sum(a * a * n / ((a + b + c) * na) + b * b * n / ((a + b + c) * nb) + c * c * n / ((a + b + c) * nc)) - any_value(n) as chi2,
  cast((any_value(k) - 1) * 2 as bigint) as dof,
  max(greatest(abs(a / na - (a + b + c) / n), abs(b / nb - (a + b + c) / n), abs(c / nc - (a + b + c) / n))) as dev from o_{head}, t_{head}),
p_{head} as (select *, dev < cast(0.06 as double) and pv > cast(0.01 as double) as ok from
 (select *, exp(-chi2 / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: (chi2 / 2) ** i / factorial(cast(i as integer)))) as pv from s_{head}) q)"""


@query(
    "chi2_split",
    over_signals(HASH_SQL.format(src="signals").strip() + f""",
x as (select emotion, split from signals join split using (conversation_id)), {independence_sql("x", "emotion")}
select round(chi2, 6) as chi2, dof, round(pv, 6) as p_value, round(dev, 6) as max_deviation, ok from p_emotion"""),
)
def chi2_split(spark, sf):
    out = metrics.split_independence(splits.with_split(views.signals(spark, sf)), "emotion")
    return rounded(out, "chi2", "p_value", "max_deviation")


@query(
    "split_balance",
    over_signals(HASH_SQL.format(src="signals").strip() + """,
x as (select tension as v, split from signals join split using (conversation_id)),
m as (select avg(v) filter (split = 'train') as ma, avg(v) filter (split = 'test') as mb, var_samp(v) filter (split = 'train') as va,
  var_samp(v) filter (split = 'test') as vb, count(*) filter (split = 'train') as na, count(*) filter (split = 'test') as nb from x),
c as (select v, count(*) filter (split = 'train') as a, count(*) filter (split = 'test') as b from x group by 1),
w as (select sum(a) over (order by v) as ca, sum(b) over (order by v) as cb from c),
k as (select max(abs(ca / na - cb / nb)) as ks from w, m),
d as (select *, (mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) as d from m, k)
select round(d, 6) as cohens_d, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(sqrt(va * (na - 1) / na), 6) as sd_a, round(sqrt(vb * (nb - 1) / nb), 6) as sd_b,
 round(ks, 6) as ks, round(case when ks * sqrt(na * nb / (na + nb)) < cast(0.1 as double) then 1 else list_sum(list_transform(range(1, 101),
   lambda j: (case when j % 2 = 1 then 2 else -2 end) * exp(-2 * j * j * ks * ks * na * nb / (na + nb)))) end, 6) as ks_p_value,
 abs(d) < cast(0.2 as double) as passed from d"""),
)
def split_balance(spark, sf):
    out = metrics.split_balance(splits.with_split(views.signals(spark, sf)), "tension")
    return rounded(out, "cohens_d", "mean_a", "mean_b", "sd_a", "sd_b", "ks", "ks_p_value")


@query(
    "chi2_two_splits",
    over_signals(HASH_SQL.format(src="signals").strip() + """,
x as (select speaker_id as label, split from signals join split using (conversation_id) where split in ('train', 'test')),
c as (select label, split, count(*) as n from x group by 1, 2),
t as (select *, sum(n) over (partition by label) as k, sum(n) over (partition by split) as s, sum(n) over () as total from c),
chi as (select sum(n * cast(n as double) * total / (cast(k as double) * s)) - any_value(total) as chi2, max(abs(n / s - k / total)) as dev from t),
z as (select *, sqrt(chi2 / 2) as z from chi),
tail as (select *, 2 / sqrt(pi()) * cast(8 as double) / 4000 / 3 * list_sum(list_transform(range(0, 4001),
  lambda i: (case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-((z + i * cast(8 as double) / 4000) ** 2)))) as p from z)
select round(chi2, 6) as chi2, cast(1 as bigint) as dof, round(p, 6) as p_value, round(dev, 6) as max_deviation,
 dev < cast(0.06 as double) and p > cast(0.01 as double) as ok from tail"""),
)
def chi2_two_splits(spark, sf):
    """Two splits and two labels: one degree of freedom, an odd number."""
    out = metrics.split_independence(splits.with_split(views.signals(spark, sf)), "speaker_id", ("train", "test"))
    return rounded(out.withColumn("dof", F.col("dof").cast("bigint")), "chi2", "p_value", "max_deviation")


@query(
    "mcnemar",
    over_signals("""
c as (select count(*) filter (emotion <> pred_emotion and sentiment = pred_sentiment) as b,
  count(*) filter (emotion = pred_emotion and sentiment <> pred_sentiment) as c from signals),
l as (select b, c, b + c as n, unnest(range(0, least(b, c) + 1)) as i from c),
p as (select b, c, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) as t from l group by 1, 2)
select b as a_wrong_b_right, c as a_right_b_wrong, b + c as discordant, round(least(1, 2 * t), 6) as p_value from p"""),
)
def mcnemar(spark, sf):
    rows = views.signals(spark, sf)
    out = metrics.mcnemar(rows, F.col("emotion") == F.col("pred_emotion"), F.col("sentiment") == F.col("pred_sentiment"))
    return rounded(out, "p_value")


@query(
    "bootstrap_delta",
    over_signals("""select round((count(*) filter (not a and b) - count(*) filter (a and not b)) / count(*), 6) as delta, cast(2000 as bigint) as n_boot,
 round(count(*) filter (not a and b) / count(*) - count(*) filter (a and not b) / count(*) - cast(1.959964 as double) * stddev_pop(cast(b as int) - cast(a as int)) / sqrt(count(*)), 6) as normal_low,
 true as near_normal
from (select emotion = pred_emotion as a, sentiment = pred_sentiment as b from signals) x"""),
)
def bootstrap_delta(spark, sf):
    """Accuracy difference, and whether its resampled interval agrees with the normal one to within a fifth of its width."""
    rows = views.placed_signals(spark, sf)
    a, b = F.col("emotion") == F.col("pred_emotion"), F.col("sentiment") == F.col("pred_sentiment")
    spread = rows.agg(F.stddev_pop(b.cast("int") - a.cast("int")).alias("s"), F.count(F.lit(1)).alias("n")).select(
        (F.lit(1.959964) * F.col("s") / F.sqrt("n")).alias("half"), F.lit(1).alias("one"))
    out = metrics.bootstrap_delta(rows, a, b).withColumn("one", F.lit(1)).join(spread, "one")
    near = F.greatest(F.abs(F.col("delta") - F.col("half") - F.col("low")), F.abs(F.col("delta") + F.col("half") - F.col("high"))) < 0.4 * F.col("half")
    return out.select(F.round("delta", 6).alias("delta"), "n_boot", F.round(F.col("delta") - F.col("half"), 6).alias("normal_low"), near.alias("near_normal"))


@query(
    "lexical_ceiling",
    over_signals(HASH_SQL.format(src="signals").strip() + f""",
x as (select concat(event_type, '-', event_id % 9) as u, pred_sentiment as lab, split from signals join split using (conversation_id)),
mj as (select u, lab, row_number() over (partition by u order by count(*) desc, lab) as rk from x where split = 'train' group by 1, 2),
conf as (select x.lab as gold, coalesce(mj.lab, 'neutral') as pred, count(*) as n from x left join mj on mj.u = x.u and rk = 1
  where split = 'test' group by 1, 2),
{CLASS_SQL.format(c='conf').strip()}
select * from cm"""),
)
def lexical_ceiling(spark, sf):
    rows = splits.with_split(views.signals(spark, sf)).select(
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 9).cast("string")).alias("u"), F.col("pred_sentiment").alias("lab"), "split"
    )
    counts = rows.groupBy("split", "u", "lab").agg(F.count(F.lit(1)).alias("n"))
    best = seq.top_k(counts.filter("split = 'train'"), ["u"], [F.col("n").desc(), F.col("lab")], 1).select("u", F.col("lab").alias("pred"))
    test = counts.filter("split = 'test'").join(best, "u", "left").withColumn("pred", F.coalesce("pred", F.lit("neutral")))
    pairs = test.groupBy(F.col("lab").alias("gold"), "pred").agg(F.sum("n").alias("n"))
    return rounded(metrics.classification(pairs), *_CM)


@query(
    "flip_rates",
    over_signals("""
x as (select concat(event_type, '-', event_id % 20) as u, user_id % 2 as c, max_by(pred_emotion, event_id) as e, max_by(pred_sentiment, event_id) as s,
   max_by(gold, event_id) as g from signals group by 1, 2),
f as (select u, count(*) as k, count(distinct e) as e, count(distinct s) as s, count(distinct g) as g from x group by 1)
select round(avg(case when k = 2 and e = 2 then 1 else 0 end), 6) as emotion, round(avg(case when k = 2 and s = 2 then 1 else 0 end), 6) as sentiment,
 round(avg(case when k = 2 and g = 2 then 1 else 0 end), 6) as sarcasm, count(*) as n_utterances from f"""),
)
def flip_rates(spark, sf):
    rows = views.signals(spark, sf)
    last = rows.groupBy(
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 20).cast("string")).alias("u"),
        F.when(F.col("user_id") % 2 == 0, "benign").otherwise("tense").alias("condition"),
    ).agg(F.max(F.struct("event_id", "pred_emotion", "pred_sentiment", "gold")).alias("last"))
    sides = last.groupBy("u").pivot("condition", ["benign", "tense"]).agg(F.first("last"))
    def flips(c):
        return F.avg(F.coalesce(F.col(f"benign.{c}") != F.col(f"tense.{c}"), F.lit(False)).cast("double"))
    out = sides.agg(flips("pred_emotion").alias("emotion"), flips("pred_sentiment").alias("sentiment"), flips("gold").alias("sarcasm"),
                    F.count(F.lit(1)).alias("n_utterances"))
    return rounded(out, "emotion", "sentiment", "sarcasm")


_FIVE = ["neutral", "confusion", "joy", "excitement", "anger"]


@query(
    "topk_accuracy",
    over_signals("""
l as (select event_id, emotion, unnest(['neutral', 'confusion', 'joy', 'excitement', 'anger']) as lab, unnest([31, 37, 41, 43, 47]) as c from signals),
r as (select event_id, emotion, lab, row_number() over (partition by event_id order by cast((event_id * c) % 97 as double) / 97 desc, lab) as rk from l),
h as (select event_id, max(case when rk = 1 and lab = emotion then 1 else 0 end) as e, max(case when rk <= 3 and lab = emotion then 1 else 0 end) as k from r group by 1)
select round(avg(e), 6) as exact, round(avg(k), 6) as top_k, count(*) as n from h"""),
)
def topk_accuracy(spark, sf):
    probs = F.create_map(*[x for lab, c in zip(_FIVE, (31, 37, 41, 43, 47)) for x in (F.lit(lab), ((F.col("event_id") * c) % 97).cast("double") / 97)])
    rows = views.signals(spark, sf).select("emotion", probs.alias("probabilities"))
    return rounded(metrics.top_k_accuracy(rows, "emotion", "probabilities"), "exact", "top_k")


@query(
    "model_compare",
    over_signals(HASH_SQL.format(src="signals").strip() + """,
x as (select split, unnest(['before', 'after']) as model, unnest([case when event_id % 3 = 0 then 'neutral' else emotion end, pred_emotion]) = emotion as hit,
  sentiment, tension from signals join split using (conversation_id)),
g as (select split as evaluated_on, avg(case when hit then 1 else 0 end) filter (model = 'before') as before,
  avg(case when hit then 1 else 0 end) filter (model = 'after') as after, count(*) // 2 as n from x group by 1)
select evaluated_on, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as delta, n from g"""),
)
def model_compare(spark, sf):
    rows = splits.with_split(views.signals(spark, sf))
    before = F.when(F.col("event_id") % 3 == 0, "neutral").otherwise(F.col("emotion"))
    models = F.array(F.struct(F.lit("before").alias("model"), before.alias("label")), F.struct(F.lit("after").alias("model"), F.col("pred_emotion").alias("label")))
    long = rows.select(F.col("split").alias("evaluated_on"), "emotion", F.inline(models))
    wide = long.groupBy("evaluated_on").pivot("model", ["before", "after"]).agg(
        F.avg((F.col("label") == F.col("emotion")).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n")
    )
    out = wide.select("evaluated_on", F.col("before_acc").alias("before"), F.col("after_acc").alias("after"),
                      (F.col("after_acc") - F.col("before_acc")).alias("delta"), F.col("after_n").alias("n"))
    return rounded(out, "before", "after", "delta")


@query(
    "probe_metrics",
    over_signals(f"""x as (select sentiment as gold, pred_sentiment as pred, count(*) as n from signals where event_id % 5 = 0 group by 1, 2),
{CLASS_SQL.format(c='x').strip()}
select * from cm"""),
)
def probe_metrics(spark, sf):
    """Sentiment quality on the probe turns alone."""
    marked = views.signals(spark, sf).withColumn("is_probe", F.when(F.col("event_id") % 5 == 0, True))
    return rounded(metrics.classification(metrics.confusion(records.probe_turns(marked), "sentiment", "pred_sentiment")), *_CM)


@query(
    "model_select",
    over_signals(HASH_SQL.format(src="signals").strip() + """,
x as (select split, emotion, pred_emotion as p0, case when event_id % 3 = 0 then 'neutral' else emotion end as p1, 'neutral' as p2 from signals join split using (conversation_id)),
m as (select unnest([0, 1, 2]) as place, unnest(['head', 'fallback', 'constant']) as model, unnest([p0, p1, p2]) = emotion as hit, split from x),
a as (select place, model, avg(case when hit then 1 else 0 end) filter (split = 'val') as val, avg(case when hit then 1 else 0 end) filter (split = 'test') as test from m group by 1, 2)
select model, round(val, 6) as val, round(test, 6) as test, row_number() over (order by val desc, place) = 1 as selected from a"""),
)
def model_select(spark, sf):
    """The model that does best on validation rows, with its test accuracy."""
    rows = splits.with_split(views.signals(spark, sf)).select(
        "split", "emotion", F.col("pred_emotion").alias("head"), F.when(F.col("event_id") % 3 == 0, "neutral").otherwise(F.col("emotion")).alias("fallback"),
        F.lit("neutral").alias("constant"))
    return rounded(metrics.select_on_validation(rows, "emotion", ["head", "fallback", "constant"]), "val", "test")
