"""Secrets by fixed patterns and, beyond them, by two character Markov models compared by log-likelihood ratio.

Base patterns give spans of assigned values, access keys and long hexadecimal runs. Their values are the samples labelled random; all
other tokens of ``LEAST`` characters or more, of all documents, are the samples labelled ordinary: words, paths, numbers, dates. Counts of
neighbouring characters of both, combined map-side, make one table of log ratios. Every such token, of whatever characters, is scored by
its summed log ratio and added from ``threshold`` on. The sum grows with the length, so short tokens need a clearer ratio per character,
and an ordinary token passes with a probability of exp(-threshold) at most, as far as the model of ordinary ones holds. Everything is a
Spark expression: texts are only cut by regular expressions, positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import whole_row

THRESHOLD = 12.0  # summed log-likelihood ratio: one ordinary token in 160,000 at most
LEAST = 10  # characters of a scored token; random ones below it cannot be told with this certainty
CODES = 128
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # maximal runs: a shorter one has no longer one inside
HEX = r"[0-9a-f]{32,}"
TOKEN = rf"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_]{{{LEAST},}}={{0,2}}"  # a hyphen joins words, so it parts tokens
_SPANS = "array<struct<start:int,end:int,kind:int,value:string>>"


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """(start, end, kind, value) of the leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    Positions are the summed lengths of the pieces between matches and of the matches before.
    """
    p = F.lit(pattern)
    whole, value = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step)["out"]).otherwise(none)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (null as empty) and ``_base``, the spans of the fixed patterns."""
    text = F.col("_text")
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn(
        "_base", F.concat(found(text, ASSIGN, 0, group=2, least=8), found(text, ACCESS, 1), found(text, HEX, 2)))


def _pairs(tokens: DataFrame) -> DataFrame:
    """(a, b, n): counts of neighbouring ASCII characters of the column ``token``, combined map-side."""
    each = tokens.select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    codes = each.select(F.ascii(F.expr("substring(token, i, 1)")).alias("a"), F.ascii(F.expr("substring(token, i + 1, 1)")).alias("b"))
    return codes.filter((F.col("a") < CODES) & (F.col("b") < CODES)).groupBy("a", "b").agg(F.count("*").alias("n"))


def train(docs: DataFrame) -> list[float]:
    """Log ratio of P(b | a) in random and in ordinary strings, at a * 128 + b. At most 128 * 128 counts reach the driver."""
    rows = with_base(docs.select("text")).withColumn("_tokens", found(F.col("_text"), TOKEN, 3))
    random = _pairs(rows.select(F.explode("_base.value").alias("token")).filter("length(token) > 1"))
    ordinary = _pairs(rows.select(F.explode(_alone("_tokens")["value"]).alias("token")))
    counts = [[0] * (CODES * CODES) for _ in range(2)]
    for side, a, b, n in random.select(F.lit(0), "a", "b", "n").union(ordinary.select(F.lit(1), "a", "b", "n")).collect():
        counts[side][a * CODES + b] = n
    alphabet = [c for c in range(CODES) if chr(c).isalnum() or chr(c) in "+/_.=-"]
    out = [0.0] * (CODES * CODES)
    for a in alphabet:
        total = [sum(side[a * CODES + b] for b in alphabet) for side in counts]
        for b in alphabet:
            r, o = ((side[a * CODES + b] + 1) / (t + len(alphabet)) for side, t in zip(counts, total))
            out[a * CODES + b] = round(math.log(r) - math.log(o), 6)
    return out


def _alone(spans: str) -> Column:
    """The spans that overlap no base span."""
    return F.filter(F.col(spans), lambda x: ~F.exists("_base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))


def _ratio(token: Column, table: Column) -> Column:
    """Summed log ratio of the token's character pairs."""
    codes = F.transform(F.split(token, ""), F.ascii)
    total = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda acc, c: F.struct(
        c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * CODES + c))).alias("sum")))
    return total["sum"]


def scan_secrets(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, end, kind, value), ordered by start and kind; ends are exclusive.

    ``spans`` holds every base span and the added ``markov`` tokens that overlap none. Null and empty texts have none; texts of any length
    are scanned whole. Existing columns of these names are replaced, all others stay whatever their names; rows are independent, so
    repeated ones get the same spans; an empty table gives an empty result. ``ratios`` are trained on
    ``docs`` when not given.
    """
    ratios = train(docs) if ratios is None else ratios
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    whole = docs.select("text", whole_row(docs).alias("_row"))
    rows = with_base(whole).withColumn("_more", F.filter(found(F.col("_text"), TOKEN, 3), lambda x: _ratio(x["value"], table) >= threshold))
    rows = rows.select("_row", F.array_sort("_base", _order).alias("base"), F.array_sort(F.concat("_base", _alone("_more")), _order).alias("spans"))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("base", "spans")]
    return rows.select(*kept, "base", "spans")


def _order(x: Column, y: Column) -> Column:
    def key(s: Column) -> Column:
        return s["start"].cast("long") * len(KINDS) + s["kind"]
    return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)


def listed(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
