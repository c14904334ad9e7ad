"""Document quality by fixed rules and a learned decision list.

``measure`` computes whole-text features in one scan. ``learn`` grows an ordered list of rules for low quality by sequential covering:
a conjunction of thresholds is grown on two thirds of the uncovered rows by information gain, pruned on the other third, and kept
while it is right more often than not; the rows it covers are taken out and the next rule is grown. The list becomes one ordered Spark
conditional expression, so applying it needs no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import SPACE, Words, chunks, column_bytes, grams, scan

SAMPLE = 20_000  # labelled rows learned from at most, by a hash of their id
SPAN = 8  # words of a repeated passage
THRESHOLDS = 64  # quantiles tried per feature
MAX_RULES, MAX_TERMS = 24, 4
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate", "mark_rate", "line_words"]
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _flag(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOLS, DIGITS, UPPER = _flag("#*$%&|<>"), _flag("0123456789"), _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
MARKS, HEADS = _flag("!?.,;:"), (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[fresh], minlength=rows)


def repeated_words(w: Words, rows: int) -> np.ndarray:
    """Words of each row inside ``SPAN``-word windows that the row has twice or more."""
    g, ok = grams(w, SPAN)
    at = np.flatnonzero(ok)
    order = at[np.lexsort((g[at], w.row[at]))]
    same = (g[order[1:]] == g[order[:-1]]) & (w.row[order[1:]] == w.row[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(w.hash) + 1, np.int64)
    edge[order[twice]] += 1
    edge[order[twice] + SPAN] -= 1
    # ends of several windows may meet the start of others; each start and each end is one window's, so += on unique indices is exact
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(w.row[covered], minlength=rows)


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    w = scan(data, offsets)
    n = w.counts()
    heads = HEADS[data]
    word_chars = _per_row(heads & ~SPACE[data], offsets)
    lines = scan(data, offsets, NEWLINE)
    words_in = np.searchsorted(w.starts, lines.ends) - np.searchsorted(w.starts, lines.starts)
    real = words_in > 0
    n_lines = np.bincount(lines.row[real], minlength=rows)
    dup = n_lines - _distinct(lines.row[real], lines.hash[real], rows)
    counts = [n, word_chars, _per_row(SYMBOLS[data], offsets), dup, repeated_words(w, rows)]
    chars = np.maximum(word_chars, 1)
    rate = [
        word_chars / np.maximum(n, 1), counts[2] / chars, dup / np.maximum(n_lines, 1), counts[4] / np.maximum(n, 1),
        _distinct(w.row, w.hash, rows) / np.maximum(n, 1), _per_row(UPPER[data], offsets) / chars, _per_row(DIGITS[data], offsets) / chars,
        _per_row(MARKS[data], offsets) / chars, n / np.maximum(n_lines, 1),
    ]
    return np.column_stack([*counts, *rate]).astype(np.float64)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, ``COUNTS`` (long) and ``RATES`` (double) of every whole text; null texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for low, high in chunks(offsets):
                x = _features(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                cols = [pa.array(x[:, i].astype(np.int64) if i < len(COUNTS) else x[:, i]) for i in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), *cols], names=["doc_id", *COUNTS, *RATES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATES])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


@dataclass(frozen=True)
class Rule:
    """Low quality where every (feature, above, threshold) holds: value >= threshold if above, else value <= threshold."""

    terms: tuple[tuple[str, bool, float], ...]
    right: int
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.terms:
            out = out & (F.col(name) >= t if above else F.col(name) <= t)
        return out

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.terms:
            out &= x[name] >= t if above else x[name] <= t
        return out


def cover(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 17) -> list[Rule]:
    """Ordered rules for ``low`` rows by sequential covering."""
    turn = np.random.default_rng(seed).random(len(low))
    left = np.ones(len(low), bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and (low & left).sum() >= 3:
        grow, prune = left & (turn < 2 / 3), left & (turn >= 2 / 3)
        terms = _grow(x, low, grow)
        while len(terms) > 1 and _worth(terms[:-1], x, low, prune) >= _worth(terms, x, low, prune):
            terms = terms[:-1]
        if not terms or _worth(terms, x, low, prune) <= 0:
            break
        hit = Rule(tuple(terms), 0, 0).rows(x) & left
        rules.append(Rule(tuple(terms), int((hit & low).sum()), int(hit.sum())))
        left &= ~hit
    return rules


def _worth(terms: list, x: dict[str, np.ndarray], low: np.ndarray, rows: np.ndarray) -> float:
    hit = Rule(tuple(terms), 0, 0).rows(x) & rows
    p, n = (hit & low).sum(), (hit & ~low).sum()
    return float((p - n) / max(1, p + n))


def _grow(x: dict[str, np.ndarray], low: np.ndarray, rows: np.ndarray) -> list[tuple[str, bool, float]]:
    terms: list[tuple[str, bool, float]] = []
    now = rows.copy()
    while len(terms) < MAX_TERMS and (now & ~low).any():
        p0, n0 = (now & low).sum(), (now & ~low).sum()
        if not p0:
            return []
        best, gain = None, 1e-9
        for name, value in x.items():
            v, y = value[now], low[now]
            for t in np.unique(np.quantile(v[y], np.linspace(0, 1, THRESHOLDS))):
                for above in (True, False):
                    hit = v >= t if above else v <= t
                    p, n = (hit & y).sum(), (hit & ~y).sum()
                    g = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                    if g > gain:
                        best, gain = (name, above, float(t)), g
        if best is None:
            break
        terms.append(best)
        name, above, t = best
        now &= x[name] >= t if above else x[name] <= t
    return terms


def learn(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE, excluded: Column | None = None) -> list[Rule]:
    """Rules from at most ``sample`` labelled rows; rows where ``excluded`` (over the labels) holds are never learned from."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if excluded is not None:
        known = known.filter(~excluded)
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select("doc_id", F.col("quality").alias("_label"))
    # at most ``sample`` rows of two numbers: small enough to broadcast by construction; one measured row for each
    seen = measured.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id", "_label"]).orderBy("doc_id", "_label").toPandas()
    if seen.empty or seen["_label"].nunique() < 2:
        return []
    names = [c for c in [*COUNTS, *RATES] if c != "word_chars"]
    return cover({c: seen[c].to_numpy(float) for c in names}, seen["_label"].to_numpy() == 0)


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, or null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(rules[i].column(), F.lit(i)).otherwise(out)
    return out


def judged(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """``measured`` with base_failed (n_words < 20 or 100 * n_repeat_words > 30 * n_words), rule (first learned rule that holds) and kept.

    Empty and null texts fail. Rows are independent, so repeated rows get equal verdicts; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measured.withColumn("base_failed", failed).withColumn("rule", decision(rules)).withColumn("kept", ~failed & F.col("rule").isNull())
