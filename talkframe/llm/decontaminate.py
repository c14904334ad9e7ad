"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, each text scanned once.

Words are runs of 0-9, A-Z (folded) and everything outside ASCII. A window is ``WINDOW`` consecutive words of an item, or
the whole item when it has fewer. The automaton's alphabet is the benchmark's own vocabulary: a document word outside it
resets the scan. Hits are word ranges and are mapped back to character offsets of the original text.

The automaton is built in the workers from benchmark rows that the driver hands out, at most ``limit_bytes`` of text
at a time. A larger benchmark is cut into parts by a hash of its rows; the documents are then scanned once per part, the
documents with hits are written to the shared folder and merged, so memory stays bounded and no item is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkframe.llm.common import ALNUM, chunks, column_bytes, scan, settle, whole_row

WINDOW = 13
LIMIT_BYTES = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[int, "Automaton"] = {}


class Automaton:
    """Windows of (item_id, text) rows as sequences of vocabulary numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        texts = [(t or "").encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        w = scan(np.frombuffer(b"".join(texts), np.uint8), offsets, ALNUM, lower=True)
        self.vocabulary = np.unique(w.hash)
        number = np.searchsorted(self.vocabulary, w.hash) + 1
        windows: dict[tuple[int, ...], list[int]] = {}
        for i in range(len(items)):
            seq = tuple(number[w.first[i]:w.first[i + 1]].tolist())
            for a in range(max(1, len(seq) - WINDOW + 1) if seq else 0):
                held = windows.setdefault(seq[a:a + WINDOW], [])
                if not held or held[-1] != i:
                    held.append(i)
        self.ids = [item for item, _ in items]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, found in windows.items():
            self.auto.add_word(seq, (len(seq), found))
        self.auto.make_automaton()
        self.least = min(map(len, windows), default=1)
        self.empty = not windows

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of document words; 0 for words the benchmark does not have."""
        if self.empty:
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def search(self, seq: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges [s, e) inside any window occurrence, and the rows of the items found."""
        spans, items = [], set()
        for end, (size, found) in self.auto.iter(tuple(seq.tolist())):
            spans.append((end + 1 - size, end + 1))
            items.update(found)
        merged: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, items


def _automaton(shared: Broadcast) -> Automaton:
    """Built once per worker process and benchmark part."""
    key = hash(tuple(shared.value))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value)
    return _BUILT[key]


def _scan_part(docs: DataFrame, items: list, hits_only: bool, carry: bool = False) -> DataFrame:
    """doc_id, key, n_words, word and character ranges, and item ids, of every document or of those with a hit; with ``carry`` the
    whole row as ``_row``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ["_row"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for low, high in chunks(offsets):
                part = offsets[low:high + 1] - offsets[low]
                raw = data[offsets[low]:offsets[high]]
                w = scan(raw, part, ALNUM, lower=True)
                known = auto.number(w.hash)
                ranges, chars, ids = [], [], []
                possible = _long_runs(known, w.row, auto.least, high - low)
                for r in range(high - low):
                    spans, found = auto.search(known[w.first[r]:w.first[r + 1]]) if possible[r] else ([], set())
                    ranges.append(spans)
                    ids.append(sorted({auto.ids[i] for i in found if auto.ids[i] is not None}))
                    if spans:
                        at = [m.span() for m in WORD.finditer(raw[part[r]:part[r + 1]].tobytes().decode())]
                        chars.append([(at[s][0], at[e - 1][1]) for s, e in spans])
                    else:
                        chars.append([])
                rows = batch.slice(low, high - low)
                keep = pa.array(np.array([bool(x) for x in ranges]) if hits_only else np.ones(high - low, bool))
                pairs = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                as_rows = lambda v: pa.array([[{"s": s, "e": e} for s, e in x] for x in v], pairs)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("key"), pa.array(w.counts().astype(np.int64)), as_rows(ranges), as_rows(chars),
                     pa.array(ids, pa.list_(pa.string())), *[rows.column(c) for c in extra]],
                    names=["doc_id", "key", "n_words", "words", "spans", "items", *extra]).filter(keep)

    pairs = "array<struct<s:int,e:int>>"
    rows = docs.select("doc_id", "text", F.md5("text").alias("key"), *[whole_row(docs).alias(c) for c in extra])
    made = StructType.fromDDL(f"doc_id {kind}, key string, n_words long, words {pairs}, spans {pairs}, items array<string>")
    return rows.mapInArrow(run, StructType([*made.fields, *[rows.schema[c] for c in extra]]))


def _long_runs(known: np.ndarray, row: np.ndarray, least: int, rows: int) -> np.ndarray:
    """Rows with at least ``least`` vocabulary words on end: only they can hold a window."""
    out = np.zeros(rows, bool)
    hit = known > 0
    if not hit.any():
        return out
    cut = np.ones(len(hit), bool)
    cut[1:] = (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(hit)))
    out[row[at[(size >= least) & hit[at]]]] = True
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, limit_bytes: int = LIMIT_BYTES, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, key (md5 of the text), n_words, words and spans (merged ranges of words and of characters
    of the original), items (ids found, as strings, sorted), n_hit, contaminated; with ``carry`` also the whole row as ``_row``.

    ``contaminated``: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and are clean; items without
    words have no window; an item without id counts as a hit but is not listed; items that share an id are one item. With an
    empty benchmark every document is clean. Only ``doc_id``, ``text`` and ``item_id``, ``text`` are read.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // limit_bytes))
    turn = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    found = []
    for p in range(parts):
        rows = [tuple(r) for r in items.filter(turn == p).orderBy("id", "text").collect()]  # at most about limit_bytes
        found.append(_scan_part(docs, rows, hits_only=p > 0, carry=carry and p == 0))
    out = found[0]
    if parts > 1:
        more = settle(found[1], "hits")
        for f in found[2:]:
            more = more.union(settle(f, "hits"))
        # rows equal in id and text have the same hits: one row of each part is enough
        more = more.dropDuplicates(["doc_id", "key", "items", "words"]).groupBy("doc_id", "key").agg(
            *[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("words", "spans", "items")])
        same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.key").eqNullSafe(F.col("r.key"))
        both = out.alias("l").join(more.alias("r"), same, "left")
        out = both.select("l.doc_id", "l.key", "l.n_words", *(["l._row"] if carry else []), *[
            F.when(F.col(f"_{c}").isNull(), F.col(f"l.{c}")).otherwise(
                F.array_sort(F.array_distinct(F.concat(f"l.{c}", f"_{c}"))) if c == "items" else _merged(F.concat(f"l.{c}", f"_{c}"))
            ).alias(c) for c in ("words", "spans", "items")])
    hit = F.aggregate("words", F.lit(0).cast("bigint"), lambda n, x: n + x["e"] - x["s"])
    out = out.withColumn("n_hit", hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def _merged(ranges: F.Column) -> F.Column:
    """Overlapping ranges joined, in order. Ranges of characters overlap exactly where those of words do."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    return F.aggregate(F.array_sort(ranges), empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] > x["s"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                 F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
    ).otherwise(F.concat(acc, F.array(x))))
