"""Exact removal of repeated passages: prefix-partitioned suffix trees over word suffixes.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window that also starts anywhere else
goes. Only suffixes at *anchors* are kept: the ``PREFIX``-word gram with the smallest hash of its window. Equal windows
have their anchor at the same offset, so every repeated window shows as two suffixes with a common prefix, and about
one position in fourteen is an anchor.

1. Suffixes are partitioned by their prefix gram. Grams that occur once end there.
2. Suffixes whose whole context (everything a window around the anchor can reach) is equal are one leaf with a count,
   counted map-side: copies and the inside of repeated passages need no tree at all.
3. The other leaves of a prefix form one subtree. Its nodes are numbered depth by depth, to the right and to the left
   of the anchor; a window is repeated where the two nodes that delimit it hold more than one leaf (a deep internal node).
4. A prefix with more than ``leaves`` leaves is split by the longest prefix there is, the whole window: its windows are
   counted by a 128-bit digest instead.

Texts are written once into a table bucketed by row, so both joins back to the text move only positions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import U64, Words, chunks, column_bytes, grams, keys, mix, scan, settle, with_row_id
from talkframe.session import work_dir

WINDOW, PREFIX = 35, 8
LEFT, RIGHT = WINDOW - PREFIX, WINDOW  # words of context before an anchor, and from it on
LEAVES = 100_000
BATCH = 10_000  # contexts held at once; a subtree with more leaves is held whole


def bucketed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text) written once, bucketed by rid: joins on rid need no exchange of the texts."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"passages_{uuid.uuid4().hex}"
    rows = with_row_id(docs.select("doc_id", "text"))
    rows.repartition(n, "rid").write.bucketBy(n, "rid").option("path", work_dir(spark, "passages")).saveAsTable(name)
    return spark.table(name)


def _slide(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i:i+size] for every full slice, by doubling."""
    span, acc = 1, x
    while span * 2 <= size:
        acc = pick(acc[:-span], acc[span:])
        span *= 2
    rest = size - span
    return pick(acc[: len(acc) - rest], acc[rest:]) if rest else acc


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, gram hash) of the grams that are smallest in some window; ties all count."""
    n, per = len(w.hash), WINDOW - PREFIX + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g, ok = grams(w, PREFIX)
    g = np.where(ok, g | U64(1), U64(0xFFFFFFFFFFFFFFFF))
    low = _slide(g[: n - PREFIX + 1], per, np.minimum)  # one per window start
    low = np.where(w.row[: n - WINDOW + 1] == w.row[WINDOW - 1:], low, U64(0))
    padded = np.concatenate([np.zeros(per - 1, U64), low, np.zeros(per - 1, U64)])
    best = _slide(padded, per, np.maximum)  # over the windows that hold gram i
    at = np.flatnonzero(best == g[: len(best)])
    return at, g[at]


def contexts(w: Words, at: np.ndarray) -> np.ndarray:
    """Word hashes from LEFT before each anchor to RIGHT from it on; 0 outside the document."""
    idx = at[:, None] + np.arange(-LEFT, RIGHT)
    inside = (idx >= w.first[w.row[at]][:, None]) & (idx < w.first[w.row[at] + 1][:, None])
    return np.where(inside, w.hash[np.clip(idx, 0, len(w.hash) - 1)], U64(0))


def suffixes(texts: DataFrame) -> DataFrame:
    """(rid, at, gram, ctx) of every anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = keys(LEFT + RIGHT, 53)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            for low, high in chunks(offsets):
                w = scan(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                at, g = anchors(w)
                ctx = np.empty(len(at), U64)
                for a in range(0, len(at), BATCH):  # a text that repeats one word has an anchor at every word
                    with np.errstate(over="ignore"):
                        ctx[a:a + BATCH] = mix((contexts(w, at[a:a + BATCH]) * weights).sum(axis=1, dtype=U64))
                row = w.row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[low:high][row]), pa.array((at - w.first[row]).astype(np.int32)), pa.array(g.view(np.int64)),
                     pa.array(ctx.view(np.int64))], names=["rid", "at", "gram", "ctx"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, at int, gram long, ctx long")


def leaf_contexts(texts: DataFrame, leaves: DataFrame) -> DataFrame:
    """The words around each leaf: (gram, big, copies, rid, at, words)."""
    wanted = leaves.groupBy("rid").agg(F.collect_list(F.struct("at", "gram", "copies", "big")).alias("leaf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            lists = batch.column("leaf")
            begin = lists.offsets.to_numpy()
            flat = lists.values
            at_all, gram = flat.field("at").to_numpy(), flat.field("gram").to_numpy()
            copies, big = flat.field("copies").to_numpy(), flat.field("big").to_numpy(zero_copy_only=False)
            rid = batch.column("rid").to_numpy()
            for low, high in chunks(offsets):
                w = scan(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                take = slice(begin[low], begin[high])
                row = np.repeat(np.arange(high - low), np.diff(begin[low:high + 1]))
                for a in range(0, len(row), BATCH):
                    part, rows = slice(take.start + a, min(take.start + a + BATCH, take.stop)), row[a:a + BATCH]
                    words = contexts(w, w.first[rows] + at_all[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[part]), pa.array(big[part]), pa.array(copies[part]), pa.array(rid[low:high][rows]),
                         pa.array(at_all[part]), pa.array([x.tobytes() for x in words], pa.binary())],
                        names=["gram", "big", "copies", "rid", "at", "words"])

    rows = texts.select("rid", "text").join(wanted, "rid")
    return rows.mapInArrow(run, "gram long, big boolean, copies long, rid long, at int, words binary")


def _words(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    data, _ = column_bytes(batch.column("words"))
    return data.view(U64).reshape(-1, LEFT + RIGHT)


def _deeper(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Children of tree nodes by the next word."""
    with np.errstate(over="ignore"):
        edge = mix(node.astype(U64) * U64(0x9E3779B97F4A7C15) + word)
    return np.unique(edge, return_inverse=True)[1]


def _windows(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(words before the anchor, rows that have such a window)."""
    left, right = (words[:, :LEFT] != 0).sum(axis=1), (words[:, LEFT:] != 0).sum(axis=1)
    for before in range(LEFT + 1):
        yield before, np.flatnonzero((left >= before) & (right >= WINDOW - before))


def subtree_repeats(gram: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(leaf, words before the anchor) flags: the window starting there belongs to a node with several leaves."""
    node = np.unique(gram, return_inverse=True)[1]
    right = [node]
    for depth in range(PREFIX, WINDOW):
        right.append(_deeper(right[-1], words[:, LEFT + depth]))
    left = [node]
    for depth in range(LEFT):
        left.append(_deeper(left[-1], words[:, LEFT - 1 - depth]))
    out = np.zeros((len(gram), LEFT + 1), bool)
    for before, rows in _windows(words):
        if len(rows):
            cls = _deeper(right[WINDOW - before - PREFIX][rows], left[before][rows].astype(U64))
            out[rows, before] = np.bincount(cls)[cls] > 1
    return out


def subtrees(leaves: DataFrame) -> DataFrame:
    """Covered word ranges (rid, s, e) of leaves that stand for one suffix, from complete subtrees, a batch at a time."""
    def covered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        single = t.column("copies").to_numpy() == 1
        flags = subtree_repeats(t.column("gram").to_numpy(), _words(t)) & single[:, None]
        row, before = np.nonzero(flags)
        rid, at = t.column("rid").to_numpy()[row], t.column("at").to_numpy()[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(rid), pa.array((at - before).astype(np.int32)), pa.array((at - before + WINDOW).astype(np.int32))], names=["rid", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            while len(gram) and sum(b.num_rows for b in held) + batch.num_rows >= BATCH:
                last = int(np.searchsorted(gram, gram[-1]))  # the final prefix may go on in the next batch
                if last == 0 and held and held[-1].column("gram")[-1].as_py() != gram[0]:
                    yield covered(held)
                    held = []
                    continue
                if last == 0:
                    break
                yield covered([*held, batch.slice(0, last)])
                held, batch, gram = [], batch.slice(last), gram[last:]
                break
            held.append(batch)
        if held:
            yield covered(held)

    ordered = leaves.select("gram", "copies", "rid", "at", "words").repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "rid long, s int, e int")


def window_counts(leaves: DataFrame) -> DataFrame:
    """The same ranges for crowded prefixes: every window of a leaf is a row, counted by its digest map-side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [keys(WINDOW, s) for s in (61, 67)]
        for batch in batches:
            words = _words(batch)
            gram, rid, at, copies = (batch.column(c).to_numpy() for c in ("gram", "rid", "at", "copies"))
            for before, rows in _windows(words):
                part = words[rows, LEFT - before:LEFT - before + WINDOW]
                with np.errstate(over="ignore"):
                    # a window may hold several anchors: it is counted once for each, never across them
                    place = mix(gram[rows].view(U64) + U64(before))
                    k1, k2 = (mix((part * m).sum(axis=1, dtype=U64) + place).view(np.int64) for m in weights)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), pa.array(rid[rows]), pa.array((at[rows] - before).astype(np.int32)), pa.array(copies[rows])],
                    names=["k1", "k2", "rid", "s", "copies"])

    rows = leaves.mapInArrow(run, "k1 long, k2 long, rid long, s int, copies long")
    twice = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.filter("copies = 1").join(twice, ["k1", "k2"]).select("rid", "s", (F.col("s") + WINDOW).alias("e"))


def repeated_ranges(docs: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(rid, doc_id, text, ranges): word ranges [s, e) that repeated windows cover, null where there are none."""
    texts = bucketed(docs)
    rows = settle(suffixes(texts), "suffixes")
    often = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("_lo"), F.max("ctx").alias("_hi")).filter("n > 1")
    # settled, so that the join deals both sides anew and adaptive execution can split a frequent gram
    often = settle(often.select("gram", (F.col("_lo") != F.col("_hi")).alias("mixed")), "grams")
    shared = settle(rows.join(often, "gram"), "shared")
    leaf = shared.filter("mixed").groupBy("gram", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "at")).alias("_p"))
    leaf = settle(leaf.select("gram", "ctx", "copies", "_p.rid", "_p.at"), "leaves")
    width = settle(leaf.groupBy("gram").agg((F.count("*") > leaves).alias("big")), "widths")
    found = leaf_contexts(texts, leaf.join(width, "gram"))
    if not width.filter("big").isEmpty():
        found = settle(found, "contexts")
        spans = subtrees(found.filter("not big")).union(window_counts(found.filter("big")))
    else:
        spans = subtrees(found)
    copied = leaf.filter("copies > 1").select("gram", "ctx")
    full = shared.filter("not mixed").select("rid", "at").union(shared.filter("mixed").join(copied, ["gram", "ctx"], "left_semi").select("rid", "at"))
    full = full.select("rid", F.greatest(F.col("at") - LEFT, F.lit(0)).alias("s"), (F.col("at") + RIGHT).alias("e"))
    ranges = full.union(spans).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    return texts.join(ranges, "rid", "left")


def strip_repeats(docs: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Documents under 35 words, empty and null texts lose nothing (a null text gives no words and an empty ``kept``). Repeated
    rows are documents of their own and so repeat each other. An empty table gives an empty result. Only ``doc_id`` and
    ``text`` are read. Runs jobs while it is built.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ranges")
            data, offsets = column_bytes(batch.column("text"))
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            begin = lists.offsets.to_numpy()
            s, e = lists.values.field("s").to_numpy(), lists.values.field("e").to_numpy()
            total, removed, kept = [], [], []
            for r in range(batch.num_rows):
                words = data[offsets[r]:offsets[r + 1]].tobytes().split()
                n, gone = len(words), 0
                if known[r] and begin[r] < begin[r + 1]:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, s[begin[r]:begin[r + 1]], 1)
                    np.add.at(edge, np.minimum(e[begin[r]:begin[r + 1]], n), -1)
                    cover = np.cumsum(edge[:n]) > 0
                    gone = int(cover.sum())
                    words = [words[i] for i in np.flatnonzero(~cover)]
                total.append(n)
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    found = repeated_ranges(docs, leaves).select("doc_id", "text", "ranges")
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
