"""N-gram Jaccard join by T-occurrence search: inverted lists, short ones merged, long ones probed by binary search (DivideSkip).

A document's set holds its distinct 3-word shingles (words by white space, A-Z folded); with fewer words the whole sequence is its one
shingle; without words the set is empty and linked with nothing. Two documents link when 100 * intersection >= threshold * union.

1. One scan counts shingles in ``1 << WIDTH`` hashed counters, a second one orders each set by (counter's level, hash), one fixed order
   for all documents, and keeps its first n - T + t shingles, T = ceil(threshold * n / 100), t = 1 + (n - T) / 2. Linked sets share t of
   those (the smaller set's t) whatever the counters hold; they only make the shared ones rare. Equal sets are one class with one
   representative.
2. Inverted lists over these prefixes are split by bands of set size: linked sets are in the same or in adjacent bands. A document that has
   fewer than t shared lists in a band has no partner there. The rest tie documents into groups: only members of one group can link, and
   most documents are in none.
3. Each group is one cell, searched with whole sets: every document is a query that must meet ``T`` of its lists. The longest lists are
   set aside, the others are merged in order, and documents that reach the lowered count are probed in the long ones by binary search. The
   merge sorts the sorted lists' concatenation: a heap in Python gives the same run of places, a hundred times slower.

A cell with more than ``BLOCK`` shingles is cut into blocks and searched by pairs of them, so no task holds more than two blocks (or two
documents). A group is dealt by its inverted lists instead where that sends fewer shingles. Links that a cell already connects are not
repeated.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import U64, binary_rows, chunks, column_bytes, keys, mix, scan, settle, with_row_id
from talkframe.llm.graph import components
from talkframe.llm.neardup import shingle_sets

SHINGLE = 3
WIDTH = 24  # bits of a hashed counter's number: one byte each is broadcast, 16 MiB whatever the input
BLOCK_BITS = 14  # of them, within a block of counters
FILTER_BITS = 24  # of a filter before a shuffle: 262,144 rows of 64 bits at most are broadcast
BLOCK = 500_000  # shingles searched with as many others in one task
PROBES = 16  # lists probed at a time
MU = 0.01  # weight of the longest list's logarithm in the number of lists set aside


def counters(texts: DataFrame, k: int) -> np.ndarray:
    """Level (1 + floor of log2, 0 if unused) of each hashed counter over the distinct shingles of all rows.

    A task sends its counters as compressed blocks; blocks are summed as they stream in, so neither side holds more than one set of them.
    """
    shift = U64(64 - WIDTH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << WIDTH, np.uint32), [], 0

        def add() -> None:
            used, n = np.unique(np.concatenate(held), return_counts=True)
            total[used] += n.astype(np.uint32)

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for low, high in chunks(offsets):
                words = scan(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower=True)
                held.append((shingle_sets(words, k)[0] >> shift).astype(np.int32))
                size += len(held[-1])
                if size > 1 << 20:
                    add()
                    held, size = [], 0
        if held:
            add()
        parts = total.reshape(-1, 1 << BLOCK_BITS)
        for block in np.flatnonzero(parts.any(axis=1)).tolist():
            packed = zlib.compress(parts[block].astype("<u4").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "packed"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist()):
                n = np.frombuffer(zlib.decompress(packed), "<u4")
                total[block] = total[block] + n if block in total else n.astype(np.int64)
        for block, n in total.items():
            level = np.where(n > 0, 1 + np.log2(np.maximum(n, 1)).astype(np.int64), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "packed"])

    kind = "block int, packed binary"
    summed = texts.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add_up, kind).toArrow()
    levels = np.zeros((1 << (WIDTH - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for block, packed in zip(summed.column("block").to_pylist(), summed.column("packed").to_pylist()):
        levels[block] = np.frombuffer(packed, np.uint8)
    return levels.reshape(-1)


def prefixes(docs: DataFrame, threshold: int, k: int) -> DataFrame:
    """One row per document: rid, doc_id, text_key, n_shingles, set_key (digest of the set), prefix (its rarest shingles)."""
    levels = docs.sparkSession.sparkContext.broadcast(counters(docs, k))
    shift = U64(64 - WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for low, high in chunks(offsets):
                words = scan(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower=True)
                sets, first = shingle_sets(words, k)
                n = np.diff(first)
                row = np.repeat(np.arange(high - low), n)
                rank = level[(sets >> shift).astype(np.int64)]
                order = np.argsort(row * 256 + rank, kind="stable")  # sets are sorted in each row
                spare = n + (-threshold * n) // 100
                most = np.where(n > 0, np.minimum(spare + 1 + spare // 2, n), 0)
                taken = order[np.arange(len(order)) - first[row] < most[row]] if len(order) else order
                with np.errstate(over="ignore"):
                    digest = np.zeros((high - low, 2), U64)
                    full = np.flatnonzero(n)
                    for j, m in enumerate(keys(2, 53)):
                        if len(full):
                            digest[full, j] = np.add.reduceat(mix(sets * m + U64(j)), first[full])
                    digest = mix(digest + n.astype(U64)[:, None])
                rows = batch.slice(low, high - low)
                ends = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rid"), rows.column("doc_id"), rows.column("text_key"), pa.array(n.astype(np.int64)),
                     binary_rows(digest.reshape(-1), np.arange(high - low + 1) * 2),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(sets[taken].view(np.int64)))],
                    names=["rid", "doc_id", "text_key", "n_shingles", "set_key", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(docs.select("doc_id", "text", F.md5("text").alias("text_key")))
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, text_key string, n_shingles long, set_key binary, prefix array<long>")


class Lists:
    """Inverted lists of some rows' sets, end to end: each holds the rows' places in ascending order."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, place: np.ndarray):
        self.rows = len(place) + 1
        at = place[owner]
        self.flat = np.sort(ids[at >= 0] * self.rows + at[at >= 0])
        self.post = self.flat % self.rows

    def partners(self, own: np.ndarray, need: int, low: int, high: int, wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, overlaps) of the rows at ``low <= place < high`` that are in ``need`` of the lists ``own``, as far as ``wanted`` keeps them.

        The L = need / (MU * log2(longest list) + 1) longest lists are set aside; a partner occurs in need - L of the others, which are merged
        into one ascending run of places. Who occurs that often is probed in the lists set aside by binary search, some lists at a time,
        until it can't reach ``need`` any more.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, end = np.searchsorted(self.flat, own * self.rows + low), np.searchsorted(self.flat, own * self.rows + high)
        met = end > begin
        if met.sum() < need:
            return none
        own, begin, end = own[met], begin[met], end[met]
        by_length = np.argsort(end - begin, kind="stable")
        longest = int(end[by_length[-1]] - begin[by_length[-1]])
        aside = min(need - 1, int(need / (MU * math.log2(longest + 1) + 1)))
        short, long = by_length[: len(own) - aside], own[by_length[len(own) - aside:]]
        merged = np.sort(np.concatenate([self.post[a:b] for a, b in zip(begin[short].tolist(), end[short].tolist())]), kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        got = np.diff(np.append(heads, len(merged)))
        often = got >= need - aside
        place, got = merged[heads][often], got[often]
        keep = wanted(place)
        place, got = place[keep], got[keep]
        for at in range(0, len(long), PROBES):
            some = long[at:at + PROBES] * self.rows
            keys = some[None, :] + place[:, None]
            got = got + (self.flat[np.minimum(np.searchsorted(self.flat, keys), len(self.flat) - 1)] == keys).sum(axis=1)
            alive = got + max(len(long) - at - PROBES, 0) >= need
            place, got = place[alive], got[alive]
            if not len(place):
                return none
        return place, got


def t_occurrence(sets: np.ndarray, first: np.ndarray, threshold: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Row pairs at the threshold, enough of them to connect whatever is linked; with ``side``, only pairs of different sides.

    Every row that no earlier search reached is a query against all rows of fitting size: an overlap of T = ceil(threshold * size / 100) is
    needed at least. If that leaves several groups, the rows reached are queries in turn, against the rows reached in later groups: rows
    lie group by group then, so a row's own group is never gone through again.
    """
    size = np.diff(first)
    rows = len(size)
    ids = np.unique(sets, return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(rows), size)
    many = np.bincount(ids) > 1 if len(ids) else np.zeros(0, bool)
    label, links = np.arange(rows), []  # of every row's component so far
    searched, reached = np.zeros(rows, bool), np.zeros(rows, bool)

    def search(q: int, lists: Lists, order: np.ndarray, low: int, high: int) -> None:
        n = int(size[q])
        own = ids[first[q]:first[q + 1]]

        def wanted(places: np.ndarray) -> np.ndarray:
            apart = label[order[places]] != label[q]
            return apart if side is None else apart & (side[order[places]] != side[q])

        places, overlaps = lists.partners(own[many[own]], -(-threshold * n // 100), low, high, wanted)
        for r, overlap in zip(order[places].tolist(), overlaps.tolist()):
            if overlap * (100 + threshold) >= threshold * (n + int(size[r])):
                reached[r] = True
                if label[r] != label[q]:
                    label[label == label[r]] = label[q]
                    links.append((q, r))

    order = np.argsort(size, kind="stable")
    sizes, place = size[order], np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    lists = Lists(ids, owner, place)
    for q in order[::-1].tolist():
        if size[q] and not reached[q]:
            searched[q] = True
            need = -(-threshold * int(size[q]) // 100)
            search(q, lists, order, int(np.searchsorted(sizes, need)), int(np.searchsorted(sizes, int(size[q]) * 100 // threshold, side="right")))
    left = np.flatnonzero(reached & ~searched)
    group = label[left]
    if len(np.unique(group)) < 2:
        return links
    by_group = np.lexsort((size[left], group))
    order, group = left[by_group], group[by_group]
    place = np.full(rows, -1)
    place[order] = np.arange(len(order))
    lists = Lists(ids, owner, place)
    ends = np.searchsorted(group, group, side="right")
    for at, q in enumerate(order.tolist()):
        if ends[at] < len(order):
            search(q, lists, order, int(ends[at]), len(order))
    return links


def blocks_of(block: int) -> Column:
    """Blocks of a cell's documents: none is cut, so there are at most as many blocks as documents."""
    return F.least(F.ceil(F.sum("size") / F.lit(block)), F.count("*")).cast("int")


def cells_of(sized: DataFrame, lists: DataFrame, block: int) -> DataFrame:
    """(key, cid, size): each group is one cell, or one cell per inverted list where that sends fewer shingles to the tasks.

    ``sized``: cid, component, size of every document in a group; ``lists``: key, cid.
    """
    whole = sized.groupBy("component").agg((F.sum("size") * blocks_of(block)).alias("_sent"), F.sum("size").alias("_s"))
    large = settle(whole.filter(F.col("_s") > block).select("component", "_sent"), "large")
    listed = lists.join(sized.join(large, "component").select("cid", "component", "size", "_sent"), "cid")
    per_list = listed.groupBy("component", "_sent", "key").agg((F.sum("size") * blocks_of(block)).alias("_l"))
    by_list = settle(per_list.groupBy("component", "_sent").agg(F.sum("_l").alias("_l")).filter("_l < _sent").select("component"), "by-list")
    groups = sized.join(by_list, "component", "left_anti").select(F.col("component").alias("key"), "cid", "size")
    return groups.union(listed.join(by_list, "component", "left_semi").select("key", "cid", "size"))


def found_in_cells(cells: DataFrame, texts: DataFrame, threshold: int, k: int, block: int) -> DataFrame:
    """Links (a, b) inside cells. ``cells``: key, cid, size; ``texts``: cid, text. A cell is cut into blocks, every pair of blocks a group."""
    whole = settle(cells.groupBy("key").agg(blocks_of(block).alias("_of")), "cells")
    spread = (
        cells.join(whole, "key").withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_of")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
        .join(texts, "cid").select("key", "_i", "_j", "_own", "cid", "text")
    )

    def run(group: pa.Table) -> pa.Table:
        cid, own = group.column("cid").to_numpy(), group.column("_own").to_numpy()
        data, offsets = column_bytes(group.column("text"))
        parts, counts = [], []
        for low, high in chunks(offsets):
            words = scan(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower=True)
            sets, first = shingle_sets(words, k)
            parts.append(sets)
            counts.append(np.diff(first))
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        apart = group.column("_i")[0].as_py() != group.column("_j")[0].as_py()
        links = t_occurrence(np.concatenate(parts), first, threshold, own if apart else None)
        a, b = (cid[[pair[i] for pair in links]] for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.repartition("key", "_i", "_j").groupBy("key", "_i", "_j").applyInArrow(run, "a long, b long").distinct()


def sieve(rows: DataFrame, hashed: Column, wanted: DataFrame, wanted_hashed: Column) -> DataFrame:
    """The ``rows`` that may have a partner in ``wanted``: all that have one, and few others.

    A filter of ``FILTER_BITS`` hashed bits, one row per 64 of them, is broadcast: rows without a partner are not shuffled.
    """
    def bit(c: Column) -> Column:
        return c.bitwiseAND((1 << FILTER_BITS) - 1).alias("_h")

    mask, word = F.expr("shiftleft(1L, cast(_h & 63 as int))"), F.expr("_h >> 6").alias("_word")
    words = wanted.select(bit(wanted_hashed)).select(word, mask.alias("_m")).groupBy("_word").agg(F.bit_or("_m").alias("_bits"))
    likely = rows.select("*", bit(hashed)).select("*", word).join(F.broadcast(settle(words, "filter")), "_word")
    return likely.filter(F.col("_bits").bitwiseAND(mask) != 0).drop("_h", "_word", "_bits")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the ``wanted`` (cid, doc_id, text_key) documents."""
    key = F.xxhash64("doc_id", "text_key")
    source = docs.select("doc_id", "text", F.md5("text").alias("text_key"))
    likely = sieve(source, key, wanted, key)
    same = (likely["text_key"] == wanted["text_key"]) & likely["doc_id"].eqNullSafe(wanted["doc_id"])
    return likely.join(wanted, same).select("cid", "text").dropDuplicates(["cid"])  # rows may repeat an id and a text


def jaccard_links(docs: DataFrame, threshold: int = 90, k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Equal sets are linked. Null doc_ids are ignored as component ids unless a component has no other; repeated rows are one component.
    Null, empty and blank texts have no set and are their own component. Texts of any length are taken whole. An empty table gives an
    empty result. Only ``doc_id`` and ``text`` are read, so other columns cannot clash. Sets are compared by 64-bit hashes of their
    shingles and classes by 128-bit digests. Runs jobs while it is built; its steps are written to the shared folder.
    """
    sig = settle(prefixes(docs, threshold, k), "sets")
    cls = settle(sig.filter("n_shingles > 0").groupBy("set_key").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first_id")), "classes")
    reps = settle(sig.drop("set_key").join(cls.select(F.col("cid").alias("rid")), "rid", "left_semi"), "representatives")
    size = F.col("size")
    other = F.expr(f"(size * {threshold} + 99) div 100")  # the smallest partner's size, whose t counts
    least = F.lit(1) + F.floor((other - F.expr(f"((size * {threshold} + 99) div 100 * {threshold} + 99) div 100")) / 2)
    listed = reps.select(F.explode("prefix").alias("token"), F.col("rid").alias("cid"), F.col("n_shingles").alias("size"))
    shared = listed.groupBy("token").agg(F.count("*").alias("_n")).filter("_n > 1").select("token")
    # settled, as below, so that joins deal both sides anew and adaptive execution can split a long list
    shared = settle(shared, "shared")
    rows = settle(sieve(listed, F.xxhash64("token"), shared, F.xxhash64("token")).join(shared, "token"), "shared-lists")
    enough = rows.groupBy("cid", "size").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("cid")
    band = F.floor(F.log(size.cast("double")) / F.lit(math.log(100 / threshold) * (1 + 1e-9))).cast("int")
    lists = rows.join(settle(enough, "enough"), "cid", "left_semi").withColumn("band", F.explode(F.array(band, band + 1)))
    lists = settle(lists.select(F.xxhash64("token", "band").alias("key"), "band", "cid", "size"), "lists")
    met = settle(lists.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"), "met")
    lists = settle(lists.join(met, "key"), "met-lists")
    enough = lists.groupBy("cid", "size", "band").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("cid", "band")
    lists = settle(lists.join(settle(enough, "enough"), ["cid", "band"], "left_semi").drop("band"), "lists")
    heads = settle(lists.groupBy("key").agg(F.count("*").alias("_n"), F.min("cid").alias("b")).filter("_n > 1").drop("_n"), "heads")
    lists = settle(lists.join(heads, "key"), "tied-lists")
    tied = settle(components(lists.select(F.col("cid").alias("a"), "b").filter("a <> b").distinct()), "tied")
    sized = settle(tied.join(reps.select(F.col("rid").alias("node"), F.col("n_shingles").alias("size"), "doc_id", "text_key"), "node"), "candidates")
    members = sized.select(F.col("node").alias("cid"), "component", "size")
    cells = settle(cells_of(members, lists.select("key", "cid"), block), "placed")
    texts = settle(texts_of(docs, sized.select(F.col("node").alias("cid"), "doc_id", "text_key")), "texts")
    links = settle(found_in_cells(cells, texts, threshold, k, block), "links")
    label = components(links).withColumnRenamed("node", "cid")
    named = cls.join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    whole = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = settle(named.join(settle(whole, "whole"), "component").select("set_key", "component_id"), "named")
    out = sig.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
