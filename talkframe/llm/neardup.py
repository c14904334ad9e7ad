"""Near-duplicate documents by b-bit MinHash: bands of full minima propose, packed low bits estimate, full sets decide.

A document's set holds its distinct 5-word shingles (words by white space, A-Z folded); with fewer words the whole
sequence is its one shingle; without words the set is empty and linked with nothing.

1. One scan takes ``BANDS * ROWS`` minima per document, hashes them by band and keeps ``BITS`` low bits of each,
   packed. Documents with equal sets fall into one class by a 128-bit digest, so exact copies never meet in a bucket.
2. Each bucket of a band proposes only (member, smallest member). Proposals are confirmed on full shingle sets.
3. Buckets that still span several components are searched for links across them, block by block: rare shingles find the
   pairs, sizes and the corrected bit estimate (dropped when ``SLACK`` below the threshold) thin them, full sets decide.

A link at the threshold shares no band with probability (1 - 0.75^4)^32 < 6e-6; the estimate drops one only if it is
more than six standard deviations low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import U64, Words, binary_rows, chunks, column_bytes, grams, keys, mix, scan, settle, with_row_id
from talkframe.llm.graph import components

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 4
SLACK = 0.26
BLOCK = 300_000  # shingles of a bucket that one group compares with as many others
MEMBERS = 256  # texts compared with one leader in a task


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, with row offsets."""
    g, ok = grams(w, k)
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < k))
    value, row = g[ok], w.row[ok]
    if len(short):
        at = w.first[short]
        with np.errstate(over="ignore"):
            whole = np.array([mix(np.sum(w.hash[a:a + m] * keys(int(m), 11), keepdims=True) + U64(m))[0]
                              for a, m in zip(at, n[short])], U64)
        value, row = np.concatenate([value, whole]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def minima(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, BANDS * ROWS) minima; rows with an empty set get the largest value."""
    out = np.full((len(first) - 1, BANDS * ROWS), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    x, at = (sets >> U64(32)).astype(np.uint32), first[full]
    low = sets.astype(np.uint32)
    for i, m in enumerate(keys(BANDS * ROWS, 23)):
        v = x * np.uint32(m >> U64(32) | U64(1))
        v ^= v >> np.uint32(15)
        v *= np.uint32(m & U64(0xFFFFFFFF) | U64(1))
        v ^= low
        out[full, i] = np.minimum.reduceat(v, at)
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """Low ``BITS`` bits of every minimum, packed into 64-bit words row by row."""
    per = 64 // BITS
    low = (mins & np.uint32((1 << BITS) - 1)).astype(U64).reshape(len(mins), -1, per)
    return (low << (np.arange(per, dtype=U64) * U64(BITS))).sum(axis=2, dtype=U64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (broadcast over leading axes), corrected for chance matches of ``BITS`` bits."""
    diff = a ^ b
    lanes = U64(int("0" * (BITS - 1) + "1", 2) * (((1 << 64) - 1) // ((1 << BITS) - 1)))
    any_bit = diff.copy()
    for s in range(1, BITS):
        any_bit |= diff >> U64(s)
    differ = np.bitwise_count(any_bit & lanes).sum(axis=-1)
    match, chance = 1 - differ / (BANDS * ROWS), 2.0 ** -BITS
    return (match - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: rid, doc_id, text_key, n_shingles, set_key (digest of the set), bands, bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for low, high in chunks(offsets):
                part = offsets[low:high + 1] - offsets[low]
                sets, first = shingle_sets(scan(data[offsets[low]:offsets[high]], part, lower=True))
                n = np.diff(first)
                mins = minima(sets, first)
                with np.errstate(over="ignore"):
                    digest = np.zeros((high - low, 2), U64)
                    full = np.flatnonzero(n)
                    for j, m in enumerate(keys(2, 31)):
                        if len(full):
                            digest[full, j] = np.add.reduceat(mix(sets * m + U64(j)), first[full])
                    digest = mix(digest + n.astype(U64)[:, None])
                    grouped = mins.reshape(len(mins), BANDS, ROWS).astype(U64)
                    band = mix((grouped * keys(ROWS, 41)).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))
                some = np.where(n > 0, BANDS, 0)
                ends = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rid"), rows.column("doc_id"), rows.column("text_key"), pa.array(n.astype(np.int64)),
                     binary_rows(digest.reshape(-1), np.arange(high - low + 1) * 2),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(band[n > 0].reshape(-1).view(np.int64))),
                     binary_rows(pack(mins).reshape(-1), np.arange(high - low + 1) * (BANDS * ROWS * BITS // 64))],
                    names=["rid", "doc_id", "text_key", "n_shingles", "set_key", "bands", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(docs.select("doc_id", "text", F.md5("text").alias("text_key")))
    return rows.mapInArrow(
        run, f"rid long, doc_id {kind}, text_key string, n_shingles long, set_key binary, bands array<long>, bits binary"
    )


def likely(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose corrected bit estimate is not ``SLACK`` below the threshold."""
    side = reps.select(F.col("rid").alias("cid"), "bits")
    both = pairs.join(side.select(F.col("cid").alias("a"), F.col("bits").alias("bits_a")), "a")
    both = both.join(side.select(F.col("cid").alias("b"), F.col("bits").alias("bits_b")), "b").select("a", "b", "bits_a", "bits_b")
    words = BANDS * ROWS * BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (column_bytes(batch.column(c))[0].view(U64).reshape(-1, words) for c in ("bits_a", "bits_b"))
            ok = estimate(x, y) >= threshold / 100 - SLACK
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union. ``texts``: one (cid, text) row per class.

    Each member's text travels to its leader's task; a leader with many members is repeated for every ``MEMBERS`` of them.
    """
    sent = pairs.select("a", "b").distinct()
    load = sent.groupBy("b").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("parts"))
    routed = sent.join(load, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    members = routed.select(F.col("b").alias("to"), "part", F.col("a").alias("cid"), F.lit(1).alias("role"))
    leaders = load.select(F.col("b").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                          F.col("b").alias("cid"), F.lit(0).alias("role"))
    rows = members.union(leaders).join(texts, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, np.zeros(0, U64)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            to, part = batch.column("to").to_numpy(), batch.column("part").to_numpy()
            role, cid = batch.column("role").to_numpy(), batch.column("cid").to_numpy()
            a, b = [], []
            for low, high in chunks(offsets):
                sets, first = shingle_sets(scan(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower=True))
                for r in range(low, high):
                    s = sets[first[r - low]:first[r - low + 1]]
                    if role[r] == 0:
                        own, mine = (to[r], part[r]), s
                    elif own == (to[r], part[r]):
                        shared = 0
                        if 100 * min(len(s), len(mine)) >= threshold * max(len(s), len(mine)):
                            at = np.searchsorted(mine, s)
                            at[at == len(mine)] = 0
                            shared = int((mine[at] == s).sum()) if len(mine) else 0
                        if shared and 100 * shared >= threshold * (len(s) + len(mine) - shared):
                            a.append(cid[r])
                            b.append(to[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = rows.repartition("to", "part").sortWithinPartitions("to", "part", "role")
    return ordered.mapInArrow(run, "a long, b long")


def remaining(members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links across components inside a bucket. ``members``: key, cid, component, size, bits; ``texts``: cid, text.

    A bucket is cut into blocks of about ``BLOCK`` shingles and every pair of blocks is one group, so no task holds a bucket. Inside
    a group two sets at the threshold must share one of their rarest shingles (as many as a set may lack, and one more): documents
    that only share a common passage never become a pair. Bit estimates and full sets decide the rest, and pairs that links of the
    same group already connect are skipped.
    """
    whole = settle(members.groupBy("key").agg(F.ceil(F.sum("size") / F.lit(BLOCK)).cast("int").alias("_of")), "blocks")
    spread = (
        members.join(whole, "key").join(texts, "cid").withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_of")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
        .select("key", "_i", "_j", "cid", "component", "bits", "text")
    )
    words = BANDS * ROWS * BITS // 64

    def run(group: pa.Table) -> pa.Table:
        cid, comp = group.column("cid").to_numpy(), group.column("component").to_numpy()
        bits = column_bytes(group.column("bits"))[0].view(U64).reshape(-1, words)
        data, offsets = column_bytes(group.column("text"))
        a, b = block_links(*_all_sets(data, offsets), comp, bits, threshold)
        return pa.table({"a": pa.array(cid[a], pa.int64()), "b": pa.array(cid[b], pa.int64())})

    # dealt by the block pair: by the key alone, which the join leaves behind, a bucket would stay in one task
    return spread.repartition("key", "_i", "_j").groupBy("key", "_i", "_j").applyInArrow(run, "a long, b long").distinct()


def _all_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts, counts = [], []
    for low, high in chunks(offsets):
        sets, first = shingle_sets(scan(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower=True))
        parts.append(sets)
        counts.append(np.diff(first))
    if not parts:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def block_links(sets: np.ndarray, first: np.ndarray, comp: np.ndarray, bits: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Row pairs at the threshold that join different components, enough of them to connect whatever is linked."""
    ids, count = np.unique(sets, return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ids = rank[ids]  # rare shingles first
    size = np.diff(first)
    root = {int(c): int(c) for c in np.unique(comp)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = [np.sort(ids[first[r]:first[r + 1]]) for r in range(len(size))]
    posted: dict[int, dict[int, list[int]]] = {}  # shingle -> component -> rows, so a component's own rows are never gone through
    left, right = [], []
    least = threshold / 100 - SLACK
    for r in np.argsort(size, kind="stable").tolist():
        n = int(size[r])
        if not n:
            continue
        prefix = rows[r][: n - -(-n * threshold // 100) + 1].tolist()
        own = find(int(comp[r]))
        met = np.array(sorted({x for s in prefix for c, held in posted.get(s, {}).items() if find(c) != own for x in held}), np.int64)
        if len(met):
            met = met[100 * size[met] >= threshold * n]
            met = met[estimate(bits[met], bits[r]) >= least] if len(met) else met
        for x in met.tolist():
            p, q = find(int(comp[x])), find(int(comp[r]))
            if p == q:
                continue
            shared = len(np.intersect1d(rows[x], rows[r], assume_unique=True))
            if 100 * shared >= threshold * (n + int(size[x]) - shared):
                root[max(p, q)] = min(p, q)
                left.append(r)
                right.append(x)
        for s in prefix:
            posted.setdefault(s, {}).setdefault(int(comp[r]), []).append(r)
    return left, right


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """One row per document: rid, doc_id, text_key, n_shingles, component_id (smallest doc_id reachable), keep (one row per component).

    Null doc_ids are ignored as component ids unless a component has no other; repeated rows are one component of which
    one row is kept. Documents without words are their own component and kept. An empty table gives an empty result.
    Only ``doc_id`` and ``text`` are read. Runs jobs while it is built: signatures, candidate texts and the rounds of the
    component search are written to the shared folder.
    """
    sig = settle(signatures(docs), "minhash")
    cls = settle(
        sig.filter("n_shingles > 0").groupBy("set_key")
        .agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first_id")), "classes"
    )
    reps = sig.join(cls.select(F.col("cid").alias("rid")), "rid", "left_semi")
    bands = reps.select(F.explode("bands").alias("key"), F.col("rid").alias("cid"))
    # settled, as below, so that joins deal both sides anew and adaptive execution can split a crowded key
    crowded = settle(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("leader")).filter("n > 1"), "crowded")
    members = settle(bands.join(crowded, "key"), "buckets")
    # cid -> text: one row of the class, found again by its id and text
    wanted = reps.join(members.select(F.col("cid").alias("rid")).distinct(), "rid", "left_semi")
    source = docs.select(F.col("doc_id").alias("_d"), "text", F.md5("text").alias("_k"))
    wanted = wanted.select(F.col("rid").alias("cid"), F.col("doc_id").alias("_wd"), "text_key")
    found = source.join(wanted, (F.col("_k") == F.col("text_key")) & F.col("_d").eqNullSafe(F.col("_wd"))).select("cid", "text")
    texts = settle(found.dropDuplicates(["cid"]) if _repeats(sig) else found, "candidates")
    star = members.filter("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b"))
    edges = settle(confirmed(likely(star.distinct(), reps, threshold), texts, threshold), "links")
    labels = components(edges)
    placed = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi")
    mixed = settle(mixed.select("key"), "mixed")
    open_rows = placed.join(mixed, "key", "left_semi").select("key", "cid", "component")
    open_rows = open_rows.join(reps.select(F.col("rid").alias("cid"), F.col("n_shingles").alias("size"), "bits"), "cid")
    more = settle(remaining(open_rows, texts, threshold), "links")
    if not more.isEmpty():
        labels = components(edges.union(more))
    named = cls.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    whole = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "cid")).alias("_m"))
    named = settle(named.join(settle(whole, "whole"), "component").select("set_key", "component_id", F.col("_m.cid").alias("_head")), "named")
    out = sig.select("rid", "doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    # the class that holds the smallest id keeps its first row with that id
    heads = sig.join(named.filter(F.col("_head").isNotNull()), "set_key").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("_head").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("_keep"))
    return out.join(heads, "rid", "left").select(
        "rid", "doc_id", "text_key", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | F.coalesce("_keep", F.lit(False))).alias("keep"),
    )


def _repeats(sig: DataFrame) -> bool:
    """Whether a (doc_id, text) pair occurs in several rows, so that candidate texts need one more exchange."""
    return not sig.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
