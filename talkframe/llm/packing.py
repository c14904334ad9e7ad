"""Packing token sequences into fixed windows by Karmarkar-Karp multiway differencing.

A document is its token ids and one closing id. Full windows are cut off the front and stand alone; what is left is cut
into ``parts`` of at most a quarter window, so that differencing has small numbers to balance. The parts of a run of
documents are dealt to k = ceil(tokens / capacity) windows: partial partitions are merged in pairs, the two with the
largest spread first, the fullest windows of one with the emptiest of the other. Windows come out near-equal; while one
exceeds its capacity, k rises by one and the run is dealt again.

Every task packs what it reads and holds one run at a time, so no exchange is needed and memory is bounded.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkframe.llm.common import column_bytes

WINDOW = 1024
RUN_WINDOWS = 256  # windows one run of parts is dealt to
END_ID = 0
MARK, MARK_ID = "<|endoftext|>", 50256
OTHER_SCRIPTS = re.compile("[^\x00-ɏ]")
_TOKENIZERS: dict[str, "ByteTokenizer"] = {}


def multiway(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each size, by differencing: only non-empty windows of a partial partition are stored, fullest first."""
    n = len(sizes)
    ahead, tail = np.full(n, -1), np.arange(n)  # members of a window as a chain from its head
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for turn in range(n - 1):
        _, _, a, a_head = heapq.heappop(heap)
        _, _, b, b_head = heapq.heappop(heap)
        if len(a) < len(b):
            a, a_head, b, b_head = b, b_head, a, a_head
        both = len(a) + len(b) - k
        if both > 0:  # the emptiest windows of one take the fullest of the other
            low = slice(len(a) - both, len(a))
            joined = a[low] + b[:both][::-1]
            heads, more = a_head[low], b_head[:both][::-1]
            ahead[tail[heads]] = more
            tail[heads] = tail[more]
            sums = np.concatenate([a[:len(a) - both], joined, b[both:]])
            head = np.concatenate([a_head[:len(a) - both], heads, b_head[both:]])
        else:
            sums, head = np.concatenate([a, b]), np.concatenate([a_head, b_head])
        order = np.argsort(-sums, kind="stable")
        sums, head = sums[order], head[order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), n + turn, sums, head))
    out = np.empty(n, np.int64)
    for window, at in enumerate(heap[0][3].tolist() if heap else []):
        while at >= 0:
            out[at] = window
            at = ahead[at]
    return out


def deal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size with no window over ``capacity``; the window count starts at the least possible and rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = multiway(sizes, k)
        if np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += 1


class ByteTokenizer:
    """Ids of a byte-level BPE file. The rank file of the same vocabulary is used where both split words alike (Latin scripts)."""

    def __init__(self, name: str):
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        lines = Path(public_tokenizers.path(f"{name}.tiktoken")).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if MARK in text or OTHER_SCRIPTS.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _tokenizer(name: str) -> ByteTokenizer:
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = ByteTokenizer(name)
    return _TOKENIZERS[name]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = WINDOW, run_windows: int = RUN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every token lies in exactly one piece; offsets of a sequence are gapless from 0 and no sequence exceeds ``window``. Empty and
    null texts are one closing id. Repeated rows are packed each for itself. An empty table gives an empty result. Only ``doc_id``
    and ``text`` are read. Sequence ids are unique, not dense.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    part = max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).ids
        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        held_tokens = 0

        def rows(pieces: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*pieces)) if pieces else [[] for _ in names]
            types = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def dealt() -> list[tuple]:
            nonlocal next_id
            sizes = np.array([p[2] for p in held])
            at = deal(sizes, window)
            order = np.argsort(at, kind="stable")
            upto = np.cumsum(sizes[order]) - sizes[order]
            begins = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
            offset = upto - np.repeat(upto[begins], np.diff(np.append(begins, len(order))))
            out = [(*held[i], next_id + int(at[i]), int(o)) for i, o in zip(order.tolist(), offset.tolist())]
            next_id += int(at.max()) + 1
            return out

        doc_type = None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            data, offsets = column_bytes(batch.column("text"))
            pieces: list[tuple] = []
            size = 0
            for r, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.array(encode(data[offsets[r]:offsets[r + 1]].tobytes().decode()) + [END_ID], dtype="<u4")
                n, start = len(ids), 0
                while n - start >= window:
                    pieces.append((doc, start, window, ids[start:start + window].tobytes(), n, next_id, 0))
                    next_id += 1
                    start += window
                while start < n:
                    take = min(part, n - start)
                    held.append((doc, start, take, ids[start:start + take].tobytes(), n))
                    held_tokens += take
                    start += take
                size += n
                if held_tokens >= window * run_windows:
                    pieces += dealt()
                    held, held_tokens = [], 0
                if size >= 1 << 20:
                    yield rows(pieces, doc_type)
                    pieces, size = [], 0
            yield rows(pieces, doc_type)
        if held:
            yield rows(dealt(), doc_type)

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
