"""Order-preserving packing of token streams by dynamic programming.

A partition's documents form one token stream, in the order they are read; each is encoded and closed with an end id.
Candidate cuts are document ends (free), all sentence ends (a small penalty) and, where neither comes for a window's
length, hard cuts.  A transition from cut i to cut j lays ceil(L/2048) windows over the L tokens between: all but the
last are full and end in hard cuts, the last is padded.  With
``g(i) = cost(i) + position(i)`` the best i for a given number of windows is a sliding-window minimum.  That of one window
is kept in a monotone queue, so a candidate costs O(1); those of more lie before the block of candidates at hand and
are read from a table of minima, a block at a time.  The stream's last stretch may also be laid out as sequences whose
lengths are powers of two, which need no padding.

There is no shuffle: the layout follows the scan's splits and is the same whenever those are.  Memory is bounded by
``BUFFER`` tokens and one document; the DP commits finished windows and carries the rest on.

Defined cases: null text is the empty text, one end id; repeated rows are packed each; null ids pass through; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table, text_or_empty, trim

WINDOW, BUFFER, QUEUES = 2048, 1 << 18, 8
SLOT = 64  # spacing of the sentence ends that tests plant; no bound on cuts
SENTENCE_CUT, HARD_CUT = 2, 6
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tail(length: int, window: int) -> tuple[int, list[int]]:
    """Cheapest layout of a last stretch shorter than a window: padded once, or powers of two."""
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    cuts = (len(parts) - 1) * HARD_CUT
    return (cuts, parts) if cuts < window - length else (window - length, [length])


def plan(doc_ends: np.ndarray, sentence_ends: np.ndarray, final: bool, window: int = WINDOW) -> list[int]:
    """Ends of the windows that cover [0, doc_ends[-1]); unless ``final``, only those that later tokens can't change."""
    total = int(doc_ends[-1])
    inner = sentence_ends[~np.isin(sentence_ends, doc_ends)]
    at = np.union1d(doc_ends, inner)
    free = np.isin(at, doc_ends)
    gaps = np.diff(np.r_[0, at])
    if (gaps > window).any():  # a long stretch without boundaries: hard cuts every window
        extra = np.concatenate([np.arange(a + window, b, window) for a, b in zip(np.r_[0, at[:-1]][gaps > window], at[gaps > window])])
        penalty = dict.fromkeys(extra.tolist(), HARD_CUT)
        merged = np.union1d(at, extra)
        pens = [0 if f else SENTENCE_CUT for f in free.tolist()]
        penalty.update(zip(at.tolist(), pens))
        pos, pen = [0, *merged.tolist()], [0, *(penalty[p] for p in merged.tolist())]
    else:
        pos, pen = [0, *at.tolist()], [0, *(0 if f else SENTENCE_CUT for f in free.tolist())]

    where, m = np.array(pos), len(pos)
    g = np.zeros(m)  # cost and position of each cut
    ends_at = [0.0]
    back = np.zeros(m, np.int64)  # the cut before, or -k where k full windows lie before the last: looked up on the path
    queue: deque[int] = deque([0])
    begin = 1
    while begin < m:
        # a block spans one window, so what lies a whole window or more before its cuts is settled
        end = int(np.searchsorted(where, where[begin] + window, side="right"))
        far, kind = _far(where, g, begin, end, window)
        for j, p, c, k, more in zip(range(begin, end), pos[begin:end], far.tolist(), kind.tolist(), pen[begin:end]):
            while queue and pos[queue[0]] < p - window:
                queue.popleft()
            best, arg = c - p, -k
            if queue and (near := ends_at[queue[0]] + window - p) <= best:
                best, arg = near, queue[0]
            here = best + more + p
            ends_at.append(here)
            back[j] = arg
            while queue and ends_at[queue[-1]] >= here:
                queue.pop()
            queue.append(j)
        g[begin:end] = ends_at[begin:end]
        begin = end
    cost = g - where

    last_parts: list[int] | None = None
    if final:
        best = cost[-1]
        for i in range(m - 2, -1, -1):
            if total - pos[i] >= window:
                break
            c, parts = _tail(total - pos[i], window)
            if cost[i] + c < best:
                best, back[-1], last_parts = cost[i] + c, i, parts
    ends: list[int] = []
    j, tail = m - 1, last_parts
    while j:
        i = int(back[j])
        if i < 0:
            lo, hi = np.searchsorted(where, [pos[j] + (i - 1) * window, pos[j] + i * window])
            i = int(lo + np.argmin(g[lo:hi]))
        if tail:
            run = [pos[i] + int(x) for x in np.cumsum(tail)]
        else:
            run = [*range(pos[i] + window, pos[j], window), pos[j]]
        ends[:0] = run
        j, tail = i, None
    if final:
        return ends
    return [e for e in ends if e <= total - (QUEUES + 1) * window]


def _far(where: np.ndarray, g: np.ndarray, begin: int, end: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the cuts of a block: the least of g(i) and the cost of k full windows and a last one, and that k of 1 and more.

    The minima over the cuts from (k + 1) to k windows before come from a table of minima over 2^l cuts.
    """
    first = int(np.searchsorted(where, where[begin] - QUEUES * window))
    known, k = g[first:begin], np.arange(1, QUEUES + 1)[:, None]
    at = np.maximum(np.searchsorted(where, where[begin:end] - window * k) - first, 0)
    lo, size = at[1:], at[:-1] - at[1:]
    depth = int(size.max()).bit_length()
    if not depth:
        return np.full(end - begin, np.inf), np.ones(end - begin, np.int64)
    table = np.full((depth, len(known)), np.inf)
    table[0] = known
    for l in range(1, depth):
        step, n = 1 << l - 1, len(known) + 1 - (1 << l)
        np.minimum(table[l - 1, :n], table[l - 1, step: step + n], out=table[l, :n])
    level = np.frexp(np.maximum(size, 1))[1] - 1
    last = np.maximum(at[:-1] - (1 << level), 0)
    value = np.minimum(table[level, np.minimum(lo, len(known) - 1)], table[level, last]) + ((k[:-1] + 1) * window + k[:-1] * HARD_CUT)
    value[size <= 0] = np.inf
    kind = value.argmin(axis=0)
    return value[kind, np.arange(end - begin)], kind + 1


def _packer(path: str, end_id: int, window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = bpe.encoder(path)
        ends_sentence = enc.sentence_ends()
        sequence = TaskContext.get().partitionId() << 32
        # the buffer: documents not wholly packed yet, as [doc_id, ids, ids already packed]
        docs: list[list] = []
        held = 0

        def flush(final: bool) -> pa.RecordBatch | None:
            nonlocal docs, held, sequence
            lengths = [len(d[1]) - d[2] for d in docs]
            doc_ends = np.cumsum(lengths)
            ids = np.concatenate([d[1][d[2]:] for d in docs])
            cuts = plan(doc_ends, np.flatnonzero(ends_sentence[ids]) + 1, final, window)
            if not cuts:
                return None
            bounds = np.union1d(doc_ends[doc_ends < cuts[-1]], cuts)
            starts = np.r_[0, bounds[:-1]]
            owner = np.searchsorted(doc_ends, starts, side="right")
            window_of = np.searchsorted(cuts, starts, side="right")
            window_start = np.r_[0, cuts][window_of]
            doc_start = np.r_[0, doc_ends][owner]
            done = np.array([d[2] for d in docs])
            raw = memoryview(ids.astype("<u4").tobytes())
            out = [
                pa.array([docs[i][0] for i in owner.tolist()], pa.int64()),
                pa.array(starts - doc_start + done[owner], pa.int64()),
                pa.array(bounds - starts, pa.int64()),
                pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(starts.tolist(), bounds.tolist())], pa.int64()),
                pa.array([len(docs[i][1]) for i in owner.tolist()], pa.int64()),
                pa.array(sequence + window_of, pa.int64()),
                pa.array(starts - window_start, pa.int64()),
            ]
            sequence += len(cuts)
            rest, at = [], 0
            for d, n in zip(docs, lengths):
                if at + n > cuts[-1]:
                    d[2] += max(0, cuts[-1] - at)
                    rest.append(d)
                at += n
            docs, held = rest, at - cuts[-1]
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*enc.ids(text.as_py()), end_id], dtype=np.uint32)
                docs.append([doc_id, ids, 0])
                held += len(ids)
                if held >= BUFFER and (out := flush(False)) is not None:
                    yield out
        if docs:
            yield flush(True)
        docs = []
        trim()

    return pack


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_packer(tokenizer or bpe.default_path(), end_id, window), PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
