"""SimHash near-deduplication with deletion-variant signatures.

A fingerprint's bit is 1 if more than half of the text's shingle hashes (XXH64, seed 42) have it.  Two fingerprints
that differ in at most 3 bits, cut into only two 32-bit segments, differ by at most one bit in one of them; so both
own a variant of that segment with the same bit wildcarded.  Each distinct fingerprint is indexed under its
2 x 32 one-wildcard variants, equal keys meet, and the whole distance is verified.

Keys are read as sorted streams.  A key of more than ``BLOCK`` members is dealt out anew by the bytes of the other
segment: 3 differing bits leave one of its 4 bytes equal, so no link is lost and no task holds more than such a part.

Within a key no pairs are spelled out: a breadth-first search over the members' distances gives a spanning forest of
their links, so a key of m members yields at most m - 1 rows.  The search costs m vector operations, or, for keys of
many members, looks up each member's 6,017 possible neighbours (they share 31 bits) in the sorted list: linear in m.
Copies collapse to one fingerprint beforehand.  Components come from distributed star joins over the forest's links.

Defined cases: null text counts as empty; texts without a word have fingerprint zero, linked like any other; texts of
fewer words than a shingle hash their whole word sequence; repeated rows and ties share one fingerprint; null ids
never become a component's id unless it has no other; other columns are ignored; an empty table gives no rows; long
texts are hashed whole, in one task's memory.
``kept_rows`` keeps one row of each component, also where rows repeat or no row has an id, with all its columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty
from .components import components, smallest_of_component

BITS, MANY, BLOCK = 3, 4096, 1 << 18
PRINTS = "doc_id long, fp long, text_hash long"


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of an UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    n = len(h)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        total += np.unpackbits(h[at: at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text").cast(pa.binary())]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    return run


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, shared: np.uint64, bits: int = BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most ``bits`` apart) among distinct fingerprints that agree on ``shared``'s bits."""
    m = len(fps)
    if m < 2:
        return []
    out: list[tuple[int, int]] = []
    if m > MANY:
        fps = np.sort(fps)
        free = [np.uint64(1 << b) for b in range(64) if not int(shared) >> b & 1]
        flips = np.array([np.bitwise_or.reduce(c) for k in range(1, bits + 1) for c in combinations(free, k)], np.uint64)
        seen = np.zeros(m, bool)
        for i in range(m):
            if seen[i]:
                continue
            seen[i], todo = True, [i]
            while todo:
                at = todo.pop()
                near = fps[at] ^ flips
                where = np.minimum(np.searchsorted(fps, near), m - 1)
                hit = where[(fps[where] == near) & ~seen[where]]
                seen[hit] = True
                todo += hit.tolist()
                out += [(int(fps[at]), int(fps[k])) for k in hit]
        return out
    left = fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _popcount(left ^ at) <= bits
            if near.any():
                hit = left[near]
                left = left[~near]
                todo += list(hit)
                out += [(int(at), int(x)) for x in hit]
    return out


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64) if x else [], pa.int64())


LINKS = "a long, b long, key long"


def _shared(key: int, part: bool) -> np.uint64:
    """The bits that a key's members agree on; ``part``: keys of parts end in the number and the value of a byte."""
    mask = 0
    if part:
        key, byte = key >> 10, key >> 8 & 3
        mask = 0xFF << (8 * byte + (0 if key >> 37 else 32))
    segment, bit = divmod(key >> 32, 32)
    return np.uint64(mask | (0xFFFFFFFF & ~(1 << bit)) << (32 * segment))


def _parts(key: int, fps: np.ndarray) -> pa.RecordBatch:
    """A key's members by each byte of the segment that the key doesn't fix: (fp, null, key of the part)."""
    other = (fps >> np.uint64(0 if key >> 37 else 32)) & np.uint64(0xFFFFFFFF)
    keys = [np.int64(key) << 10 | b << 8 | ((other >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64) for b in range(4)]
    none = pa.nulls(4 * len(fps), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.tile(fps.view(np.int64), 4)), none, pa.array(np.concatenate(keys))], ["a", "b", "key"])


def _meet(bits: int, part: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by key; a key's members may span batches."""
        held: list[np.ndarray] = []  # members of the last key so far
        last, size, large = None, 0, False

        def solve(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key) < 2:
                return
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[edge, len(key)])
            two = edge[count == 2]
            near = two[_popcount(fps[two] ^ fps[two + 1]) <= bits]
            a, b = fps[near].tolist(), fps[near + 1].tolist()
            for at, n in zip(edge[count > 2].tolist(), count[count > 2].tolist()):
                for x, y in forest(fps[at: at + n], _shared(int(key[at]), part), bits):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

        def close() -> Iterator[pa.RecordBatch]:
            if held and not large:
                fps = np.concatenate(held)
                yield from solve(np.full(len(fps), last), fps)

        for batch in batches:
            key, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            begin = int(np.searchsorted(key, last, side="right")) if last is not None else 0
            if begin:
                if large:
                    yield _parts(last, fps[:begin])
                else:
                    held.append(fps[:begin])
                    size += begin
            if begin < len(key):
                yield from close()
                end = int(np.searchsorted(key, key[-1]))
                yield from solve(key[begin:end], fps[begin:end])
                last, held, size, large = int(key[-1]), [fps[max(begin, end):]], len(key) - max(begin, end), False
            if size > BLOCK and not part and not large:
                for x in held:
                    yield _parts(last, x)
                held, large = [], True
        yield from close()

    return run


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` at most ``bits`` (3) apart."""
    if bits > 3:
        raise ValueError("two segments with one wildcard cover 3 bits")
    variant = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")
    rows = fps.select("fp", variant)
    segment = F.expr("CASE WHEN v < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    rows = rows.select("fp", F.expr("shiftleft(CAST(v AS BIGINT), 32)").bitwiseOR(segment.bitwiseAND(F.expr("~shiftleft(1L, v % 32)"))).alias("key"))
    met = lambda keyed, part: keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(bits, part), LINKS)
    links = materialize(met(rows, False), "print-links")
    large = links.filter("key IS NOT NULL").select(F.col("a").alias("fp"), "key")
    return links.filter("key IS NULL").unionByName(met(large, True)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = BITS) -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest id reachable), root (a fingerprint that names the component)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = materialize(rows.mapInArrow(_prints(shingle), PRINTS), "prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(near_links(prints.select("fp").distinct(), bits))
    named = smallest_of_component(first, roots, "fp", "low", "component_id").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def kept_rows(docs: DataFrame, shingle: int = 3, bits: int = BITS) -> DataFrame:
    """The input's columns; of each component one row stays, that with the smallest (id, text hash)."""
    found = near_duplicates(docs, shingle, bits)
    # components without any id are told apart by their root alone
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.groupBy("root").agg(F.min("text_hash").alias("k_hash"), F.min("component_id").alias("id"))
    keys = ["k_hash", "k_id", "k_none"]
    by_id = lambda c: [F.coalesce(c, F.lit(0)).alias("k_id"), c.isNull().alias("k_none")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_or_empty()).alias("k_hash"), *by_id(F.col("doc_id").cast("long")))
    rows = rows.join(stay.select("k_hash", *by_id(F.col("id"))).hint("shuffle_hash"), keys, "left_semi")
    # rows equal in id and text: one stays; the join has put them together
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))).filter("at = 1").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
