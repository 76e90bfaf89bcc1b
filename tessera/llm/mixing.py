"""Mixing sources to target weights.

Every source's words are packed, in an order fixed by hashes, into blocks of ``BLOCK`` words.  A source gets as many
slots of the mix as its target needs; slots are dealt to output shards by multinomial draws conditional on the totals
(multivariate hypergeometric), made down a binary tree over shards with seeds taken from the tree's nodes.  So any
task finds its own shard's counts and offsets by walking log2(shards) nodes, and the totals meet the targets exactly.
A task holds one shard of slots and the table of sources, whatever the sources' sizes.
Slot j of a source maps through the source's pseudorandom permutation (a keyed Feistel network, another one each
epoch) to a block, and slots meet blocks in a join by (source, block).  A source's last slot is cut to its target.

Targets: sources in code-point order, null last, take the weights in turn; targets share ``share`` times all words by
weight, none above ``cap`` times its source, the excess reshared by weight.  The table of sources is the one thing the
driver holds: a source has a weight of its own, so it is bounded by the mix's configuration (``MAX_SOURCES``).

Skew: offsets inside a source are summed over hashed buckets of about ``BUCKET_ROWS`` rows, as many as the rows need,
so a source with a third of all rows has no task of its own; blocks and slots are at most ``cap`` rows to a key; copies
of a row share one carrier of their columns and are joined to it, never gathered.  A long text is cut word by word in
one task's memory.

Defined cases: null text has no words; null sources form one source, last in order; null ids pass through; repeated
rows are documents of their own; documents without words take none; other columns ride along in ``mixed_rows``; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table, text_or_empty, word_count

BLOCK, BUCKETS, BUCKET_ROWS, SHARD_SLOTS, MAX_SOURCES = 256, 256, 1 << 16, 4096, 1_000_000
SLOTS = "shard long, slot long, sid int, epoch int, block long, take long"


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets of sources in order: shares of ``share`` times the total by weight, capped, excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / total > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(cap * sizes[i] for i in over)
        free -= over
    return out


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, keyed."""
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of range(n): four Feistel rounds, walked into the range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = np.asarray(index, np.uint64).copy()
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            a, b = x[todo] >> shift, x[todo] & mask
            for r in range(4):
                a, b = b, a ^ (_mix(b, key * 4 + r) & mask)
            x[todo] = a << shift | b
            todo = x >= n
    return x.astype(np.int64)


def preimage(value: int, n: int, key: int) -> int:
    """The index that ``permute`` maps to ``value``: the rounds run backwards, so no other index is looked at."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), value
    with np.errstate(over="ignore"):
        while True:
            a, b = np.array([x >> half], np.uint64), np.array([x & int(mask)], np.uint64)
            for r in (3, 2, 1, 0):
                a, b = b ^ (_mix(a, key * 4 + r) & mask), a
            x = int(a[0]) << half | int(b[0])
            if x < n:
                return x


def slots_needed(size: int, target: int, seed: int, sid: int, block: int = BLOCK) -> int:
    """How many slots a source's target needs, given where its short last block comes in each epoch."""
    n, out, left = -(-size // block), 0, target
    short, epoch = n * block - size, 0
    while left > 0 and n:
        if left >= size:
            out, left, epoch = out + n, left - size, epoch + 1
            continue
        m = -(-left // block)
        if short and m < n:
            if preimage(n - 1, n, _key(seed, sid, epoch)) < m and m * block - short < left:
                m += 1
        elif short and m == n and n * block - short < left:
            raise AssertionError("a target within an epoch needs no more than its blocks")
        return out + m
    return out


def _key(seed: int, sid: int, epoch: int) -> int:
    return (seed * 1_000_003 + sid) * 1_009 + epoch


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn from good + bad; by ratio of uniforms (Stadlober's HRUA) past the library's range."""
    if good < 1_000_000_000 and bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total, m = good + bad, min(n, good + bad - n)
    less, more = min(good, bad), max(good, bad)
    if min(less, m) < 10:  # few draws or few of a kind: one by one
        left, hits = less, 0
        if m <= less:
            for i in range(m):
                hit = int(rng.integers(total - i)) < left
                left, hits = left - hit, hits + hit
        else:
            room = m
            for i in range(less):
                hit = int(rng.integers(total - i)) < room
                room, hits = room - hit, hits + hit
        z = hits
    else:
        share = less / total
        centre = m * share + 0.5
        spread = math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
        width = 1.7155277699214135 * spread + 0.8989161620588988
        mode = (m + 1) * (less + 1) // (total + 2)
        weight = lambda k: sum(math.lgamma(x + 1) for x in (k, less - k, m - k, more - m + k))
        top = weight(mode)
        while True:
            x, y = 1 - rng.random(), rng.random()
            z = math.floor(centre + width * (y - 0.5) / x)
            if 0 <= z <= min(m, less) and 2 * math.log(x) <= top - weight(z):
                break
    if good > bad:
        z = m - z
    return good - z if m < n else z


def _draw(counts: np.ndarray, n: int, seed: tuple[int, ...]) -> np.ndarray:
    """n of the counted slots without replacement; source by source where counts pass the sampler's range."""
    total = int(counts.sum())
    if n <= 0 or total == 0:
        return np.zeros_like(counts)
    if n >= total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    if total < 900_000_000:
        return rng.multivariate_hypergeometric(counts, n)
    out, left = np.zeros_like(counts), n
    for i, c in enumerate(counts.tolist()):
        total -= c
        out[i] = _hypergeometric(rng, c, total, left) if total else left
        left -= int(out[i])
    return out


def shard_counts(shard: int, shards: int, totals: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's slots by source, and the first slot of each source that it holds."""
    lo, hi, counts, before = 0, shards, totals.astype(np.int64), np.zeros(len(totals), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(counts, int(counts.sum()) * (mid - lo) // (hi - lo), (seed, lo, hi))
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, counts - left, before + left
    return counts, before


def _slot_maker(sizes: list[int], goals: list[int], shards: int, seed: int, block: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.array([slots_needed(s, g, seed, i, block) for i, (s, g) in enumerate(zip(sizes, goals))], np.int64)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, before = shard_counts(shard, shards, totals, seed)
                parts = []
                for sid in np.flatnonzero(counts).tolist():
                    n = -(-sizes[sid] // block)
                    j = before[sid] + np.arange(counts[sid])
                    epoch = j // n
                    index = np.concatenate([permute(j[epoch == e] % n, n, _key(seed, sid, int(e))) for e in np.unique(epoch)])
                    take = np.where(index == n - 1, sizes[sid] - (n - 1) * block, block)
                    if j[-1] == totals[sid] - 1:  # the source's last slot ends at its target
                        e = int(epoch[-1])
                        inside = int(totals[sid]) - e * n
                        laid = inside * block
                        if sizes[sid] % block and preimage(n - 1, n, _key(seed, sid, e)) < inside:
                            laid -= n * block - sizes[sid]
                        take[-1] -= e * sizes[sid] + laid - goals[sid]
                    parts.append(np.stack([np.full(len(j), sid), epoch, index, take]))
                if not parts:
                    continue
                rows = np.concatenate(parts, axis=1)
                rows = rows[:, np.random.default_rng((seed, shard, 7)).permutation(rows.shape[1])]
                m = rows.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, shard)), pa.array(np.arange(m)), pa.array(rows[0].astype(np.int32)), pa.array(rows[1].astype(np.int32)), pa.array(rows[2]), pa.array(rows[3])],
                    [c.split()[0] for c in SLOTS.split(", ")],
                )

    return make


class Mix:
    """A drawn mix: ``sources``, ``documents`` (sized rows with their source), ``slots`` and ``spans``.

    ``documents``: row_key, k1, k2, doc_id, sid, size.  ``slots``: shard, slot, sid, epoch, block, take.
    ``spans``: which words [lo, hi) of a document a slot takes.
    """

    def __init__(self, docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, block: int = BLOCK):
        spark = docs.sparkSession
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
        sized = named.select("doc_id", "source", *document_keys(), word_count().cast("long").alias("size"))
        sized = materialize(sized.withColumn("row_key", F.monotonically_increasing_id()), "mix-sizes")
        per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
        if len(per) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        buckets = max(BUCKETS, -(-sum(r["rows"] for r in per) // BUCKET_ROWS))
        per = sorted(((r.source, r.size) for r in per), key=lambda x: (x[0] is None, x[0] or ""))
        sizes = [s for _, s in per]
        goals = targets(sizes, weights, share, cap)
        whole = [min(round(g), int(cap * s)) for g, s in zip(goals, sizes)]
        self.sources = spark.createDataFrame([(i, name, s, g) for i, ((name, s), g) in enumerate(zip(per, goals))], "sid int, source string, source_size long, target double")
        self.documents = sized.join(F.broadcast(self.sources.select("sid", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).select("row_key", "k1", "k2", "doc_id", "sid", "size")

        total = sum(-(-g // block) + 1 for g in whole)
        shards = max(1, -(-total // SHARD_SLOTS))
        make = _slot_maker(sizes, whole, shards, seed, block)
        # the planner takes a range for small, whatever a function makes of it: slots grow with the input, so no broadcast
        self.slots = spark.range(0, shards, 1, min(shards, max(8, partitions(spark)))).mapInArrow(make, SLOTS).hint("merge")

        # words before each document in its source: by hashed bucket, then inside the bucket
        dealt = self.documents.withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int"))
        base = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
        base = base.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("base"))
        inside = Window.partitionBy("sid", "bucket").orderBy("k1", "k2", "doc_id", "size", "row_key")
        placed = dealt.withColumn("first", F.sum("size").over(inside) - F.col("size")).join(base, ["sid", "bucket"])
        placed = placed.withColumn("first", F.col("first") + F.col("base"))
        last = F.floor((F.col("first") + F.col("size") - 1) / F.lit(block))
        self._blocks = placed.filter("size > 0").select("row_key", "k1", "k2", "doc_id", "sid", "size", "first", F.explode(F.sequence(F.floor(F.col("first") / F.lit(block)), last)).alias("block"))
        start = F.col("block") * block
        self.spans = (
            self._blocks.join(self.slots, ["sid", "block"])
            .select("row_key", "k1", "k2", "doc_id", "size", "shard", "slot", "epoch", F.greatest(F.lit(0), start - F.col("first")).alias("lo"), F.least(F.col("size"), start + F.col("take") - F.col("first")).alias("hi"))
            .filter("lo < hi")
        )


def document_keys() -> list:
    """Two hashes over (doc_id, text, source), 128 bits together."""
    return [F.xxhash64("doc_id", "text", "source").alias("k1"), F.xxhash64(F.lit(7), "source", "text", "doc_id").alias("k2")]


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    mix = Mix(docs, **options)
    used = mix.spans.groupBy("row_key").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return (
        mix.documents.join(used, "row_key", "left")
        .join(F.broadcast(mix.sources), "sid")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def _cutter(text_field: str, count_field: str | None):
    """Texts of the spans: a document that is taken whole keeps its text; parts are its words, joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            names = [f.name for f in row.type]
            texts = []
            for at, size in enumerate(batch.column("size").to_pylist()):
                text = row.field(text_field)[at].as_py() or ""
                spans = sorted((p["lo"], p["hi"]) for p in batch.column("spans")[at].as_py())
                if sum(b - a for a, b in spans) != size:
                    words = text.encode().split()
                    text = b" ".join(w for a, b in spans for w in words[a:b]).decode()
                texts.append(text)
            cols = []
            for name, kind in zip(names, row.type):
                col = row.field(name)
                if name == text_field:
                    col = pa.array(texts, kind.type)
                elif name == count_field:
                    col = pa.array(map(len, texts), pa.int64()).cast(kind.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names)

    return cut


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, columns as in ``docs``: one row per document and epoch, its text the words taken."""
    mix = Mix(docs, **options)
    once = mix.spans.groupBy("k1", "k2", "row_key", "size", "epoch").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    carriers = rows.select("row", *document_keys()).groupBy("k1", "k2").agg(F.first("row").alias("row"))
    rows = once.join(carriers, ["k1", "k2"]).select("row", "size", "spans")
    return rows.mapInArrow(_cutter("text", "n_chars" if "n_chars" in docs.columns else None), docs.schema)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
