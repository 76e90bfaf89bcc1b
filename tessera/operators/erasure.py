"""Reed-Solomon over GF(2^8): Arrow UDFs with table look-ups; a native path where no data shard is lost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the field's polynomial.
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Products of all byte pairs, and inverses (0 for 0)."""
    exp, x = [], 1
    for _ in range(255):
        exp.append(x)
        x <<= 1
        x ^= POLYNOMIAL if x & 256 else 0
    log = np.zeros(256, int)
    log[exp] = range(255)
    powers = np.array(exp * 2, np.uint8)
    product = powers[log[:, None] + log[None, :]]
    product[0, :] = product[:, 0] = 0
    inverse = np.zeros(256, np.uint8)
    inverse[1:] = powers[255 - log[1:]]
    return product, inverse


MUL, INV = _tables()


def generator(k: int, m: int) -> np.ndarray:
    """k identity rows over m Cauchy rows."""
    if k < 1 or m < 0 or k + m > 256:
        raise ValueError("k and m must satisfy 1 <= k and k + m <= 256")
    i, j = np.arange(m)[:, None], np.arange(k)[None, :]
    return np.concatenate([np.eye(k, dtype=np.uint8), INV[i ^ (m + j)].astype(np.uint8)])


def combine(rows: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Matrix product over the field."""
    out = np.zeros((len(rows), shards.shape[1]), np.uint8)
    for r, row in enumerate(rows):
        for c, s in zip(row, shards):
            if c:
                out[r] ^= MUL[c][s]
    return out


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination over the field."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        pivot = c + int(np.argmax(work[c:, c] != 0))
        if not work[pivot, c]:
            raise ValueError("the matrix is singular")
        work[[c, pivot]] = work[[pivot, c]]
        work[c] = MUL[INV[work[c, c]]][work[c]]
        for r in range(n):
            if r != c and work[r, c]:
                work[r] ^= MUL[work[r, c]][work[c]]
    return work[:, n:]


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    size = max(1, -(-len(data) // k))
    body = np.zeros(k * size, np.uint8)
    body[: len(data)] = np.frombuffer(data, np.uint8)
    body = body.reshape(k, size)
    return [s.tobytes() for s in body] + [s.tobytes() for s in combine(generator(k, m)[k:], body)]


def decode(shards: list[bytes | None], k: int, m: int, length: int) -> bytes:
    """The data from any k shards, the first k there are."""
    have = [i for i, s in enumerate(shards) if s is not None][:k]
    if len(have) < k:
        raise ValueError("Insufficient shards")
    stack = np.stack([np.frombuffer(shards[i], np.uint8) for i in have])
    if have != list(range(k)):
        stack = combine(invert(generator(k, m)[have]), stack)
    return stack.tobytes()[:length]


def encode_column(body: Column, k: int, m: int) -> Column:
    """array<binary> of k + m shards."""

    @F.pandas_udf("array<binary>")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: encode(bytes(b or b""), k, m))

    return run.asNondeterministic()(body)  # lest filters inferred from posexplode run it again


def decode_column(shards: Column, length: Column, k: int, m: int) -> Column:
    """The body; rows that have all data shards never leave the JVM, the others go through Python."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([decode([None if s is None else bytes(s) for s in r], k, m, int(n)) if r is not None else None for r, n in zip(rows, lengths)])

    whole = F.coalesce(~F.exists(F.slice(shards, 1, k), lambda s: s.isNull()), F.lit(True))
    native = F.substring(F.aggregate(F.slice(shards, 1, k), F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s)), F.lit(1), length.cast("int"))
    return F.when(whole, native).otherwise(run(F.when(~whole, shards), length))


def reconstruct_column(shards: Column, k: int, m: int) -> Column:
    """All k + m shards, lost ones rebuilt."""

    @F.pandas_udf("array<binary>")
    def run(rows: pd.Series) -> pd.Series:
        def one(r):
            have = [None if s is None else bytes(s) for s in r]
            size = next(len(s) for s in have if s is not None)
            return encode(decode(have, k, m, k * size), k, m)

        return rows.map(one)

    return run.asNondeterministic()(shards)


def lose(shards: Column, lost: list[int]) -> Column:
    """Shards with some taken away."""
    return F.transform(shards, lambda s, i: F.when(~i.isin(*lost), s))


def inspect(shards: DataFrame, k: int) -> DataFrame:
    """Rows with shard_index: role Data or Parity."""
    return shards.withColumn("role", F.when(F.col("shard_index") < k, "Data").otherwise("Parity"))
