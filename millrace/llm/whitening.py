"""Whitening of embeddings by an exact scatter in residues.

Entries become whole numbers. Over the distinct vectors, sums give centred whole numbers n * x - S; each partition multiplies
their residues modulo several primes as matrices of doubles, in blocks in which no sum leaves the whole numbers that doubles
hold; residues are summed by prime and row, and Chinese remaindering gives the exact scatter. Its eigenvectors, in double
precision, are the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, written

#: Steps of an entry and its offset; components that are given.
STEP, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
#: Entries beyond this are held at it; primes lie below 2**PRIME_BITS; rows of a block, so that sums stay below 2**53.
FAR, PRIME_BITS, BLOCK = 1 << 50, 21, 4096
#: Dimensions up to which the scatter is put together and its eigenvectors found on the driver.
WIDEST = 4096


def quantized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with x, whole numbers floor(64 * c) + 1000000, without rows whose vector is null, empty or holds null, NaN or
    infinite entries. Entries of more than 2**50 in size are held there. Of vectors of several lengths those of the most
    frequent one stay (the greatest of ties)."""
    c = F.col(vector)
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.drop("x").filter(whole)
    common = rows.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size(c) == (common["d"] if common else 0))
    held = lambda e: F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), F.lit(STEP) * e.cast("double")))
    return rows.withColumn("x", F.transform(c, lambda e: F.floor(held(e)).cast("long") + OFFSET))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    flat = batch[column].flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), -1) if len(batch) else np.zeros((0, 0), np.int64)


def sums_of(fit: DataFrame) -> tuple[int, list[int], int]:
    """Rows of fit (x), the exact sum of each dimension, and the greatest size of an entry less OFFSET."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                high, low, most = (x >> 25).sum(0), (x & ((1 << 25) - 1)).sum(0), np.abs(x - OFFSET).max(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(high), pa.array(low), pa.array(most), pa.array(np.full(x.shape[1], len(x)))], ["i", "high", "low", "most", "n"])

    parts = fit.mapInArrow(run, "i long, high long, low long, most long, n long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    got = parts.groupBy("i").agg(whole("high"), whole("low"), F.max("most").alias("most"), F.sum("n").alias("n")).orderBy("i").collect()  # a row for each dimension
    return (got[0]["n"] if got else 0), [(int(r["high"]) << 25) + int(r["low"]) for r in got], max((r["most"] for r in got), default=0)


def primes(bound: int) -> list[int]:
    """The greatest primes below 2**PRIME_BITS whose product is more than twice the bound: residues tell -bound to bound apart."""
    sieve = np.ones(1 << PRIME_BITS, bool)
    sieve[:2] = False
    for i in range(2, 1 << (PRIME_BITS // 2 + 1)):
        if sieve[i]:
            sieve[i * i :: i] = False
    out: list[int] = []
    for p in np.flatnonzero(sieve)[::-1]:
        if prod(out) > 2 * bound:
            break
        out.append(int(p))
    return out


def _residues(x: np.ndarray, n: int, s: list[int], p: int) -> np.ndarray:
    """(n * x - s) modulo p, between -p / 2 and p / 2, as doubles."""
    r = ((x % p) * (n % p) - np.array([v % p for v in s], np.int64)) % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def scatter(fit: DataFrame, n: int, s: list[int], most: int) -> np.ndarray:
    """The exact sums over fit of (n * x[i] - s[i]) * (n * x[j] - s[j]), Python integers."""
    d, bound = len(s), n * (2 * n * most + n) ** 2
    moduli = primes(bound)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: np.zeros((d, d), np.int64) for p in moduli}
        for batch in batches:
            x = _matrix(batch)
            for at in range(0, len(x), BLOCK):
                for p in moduli:
                    r = _residues(x[at : at + BLOCK], n, s, p)
                    sums[p] = (sums[p] + (r.T @ r).astype(np.int64)) % p
        for p, m in sums.items():
            rows = [m[i, i:].astype(np.int32) for i in range(d)]  # the other half is the same
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, p, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(rows, pa.list_(pa.int32()))], ["p", "i", "row"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        rows = table["row"].combine_chunks()
        m = rows.flatten().to_numpy().reshape(len(rows), -1).astype(np.int64).sum(0) % key[0].as_py()
        return pa.table({"p": [key[0].as_py()], "i": [key[1].as_py()], "row": [m.astype(np.int32)]}, pa.schema([("p", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.int32()))]))

    kind = "p int, i int, row array<int>"
    got = fit.mapInArrow(multiplied, kind).groupBy("p", "i").applyInArrow(added, kind).toArrow()  # as many as dimensions times primes
    whole, out = prod(moduli), np.zeros((d, d), object)
    unit = {p: whole // p * pow(whole // p, -1, p) for p in moduli}
    for p, i, row in zip(*(got[c].to_pylist() for c in ("p", "i", "row")), strict=True):
        out[i, i:] += unit[p] * np.array(row, object)
    out %= whole
    out = np.where(out > whole // 2, out - whole, out)
    return np.triu(out) + np.triu(out, 1).T


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # a column for each component
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: int64 where that holds it, else Python integers."""
        most = self.n * (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1)
        if most >= 1 << 62:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Exact sums of squares; None where a long doesn't hold them."""
        most = int(np.abs(y).max(initial=0))
        if y.dtype == object or most * most * y.shape[1] >= 1 << 63:
            return [v if v < 1 << 63 else None for v in (sum(int(e) ** 2 for e in row) for row in y)]
        return (y * y).sum(1).tolist()

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of fit's vectors (x, distinct); None without rows. Components without variance are left out."""
    n, s, most = sums_of(fit)
    if not n:
        return None
    if len(s) > WIDEST:
        raise ValueError(f"more than {WIDEST} dimensions")
    exact = scatter(fit, n, s, most)
    v = np.array([[int(e) / n**3 for e in row] for row in exact])  # whole numbers divide to the nearest double
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > max(values[0], 0) * len(s) * 1e-14).sum()))
    return Whitening(n, s, vectors[:, :k], values[:k], int(np.trace(exact)) / n**3)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of fit's whitened vectors, less the identity."""
    k, held = len(model.values), fit.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if len(batch):
                w = m.whitened(m.centred(_matrix(batch)))
                mean = w.mean(0)
                both = np.concatenate([((w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)).ravel(), len(w) * mean])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["i", "v"])

    got = fit.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()  # components * (components + 1)
    mean = got[k * k :] / model.n  # all but zero, so that nothing is lost by the difference
    return float(np.abs(got[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vectors without their vector, a row for each component: component (from 1), n, deviation, whitened, explained, identity_error.

    Which rows count and what odd entries become, see quantized(). The fit takes each distinct x once; n is their number,
    deviation the exact sum over dimensions of (n * x - S)**2 (null where a long doesn't hold it). Components without variance
    (repeated or single vectors, constant dimensions) are left out; where none has any, or the table is empty, there are no
    rows. Repeated rows and ids give repeated rows. Other columns are kept, columns of these names replaced.
    """
    rows = written(quantized(vectors.drop("component", "n", "deviation", "whitened", "explained", "identity_error"), vector).drop(vector), "whole-vectors")
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    model = fitted(fit, components)
    error = identity_error(fit, model) if model and len(model.values) else 0.0
    held, names = rows.sparkSession.sparkContext.broadcast(model), [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches if m and len(m.values) else ():
            k, y = len(m.values), m.centred(_matrix(batch))
            again = pa.array(np.repeat(np.arange(len(batch)), k))
            told = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)), np.full(len(batch) * k, m.n), [v for v in m.deviation(y) for _ in range(k)], m.whitened(y).ravel(), np.tile(m.values / m.trace, len(batch)), np.full(len(batch) * k, error)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(again) for c in names), *(pa.array(v, t) for v, t in zip(told, kinds, strict=True))], [*names, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, extended(rows.drop("x"), component="int", n="long", deviation="long", whitened="double", explained="double", identity_error="double"))
