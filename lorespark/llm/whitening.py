"""Embedding whitening by polarisation covariance.

An entry c becomes the integer x = floor(1024 c) + 100000. A first pass counts the vectors, n,
and adds each dimension's x, S. A second one squares, in exact integers, the centred values
n x - S of every dimension and of the sum of every two dimensions; the difference of the
variances of a sum and of its parts is twice their covariance (the polarisation identity).
The driver turns these D (D + 1) / 2 sums, whose number doesn't grow with the rows, into the
covariance V and gives it to eigh. A third pass projects, and adds the products of the whitened
values to tell how far their covariance is from the identity.

A task adds up its own rows in blocks and gives one row a dimension or pair; squares of more
than 24 bits are cut into digits so that no sum of a block overflows.

Defined results. A vector that is null, holds a null or non-finite entry or one whose x
isn't below 2 ** 53 in size, or has another length than most vectors (ties: the shortest), is
left out. An empty table, or vectors of length 0, give no rows. Components whose eigenvalue is 0 within
rounding (D times the rounding of the largest) can't be whitened and have no rows: so one
vector, or equal ones, give none. Repeated ids and vectors are rows of their own, as is a null id.
``deviation`` is null where it doesn't fit a long; ``deviation_exact`` (null from 10 ** 38 on)
goes further. Columns beside vec_id and embedding are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK = 1024  # rows of a block
DIGIT = 24  # bits of a digit: a block's sum of products of two stays below 2 ** 63
LARGEST = 2**53


def _vectors(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of an array column: (row numbers, integers x) of the vectors that can be used, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == size)
        if size == 0:
            out.append((at, np.zeros((len(at), 0), np.int64)))
            continue
        c = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * c)
            fit = (np.abs(x) < LARGEST - SHIFT).all(1)  # false for NaN and infinities too
        out.append((at[fit], x[fit].astype(np.int64) + SHIFT))
    return out


def _lengths(batches):
    """(size, n): usable vectors of a task by length."""
    seen: dict[int, int] = {}
    for batch in batches:
        for at, x in _vectors(batch.column(0)):
            seen[x.shape[1]] = seen.get(x.shape[1], 0) + len(at)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["size", "n"])


def _of_size(batches, column: int, size: int):
    """(batch, row numbers, x) of the vectors of one length, in blocks."""
    for batch in batches:
        for at, x in _vectors(batch.column(column)):
            if x.shape[1] == size:
                for k in range(0, len(at), BLOCK):
                    yield batch, at[k : k + BLOCK], x[k : k + BLOCK]


def _whole(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(size: int):
    """(i, total, least, most): each dimension's sum and range in a task."""

    def run(batches):
        total = np.zeros(size, object)
        least, most = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        rows = 0
        for _, at, x in _of_size(batches, 0, size):
            rows += len(at)
            total += x.sum(0).astype(object)  # 2 ** 53 times a block of 2 ** 10
            least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), _whole(total), pa.array(least), pa.array(most)], names=["i", "total", "least", "most"])

    return run


def digits(y: np.ndarray, n: int) -> list[np.ndarray]:
    """Non-negative integers as ``n`` digits of DIGIT bits, the lowest first; the last takes the rest."""
    return [((y >> (DIGIT * k)) & ((1 << DIGIT) - 1)) if k < n - 1 else y >> (DIGIT * k) for k in range(n)]


def square_sums(z: np.ndarray, n: int, into: np.ndarray) -> None:
    """Add each column's sum of squares to ``into``, one row for each power of 2 ** DIGIT. Exact."""
    if n == 1:
        into[0] += np.einsum("rc,rc->c", z, z)
        return
    parts = digits(np.abs(z), n)
    for a in range(n):
        for b in range(a, n):
            s = np.einsum("rc,rc->c", parts[a], parts[b])
            into[a + b] += (s if a == b else 2 * s.astype(object))


def centred(x: np.ndarray, n: int, sums: list[int], plain: bool) -> np.ndarray:
    """n x - S; Python integers where 64 bits don't hold it."""
    return n * x - np.array(sums, np.int64) if plain else n * x.astype(object) - np.array(sums, object)


def _squares(size: int, n: int, sums: list[int], plain: bool, bits: int):
    """(i, j, power, total): of a task, the squares of n x - S of dimension i (j = i), or of the sum of i and j."""
    cut = 1 if bits <= 26 else -(-bits // DIGIT)

    def run(batches):
        totals = [np.zeros((2 * cut - 1, size - i), object) for i in range(size)]
        rows = 0
        for _, at, x in _of_size(batches, 0, size):
            rows += len(at)
            y = centred(x, n, sums, plain)
            for i in range(size):
                z = y[:, i:] + y[:, i : i + 1]
                z[:, 0] = y[:, i]
                if z.dtype == object:
                    totals[i][0] += (z * z).sum(0)
                else:
                    square_sums(z, cut, totals[i])
        if not rows:
            return
        for i in range(size):
            for power, row in enumerate(totals[i]):
                # more than 38 digits go in two: the upper part counts 2 ** 96
                low, high = [int(v) & ((1 << 96) - 1) for v in row], [int(v) >> 96 for v in row]
                js, same = np.arange(i, size, dtype=np.int32), size - i
                for shift, part in ((DIGIT * power, low), (DIGIT * power + 96, high)):
                    if any(part):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(same, i, np.int32)), pa.array(js), pa.array(np.full(same, shift, np.int32)), _whole(part)], names=["i", "j", "shift", "total"])

    return run


def covariance(size: int, n: int, totals: list[tuple[int, int, int, int]]) -> np.ndarray:
    """V from (i, j, shift, total): variances of sums less those of their parts; integers up to the last division."""
    q = np.zeros((size, size), object)
    for i, j, shift, total in totals:
        q[i, j] += int(total) << shift
    v = np.empty((size, size))
    for i in range(size):
        v[i, i] = int(q[i, i]) / n**3
        for j in range(i + 1, size):
            v[i, j] = v[j, i] = (int(q[i, j]) - int(q[i, i]) - int(q[j, j])) / (2 * n**3)
    return v


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding by size, at most ``most``, and their unit vectors as columns. Signs: the largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = e > max(e[0], 0) * len(e) * np.finfo(float).eps if len(e) else np.zeros(0, bool)
    e, u = e[keep][:most], u[:, keep][:, :most]
    for k in range(len(e)):
        if u[np.abs(u[:, k]).argmax(), k] < 0:
            u[:, k] = -u[:, k]
    return e, u


def _moments(size: int, n: int, sums: list[int], plain: bool, way: np.ndarray):
    """(n, mean, m2) of a task's whitened values: count, means, and the products of what is left of them, block by block."""

    def run(batches):
        count, mean, m2 = 0, np.zeros(way.shape[1]), np.zeros((way.shape[1],) * 2)
        for _, at, x in _of_size(batches, 0, size):
            w = (centred(x, n, sums, plain) / n).astype(np.float64) @ way
            own = w.mean(0)
            rest, apart, both = w - own, own - mean, count + len(at)
            m2 += rest.T @ rest + np.outer(apart, apart) * (count * len(at) / both)
            mean += apart * (len(at) / both)
            count = both
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([mean.tolist()]), pa.array([m2.ravel().tolist()])], names=["n", "mean", "m2"])

    return run


def identity_error(moments: DataFrame, k: int) -> float:
    """Largest entry of the whitened values' covariance less the identity, from the tasks' (n, mean, m2)."""
    total = moments.agg(*[F.sum(F.col("n") * F.col("mean")[i]).alias(f"s{i}") for i in range(k)], F.sum("n").alias("n")).first()
    mean = [total[i] / total["n"] for i in range(k)]
    apart = [F.col("mean")[i] - mean[i] for i in range(k)]
    entries = [F.sum(F.col("m2")[i * k + j] + F.col("n") * apart[i] * apart[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    got = iter(moments.agg(*entries).first())
    return max(abs(next(got) / total["n"] - (i == j)) for i in range(k) for j in range(i, k))


def _projected(size: int, n: int, sums: list[int], plain: bool, bits: int, way: np.ndarray):
    """(vec_id, deviation, whitened) of each usable vector."""
    short = plain and 2 * bits + int(size).bit_length() <= 62

    def run(batches):
        for batch, at, x in _of_size(batches, 1, size):
            y = centred(x, n, sums, plain)
            w = (y / n).astype(np.float64) @ way
            if short:
                far = pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
            else:
                far = pa.array([Decimal(int(d)) if d < 10**38 else None for d in (y.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), far, w], names=["vec_id", "deviation", "whitened"])

    return run


RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whitened(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): each usable
    vector of ``table(vec_id, embedding)`` on each of the first ``most`` components."""
    spark = table.sparkSession
    kind = table.schema["vec_id"].dataType.simpleString()
    v = table.select("vec_id", "embedding")
    none = spark.createDataFrame([], RESULT.format(kind))
    usual = v.select("embedding").mapInArrow(_lengths, "size int, n long").groupBy("size").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "size").first()
    if usual is None or not usual["size"]:
        return none
    size, n = usual["size"], usual["n"]
    per = v.select("embedding").mapInArrow(_sums(size), "i int, total decimal(38,0), least long, most long")
    per = per.groupBy("i").agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # a row a dimension
    per = sorted((r["i"], int(r["total"]), r["least"], r["most"]) for r in per)
    sums = [r[1] for r in per]
    bits = max(max(n * r[3] - r[1], r[1] - n * r[2]) for r in per).bit_length() + 1  # of the sum of two centred values
    plain = bits <= 62 and max(max(abs(r[1]), n * abs(r[2]), n * abs(r[3])) for r in per) < 2**62  # 64 bits hold all of it

    squares = v.select("embedding").mapInArrow(_squares(size, n, sums, plain, bits), "i int, j int, shift int, total decimal(38,0)")
    squares = squares.groupBy("i", "j", "shift").agg(F.sum("total").alias("total"))
    cov = covariance(size, n, [tuple(r) for r in squares.collect()])  # a few rows a pair of dimensions
    e, u = principal(cov, most)
    if not len(e):
        return none
    way, explained = u / np.sqrt(e), e / np.trace(cov)
    moments = v.select("embedding").mapInArrow(_moments(size, n, sums, plain, way), "n long, mean array<double>, m2 array<double>")
    error = identity_error(written(moments, "whitened-moments"), len(e))

    out = v.mapInArrow(_projected(size, n, sums, plain, bits, way), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    share = F.element_at(F.array(*[F.lit(float(x)) for x in explained]), F.col("k") + 1)
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "w")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"),
        F.col("w").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
