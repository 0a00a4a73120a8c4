"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

1. n and the sums S of the integer vectors x = floor(1024 * c) + 100000.
2. The scatter of x - S/n: every task multiplies y = x - round(S/n) (small integers) and returns one matrix; matrices are summed
   in Spark in two steps, so the driver gets about the square root of their number. The remaining shift of at most one half
   a component is subtracted from the totals.
3. The scatter V is factored with diagonal pivoting, V = L L'; one-sided Jacobi rotates the columns of L until they are
   orthogonal. Their squared norms are the eigenvalues, the columns over their norms the components. This takes place on
   the driver, on one matrix of the vector length squared.
4. Every row is projected; the covariance of what comes out is taken over all rows again and compared with the identity.

Signs make a component's largest entry positive. Components whose eigenvalue is zero within rounding are left out, so n = 1 or
equal rows give none, and with them no rows. Null vectors and vectors with null or non-finite entries are dropped; a null
vec_id is kept as it is; repeated rows count and come back as often as they are. Vectors of different lengths are fitted
apart. Entries whose x would pass 2^52 in size count as 2^52; a deviation beyond 64 bits is null. Empty tables give no rows.
Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stage, table, take_columns

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
LIMIT = float(1 << 52)
ZERO = 1e-13  # share of the trace below which an eigenvalue counts as zero
CHUNK = 500  # rows at once; 500 entries of 2^52 fit 64 bits


def vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """x of the rows of a batch (last column), as whole numbers in double precision."""
    lists = batch.column(batch.num_columns - 1)
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values) + SHIFT, -LIMIT, LIMIT).reshape(-1, size)


def totals(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """n and S. Each task returns whole sums; they are added as decimals in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, object)
        for batch in pieces(batches, CHUNK):
            x = vectors(batch, size).astype(np.int64)
            n += len(x)
            sums += x.sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([[str(n), *map(str, sums)]], pa.list_(pa.string()))], names=["s"])

    parts = rows.mapInArrow(run, "s array<string>").select(F.posexplode("s").alias("at", "v"))
    got = dict(parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())  # a row a dimension
    return int(got.get(0, 0)), [int(got.get(i + 1, 0)) for i in range(size)]


def product_sums(rows: DataFrame, width: int, values: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of v and of v v' over all rows, v a row of values(batch)."""
    shape = (width + 1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in pieces(batches, CHUNK):
            v = values(batch)
            total[0] += v.sum(0)
            total[1:] += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = stage(rows.mapInArrow(run, "m binary"), "whiten-sums")
    few = max(1, math.isqrt(parts.count()))
    total = np.zeros(shape)
    for r in parts.repartition(few).mapInArrow(add, "m binary").toLocalIterator():
        total += np.frombuffer(r["m"]).reshape(shape)
    return total[0], total[1:]


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in the order of a, columns by falling pivot) with a = L L'; as many columns as a has rank."""
    rest, columns = a.copy(), []
    least = max(np.trace(a), 0.0) * 1e-16
    for _ in range(len(a)):
        p = int(np.argmax(np.diag(rest)))
        if rest[p, p] <= least:
            break
        column = rest[:, p] / math.sqrt(rest[p, p])
        columns.append(column)
        rest = rest - np.outer(column, column)
        rest[p], rest[:, p] = 0, 0
    return np.stack(columns, axis=1) if columns else np.zeros((len(a), 0))


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """Rotates pairs of columns until all are orthogonal; disjoint pairs of a round turn together (round robin)."""
    u = factor.copy()
    m = u.shape[1] + u.shape[1] % 2
    u = np.concatenate([u, np.zeros((len(u), m - u.shape[1]))], axis=1)
    seats = np.arange(m)
    for _ in range(60):
        worst = 0.0
        for _ in range(max(m - 1, 0)):
            i, j = seats[:m // 2], seats[m // 2:][::-1]
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            off = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            turn = off > 1e-15
            worst = max(worst, float(off.max(initial=0)))
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            u[:, i], u[:, j] = c * a - s * b, s * a + c * b
            seats[1:] = np.roll(seats[1:], 1)
        if worst <= 1e-14:
            break
    return u


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns), at most so many."""
    u = one_sided_jacobi(pivoted_cholesky(v))
    e = (u * u).sum(0)
    order = [i for i in np.argsort(-e, kind="stable") if e[i] > ZERO * max(np.trace(v), 0.0)][:most]
    u = u[:, order] / np.sqrt(e[order])
    return e[order], u * np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(len(order))])


def whiten_length(rows: DataFrame, size: int, most: int) -> DataFrame | None:
    n, sums = totals(rows, size)
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.float64)  # round(S/n)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, near, strict=True)])  # S/n - round(S/n)
    moved, scatter = product_sums(rows, size, lambda b: vectors(b, size) - near)
    v = scatter / n - np.outer(moved / n, moved / n)
    e, parts = components_of((v + v.T) / 2, most)
    if not len(e):
        return None
    whiten, shift = parts / np.sqrt(e), [int(c) * n - s for s, c in zip(sums, near, strict=True)]  # n * round(S/n) - S
    top = 2.0 ** 62 / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            y = vectors(batch, size) - near
            far = np.abs(y).max(initial=0) * n + abs(max(map(abs, shift)))
            if far * far < top:
                deviation = ((n * y.astype(np.int64) + np.array(shift, np.int64)) ** 2).sum(1).tolist()
            else:  # whole numbers of any size, where the sum can fit
                about = ((n * y + np.array(shift, np.float64)) ** 2).sum(1)
                exact = [sum((n * int(a) + b) ** 2 for a, b in zip(row, shift, strict=True)) if near_ < 2.0 ** 63 * 1.001 else 1 << 63
                         for row, near_ in zip(y, about.tolist(), strict=True)]
                deviation = [d if d < 1 << 63 else None for d in exact]
            w = (y - rest) @ whiten
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()),
                 pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), len(e)).cast(pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "w"])

    out = stage(rows.mapInArrow(run, "vec_id long, deviation long, w array<double>"), "whiten-rows")

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(0)
        ends = lists.offsets.to_numpy()
        return lists.values.to_numpy()[ends[0]:ends[-1]].reshape(-1, len(e))

    mean, cov = product_sums(out.select("w"), len(e), whitened)
    error = float(np.abs(cov / n - np.outer(mean / n, mean / n) - np.eye(len(e))).max())
    explained = F.array(*[F.lit(float(x / np.trace(v))) for x in e])
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def whitened(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    usable = (take_columns(rows, "vec_id", "embedding").where("embedding is not null and size(embedding) > 0")
              .where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
              .select(F.col("vec_id").cast("long"), "embedding"))
    out = rows.sparkSession.createDataFrame(
        [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for (size,) in usable.select(F.size("embedding")).distinct().collect():  # a row a vector length
        part = whiten_length(usable.where(F.size("embedding") == size), size, most)
        out = out if part is None else out.unionByName(part)
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
