"""Whitening of embeddings by QDWH spectral divide and conquer.

The covariance comes from exact integers: components are scaled and rounded
down, centred at the rounded mean, multiplied in batches and summed as whole
numbers, so it does not depend on the order of tasks. Only it (its size is the
square of the dimension) reaches the driver. There a QR-based dynamically
weighted Halley iteration gives the polar factor of the covariance less a shift,
which is a spectral projector in disguise: it splits the space into two
invariant subspaces, and both halves are split again until single components
are left. The components go to the tasks with the whitening of the rows.

Defined results: vectors that are null or hold null or non-finite entries are
left out, and so are empty ones and those of another length than most; repeated
rows count each; null ids stay null; a direction without variance has null in
place of its whitened value and takes no part in the identity error; a table
without usable vectors gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failtriage.llm.common import store
from failtriage.llm.vectors import commonest, rows_of, scaled

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
EXACT_FLOAT = 1 << 53
WHOLE = T.DecimalType(38, 0)


@dataclass
class Fit:
    """``n`` vectors of one length with their rounded mean, the sums about it, and the components found."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def _integers(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for length, (at, values) in rows_of(column).items():
        if size in (None, length):
            yield length, at, scaled(values, SCALE) + OFFSET


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sum of each dimension, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, at, x in _integers(batch.column(0)):
                counts[length] = counts.get(length, 0) + len(at)
                fits = len(x) * int(np.abs(x).max()) < 1 << 62
                sums[length] = sums.get(length, 0) + (x.sum(axis=0).astype(object) if fits else x.astype(object).sum(axis=0))
        for length, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()),
                 pa.array([counts[length]] * length, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))],
                ["length", "i", "n", "s"],
            )

    parts = vectors.mapInArrow(run, "length int, i int, n long, s decimal(38,0)")
    found = parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("s").cast(WHOLE).alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for row in found:
        out.setdefault(row["length"], (row["n"], [0] * row["length"]))[1][row["i"]] = int(row["s"])
    return out


def gram(z: np.ndarray) -> np.ndarray:
    """``z' z`` as whole numbers: by floats where all sums are exact in them, else by Python's integers."""
    if len(z) and len(z) * int(np.abs(z).max()) ** 2 < EXACT_FLOAT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    whole = z.astype(object)
    return whole.T @ whole


def _products(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sums of products of the dimensions of all vectors about ``centre``."""
    size = len(centre)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, x in _integers(batch.column(0), size):
                more = gram(x - centre)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                 pa.array(map(Decimal, total[upper]), pa.decimal128(38, 0))],
                ["i", "j", "p"],
            )

    parts = vectors.mapInArrow(run, "i int, j int, p decimal(38,0)")
    out = np.zeros((size, size), object)
    for row in parts.groupBy("i", "j").agg(F.sum("p").cast(WHOLE).alias("p")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = int(row["p"])
    return out


def polar(a: np.ndarray) -> np.ndarray:
    """The symmetric orthogonal polar factor of a symmetric matrix, by the QDWH iteration with QR."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps / 4
    for _ in range(30):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        step, x = np.linalg.norm(new - x), new
        if low > 1 - 1e-12 and step < 1e-13 * np.sqrt(n):
            break
    return x


#: Where shifts are tried, in spreads of the diagonal about its mean.
SHIFTS = (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.57, 0.83, -0.89)


def spectrum(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of a symmetric matrix, by splitting off invariant subspaces.

    The mean of the diagonal is the mean of the eigenvalues, so a shift there has
    some on either side unless all are equal. A shift too close to an eigenvalue
    gives no clean projector, and the next one is tried.
    """
    n = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    if n == 1 or spread <= 4 * np.finfo(float).eps * scale:
        return np.diag(a).copy(), np.eye(n)
    for shift in SHIFTS:
        factor = polar(a - (middle + shift * spread) * np.eye(n))
        projector = (factor + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-12 * n:
            continue
        # Images of any vectors begin a basis of the projector's range; one more product cleans it.
        start = np.random.default_rng(n).standard_normal((n, rank))
        basis, _ = np.linalg.qr(projector @ start)
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        above, below = basis[:, :rank], basis[:, rank:]
        if np.linalg.norm(below.T @ a @ above) > 1e-13 * n * scale:
            continue
        parts = [(v, spectrum(_symmetric(v.T @ a @ v), scale)) for v in (above, below)]
        return (
            np.concatenate([values for _, (values, _) in parts]),
            np.hstack([v @ vectors for v, (_, vectors) in parts]),
        )
    raise ArithmeticError("no shift splits the spectrum")


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def fit(table: DataFrame, vector: str = "embedding") -> Fit | None:
    """Exact covariance of all usable vectors and its components, by falling eigenvalue; None without any."""
    vectors = table.select(F.col(vector).cast("array<double>").alias("v"))
    sums = _sums(vectors)
    size = commonest({length: n for length, (n, _) in sums.items()})
    if size is None:
        return None
    n, total = sums[size]
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = np.array([s - n * c for s, c in zip(total, centre)], object)
    products = _products(vectors, np.array(centre, np.int64))
    whole = n * products - np.outer(rest, rest)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in whole])
    values, axes = spectrum(covariance)
    order = np.argsort(-values, kind="stable")
    axes = axes[:, order]
    # Either sign will do; the same one every time is easier to compare.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(size)])
    return Fit(n, np.array(centre, np.int64), rest, covariance, values[order], axes)


def varied(found: Fit, components: int = COMPONENTS) -> np.ndarray:
    """Which of the first components have variance beyond rounding."""
    least = len(found.values) * np.finfo(float).eps * abs(found.values).max()
    return found.values[:components] > least


def whiten(table: DataFrame, found: Fit, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, the exact squared deviation times the square of ``n``, and the whitened components, per usable row."""
    size, n = len(found.centre), found.n
    used = varied(found, components)
    axes = found.vectors[:, :components] / np.sqrt(np.where(used, found.values[:components], np.inf))
    shift = np.array([int(r) / n for r in found.rest])
    centre, rest = found.centre, found.rest
    squared = sum(int(r) ** 2 for r in rest)
    small = max((abs(int(r)) for r in rest), default=0) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x in _integers(batch.column(1), size):
                z = x - centre
                most = int(np.abs(z).max())
                exact = z if small and size * max(most, 1) * max(most, int(abs(rest).max()), 1) < 1 << 62 else z.astype(object)
                own = (exact * exact).sum(axis=1)
                crossed = exact @ (rest.astype(np.int64) if exact is z else rest)
                deviation = [Decimal(n * n * int(a) - 2 * n * int(b) + squared) for a, b in zip(own, crossed)]
                white = (z - shift) @ axes
                lists = pa.array(white.ravel(), pa.float64(), mask=np.tile(~used, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(deviation, pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(used), pa.int32()), lists)],
                    ["key", "deviation", "whitened"],
                )

    schema = T.StructType([
        T.StructField("key", table.schema[key].dataType), T.StructField("deviation", WHOLE),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)
    return rows.withColumnRenamed("key", key)


def identity_error(white: DataFrame, used: np.ndarray) -> float | None:
    """The largest entry, without sign, of the covariance of the whitened rows less the identity."""
    at = np.flatnonzero(used).tolist()
    if not at:
        return None
    w = [F.get("whitened", F.lit(i)) for i in at]
    means = white.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    centred = [c - F.lit(m) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    found = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, with what the components explain and the measured identity error."""
    found = fit(table, vector)
    if found is None:
        empty = T.StructType([table.schema[key], *T.StructType.fromDDL(OUT).fields])
        return table.sparkSession.createDataFrame([], empty)
    white = store(whiten(table, found, key, vector, components), "whitened")
    used = varied(found, components)
    error = identity_error(white, used)
    trace = float(np.trace(found.covariance))
    shares = [float(v) / trace if trace > 0 else 0.0 for v in found.values[:components]]
    return white.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s) for s in shares]), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
