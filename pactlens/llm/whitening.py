"""Embedding whitening: exact covariance sums, eigenvectors by QDWH spectral divide-and-conquer, broadcast projection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
MOST_ENTRY = 1 << 53  # an entry beyond it has no exact double
ROWS_AT_ONCE = 4096
EPS = np.finfo(np.float64).eps

WHITENED = "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


# --- symmetric eigenvectors -------------------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: 1 where its eigenvalues are positive, -1 where negative.

    Dynamically weighted Halley steps by QR factorization; the weights follow a lower bound of the smallest singular value,
    so even eigenvalues next to zero take six steps or so.
    """
    d = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    low = EPS
    for _ in range(32):
        root = (4 * (1 - low**2) / low**4) ** (1 / 3)
        u = math.sqrt(1 + root) + math.sqrt(max(0.0, 8 - 4 * root + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + root)))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(w) * x, np.eye(d)]))
        following = v / w * x + (u - v / w) / math.sqrt(w) * q[:d] @ q[d:].T
        following = (following + following.T) / 2
        low = min(1.0, low * (u + v * low**2) / (1 + w * low**2))
        change = np.linalg.norm(following - x)
        x = following
        if change <= 4 * EPS ** (1 / 3) * 1e-3 and 1 - low <= 16 * EPS:
            break
    return x


def split(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the invariant subspace of eigenvalues above ``shift``, and their number.

    None where the shift does not part the eigenvalues or the subspaces are not invariant to rounding (an eigenvalue lies
    on the shift).
    """
    d = len(a)
    projector = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < d:
        return None
    start = np.random.default_rng(d).standard_normal((d, rank))
    for _ in range(2):  # the second pass takes out what rounding left of the other subspace
        start, _ = np.linalg.qr(projector @ start)
    basis, _ = np.linalg.qr(np.hstack([start, np.eye(d)]))
    if np.linalg.norm(basis[:, :rank].T @ a @ basis[:, rank:]) > 64 * d * EPS * scale:
        return None
    return basis, rank


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by spectral divide-and-conquer.

    The polar factor of the shifted matrix gives the projectors of the eigenvalues above and below the shift; the matrix is
    carried to the two subspaces and each is parted on, down to one dimension or to a multiple of the identity, where any
    basis serves.  Vectors have their largest entry positive.
    """
    d = len(a)
    scale = float(np.linalg.norm(a))
    values, vectors = np.zeros(d), np.zeros((d, d))
    work, filled = [(a, np.eye(d))], 0
    while work:
        block, basis = work.pop()
        k = len(block)
        middle = float(np.trace(block)) / k
        if k == 1 or np.linalg.norm(block - middle * np.eye(k)) <= 2 * k * EPS * scale:
            values[filled : filled + k], vectors[:, filled : filled + k] = np.diag(block), basis
            filled += k
            continue
        diagonal = np.sort(np.diag(block))
        gaps = (diagonal[1:] + diagonal[:-1])[np.argsort(diagonal[:-1] - diagonal[1:], kind="stable")] / 2
        parted = next((p for s in (float(np.median(diagonal)), middle, *map(float, gaps)) if (p := split(block, s, scale))), None)
        if parted is None:
            raise ArithmeticError(f"no shift parts the {k} eigenvalues around {middle}")
        q, rank = parted
        for side in (q[:, :rank], q[:, rank:]):
            inner = side.T @ block @ side
            work.append(((inner + inner.T) / 2, basis @ side))
    vectors = refined(a, vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    return values[order], vectors * np.where(signs == 0, 1, signs)


def refined(a: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One correction of nearly exact eigenvectors from what is left beside the diagonal, in long doubles; equal ones stay."""
    wide, v = a.astype(np.longdouble), vectors.astype(np.longdouble)
    inner, gram = v.T @ wide @ v, v.T @ v
    values = np.diag(inner) / np.diag(gram)
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > 1e-10 * np.abs(values).max(initial=0)
    half = (np.eye(len(a)) - gram) / 2
    change = np.where(far, (inner - values[None, :] * gram) / np.where(far, gap, 1), half)
    np.fill_diagonal(change, np.diag(half))
    out = v + v @ change
    for _ in range(2):  # the correction leaves its square: 1e-11 of right angles missing where eigenvalues are 1e-10 apart
        out = out @ (3 * np.eye(len(a)) - out.T @ out) / 2
    return (out / np.sqrt((out * out).sum(axis=0))).astype(np.float64)


# --- sums over all vectors --------------------------------------------------------------------------------------------


def entries(vectors: pa.Array) -> np.ndarray:
    """``floor(64 * c) + 1000000`` of a list array without nulls, one row per vector, as whole doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat) + SHIFT).reshape(len(vectors), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors without null and non-finite entries."""
    rows = columns_of(embeddings, "vec_id", "embedding")
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(math.inf), F.lit(False)))
    return rows.where(F.coalesce(finite, F.lit(False)))  # NaN is above all numbers


def sums(vectors: DataFrame, d: int, about: list[int] | None = None) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums per dimension and sums of products of the vectors' entries less ``about``: whole numbers, exact at any size.

    A task multiplies blocks of so few rows that a double holds every sum of products, and adds the blocks up in Python
    integers; one row per dimension and task is left, which Spark adds up by dimension as decimals.  Without ``about``
    only the sums are taken.
    """
    centre = None if about is None else np.array(about, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = entries(batch["embedding"])
            n += len(x)
            if centre is None:
                first += [sum(map(int, c)) if np.abs(c).sum() >= MOST_ENTRY else int(c.sum()) for c in x.T]
                continue
            x = x - centre
            most = float(np.abs(x).max(initial=0))
            rows = int(MOST_ENTRY / max(1.0, most * most))
            if rows:
                for at in range(0, len(x), min(rows, ROWS_AT_ONCE)):
                    part = x[at : at + min(rows, ROWS_AT_ONCE)]
                    first += part.sum(axis=0).astype(np.int64).astype(object)
                    second += (part.T @ part).astype(np.int64).astype(object)
            else:
                for row in x:
                    whole = np.array([int(c) for c in row], object)
                    first += whole
                    second += np.outer(whole, whole)
        if n:
            right = [str(v) for v in second[np.triu_indices(d)]] if centre is not None else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(d), *range(d, d + len(right))], pa.int32()), pa.array([str(n), *map(str, first), *right], pa.string())], ["place", "value"]
            )

    parts = vectors.select("embedding").mapInArrow(run, "place INT, value STRING")
    total = {r.place: int(r.value) for r in parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    second = [[0] * d for _ in range(d)]
    if centre is not None:
        for place, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
            second[i][j] = second[j][i] = total.get(d + place, 0)
    return total.get(-1, 0), [total.get(i, 0) for i in range(d)], second


def covariance(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """``n``, the sums per dimension and the covariance (divisor n), each of its entries the nearest double.

    Entries are centred at the whole number next to the mean before they are multiplied; the mean's fraction, half a unit
    at most, is taken out of the exact sums as a fraction.
    """
    n, first, _ = sums(vectors, d)
    if not n:
        return 0, first, np.zeros((d, d))
    about = [round(Fraction(s, n)) for s in first]
    _, rest, products = sums(vectors, d, about)
    return n, first, np.array([[float(Fraction(n * products[i][j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])


# --- the operator -----------------------------------------------------------------------------------------------------


def common_length(vectors: DataFrame) -> int:
    """The length that most vectors have; of lengths equally frequent, the longest."""
    row = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """:data:`WHITENED`: for each vector and each of the first ``most`` components its whitened coordinate.

    Four passes over the vectors: sums, centred products, the covariance of what comes out (``identity_error``), the rows.
    The driver and each task hold matrices of the vectors' dimension, whatever the number of vectors.

    Defined cases: vectors that are null or hold null or non-finite entries are dropped, as are those of another length than
    most vectors have, and empty ones; repeated ids and rows give rows each and count each in the fit; components whose
    variance is nothing but rounding (constant dimensions, fewer vectors than dimensions) cannot be whitened and give no
    rows; a deviation beyond 64 bits is null; an entry beyond 2 ** 53 after scaling fails the query with a message; an
    empty table gives no rows; further columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = usable(embeddings)
    d = common_length(vectors)
    if not d:
        return spark.createDataFrame([], WHITENED)
    too_large = F.exists("embedding", lambda c: F.abs(c.cast("double")) > MOST_ENTRY // SCALE - SHIFT)
    checked = F.when(too_large, F.raise_error(F.lit("whiten: an entry is beyond 2 ** 53 after scaling"))).otherwise(F.col("embedding"))
    vectors = vectors.where(F.size("embedding") == d).select("vec_id", checked.alias("embedding"))
    n, total, v = covariance(vectors, d)
    values, basis = eigenvectors(v)
    kept = [k for k in range(min(most, d)) if values[k] > d * EPS * values[0]]
    about = [round(Fraction(s, n)) for s in total]
    rest = np.array([float(Fraction(s, n) - m) for s, m in zip(total, about, strict=True)])
    centre, axes = np.array(about, np.float64), basis[:, kept] / np.sqrt(values[kept])
    explained = values[kept] / max(np.trace(v), np.finfo(np.float64).tiny)

    def coordinates(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - rest) @ axes

    error = identity_error(vectors, coordinates, len(kept), n)
    remainder = [s - n * m for s, m in zip(total, about, strict=True)]

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum) ** 2: in 64-bit integers where all fit, else in Python's."""
        near = x - centre
        if float(np.abs(near).max(initial=0)) * n + max(map(abs, remainder), default=0) < math.sqrt(2.0**62 / max(d, 1)):
            return ((near.astype(np.int64) * n - np.array(remainder, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((int(c) * n - r) ** 2 for c, r in zip(row, remainder, strict=True)) for row in near]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(kept)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = entries(part["embedding"])
                rows = len(x)
                ids = part["vec_id"].take(pa.array(np.repeat(np.arange(rows), k)))
                deviation = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)), deviation,
                    pa.array(coordinates(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in WHITENED.split(", ")])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, WHITENED)


def identity_error(vectors: DataFrame, coordinates, k: int, n: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all of them.

    Coordinates are centred already; what rounding leaves of their mean is taken out by the sums of the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                w = coordinates(entries(batch["embedding"].slice(at, ROWS_AT_ONCE)))
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], ["place", "value"])

    if not k:
        return 0.0
    total = {r.place: r.value for r in vectors.select("embedding").mapInArrow(run, "place INT, value DOUBLE").groupBy("place").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([total[i] for i in range(k)]) / n
    square = np.array([total[k + i] for i in range(k * k)]).reshape(k, k) / n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
