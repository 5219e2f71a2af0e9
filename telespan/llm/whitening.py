"""Whitening of embeddings by Jacobi-Davidson.

Entries become integers, x = floor(64 c) + 1000000, and every covariance is
over the fit list: each distinct x vector once. The covariance matrix is never
formed. What the solver needs of it is its product with a few vectors, a pass
over the fit list: each task centres its blocks of vectors, (n x - S) / n with
the numerator as an exact integer, multiplies, and the partial products are
added up on Spark. Only matrices of dimension times a few dozen columns reach
the driver.

The solver keeps a search space and its product. Rayleigh-Ritz gives the
candidates; for all that have not converged the projected correction equation
(I-QQ')(V-theta I)(I-QQ') t = -r is solved by MINRES, in step, so that one pass
over the data serves every candidate. Corrections widen the space; a space that
has grown too wide restarts from its best vectors. A leading pair whose
residual has reached double precision is locked, and later vectors are kept
orthogonal to it. Corrections against eigenvalues that lie in the space in full
vanish, so the solver ends at once when the space is everything.

Defined results: rows whose vector is null, empty, holds null or non-finite
entries, or has not the most frequent length (of two, the larger) are dropped;
extra columns are not read; a row without vec_id is kept; repeated rows are
fitted once and whitened each; components are the first 16, or fewer where the
dimension or the rank of the covariance is smaller, so a table with a single
distinct vector, or an empty one, gives no rows; x is held to 2**62 in size; a
deviation that exceeds a long is null. Each component's largest entry in size
is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telespan.llm.base import query, table
from telespan.scratch import materialize

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
BLOCK_BYTES = 8_000_000  # of one row of the fit list
PARTS_BYTES = 8_000_000  # of partial sums that the driver takes
FAN = 16  # partial sums that one task adds
EPS = np.finfo(np.float64).eps
EXACT = 2.0**62  # integers below it need no wide arithmetic
SEED = 7
SPARE = 4  # vectors beyond the wanted ones
INNER = 6  # MINRES steps to a correction
MOST_ROUNDS = 300
POLISHED = 2  # rounds that a leading pair at its last digits is still improved

WHITENED = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())]
)


def as_integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    return np.clip(scaled, -EXACT, EXACT).astype(np.int64) + SHIFT


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: lengths, whether each can be used, and all entries one after the other (null: nan)."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=~np.isfinite(entries), minlength=len(lengths))
    return lengths, (bad == 0) & (lengths > 0), entries


def rows_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a usable vector of this length, and their x, one row each."""
    lengths, fine, entries = usable(column)
    keep = fine & (lengths == dimension)
    inside = np.repeat(keep, lengths)
    return keep, as_integers(entries[inside]).reshape(-1, dimension)


def dimension_of(vectors: DataFrame) -> int:
    """The most frequent length of usable vectors; 0 without any."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sizes = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    # A length has one count, and only the two best matter.
    best = sizes.groupBy(F.size("embedding").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("b")).first()["b"]
    return best["d"] if best else 0


@dataclass
class FitList:
    """Each distinct x vector once, many to a row: ``block`` holds them as 64-bit integers."""

    rows: DataFrame
    dimension: int
    tasks: int


def fit_list(vectors: DataFrame, dimension: int) -> FitList:

    def packed(batches):
        for batch in batches:
            _, x = rows_of(batch.column(0), dimension)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    def blocks(batches):
        most = max(1, BLOCK_BYTES // (8 * dimension))
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                x = b"".join(v.as_py() for v in batch.column(0)[i : i + most])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["block"])

    distinct = vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(packed, "x binary").distinct()
    rows = materialize(distinct.mapInArrow(blocks, "block binary"), "fit-list")
    return FitList(rows, dimension, rows.rdd.getNumPartitions())


@dataclass
class Centre:
    """Count and exact sums of the fit list."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as 64-bit integers where they fit, else as Python's."""
        most = float(np.abs(x.astype(np.float64)).max(initial=0.0)) * self.n + max(map(abs, self.sums))
        if most < EXACT:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        apart = self.numerators(x)
        most = apart.astype(np.float64)
        if float((most * most).sum(axis=1).max(initial=0.0)) < EXACT:
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum(int(v) * int(v) for v in row) for row in apart]
        return [v if v < 2**63 else None for v in exact]


def added(fit: FitList, part: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
    """The sum over all blocks of ``part(block)``, a vector; every task adds up its own first."""
    dimension = fit.dimension

    def partial(batches):
        total = None
        for batch in batches:
            for block in batch.column(0):
                made = part(np.frombuffer(block.as_py(), dtype=np.int64).reshape(-1, dimension))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part"])

    def merged(batches):
        total = None
        for batch in batches:
            for row in batch.column(0):
                made = np.frombuffer(row.as_py(), dtype=kind)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    rows, tasks = fit.rows.mapInArrow(partial, "part binary"), fit.tasks
    size = 8 * part(np.zeros((1, dimension), dtype=np.int64)).size
    while tasks > FAN and tasks * size > PARTS_BYTES:
        tasks = -(-tasks // FAN)
        rows = rows.repartition(tasks).mapInArrow(merged, "part binary")
    parts = [np.frombuffer(r[0], dtype=kind) for r in rows.collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(size // 8, dtype=kind)


def centre_of(fit: FitList) -> Centre:
    """Halves of the integers are summed apart, so the sums neither round nor overflow."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(np.int64)

    found = added(fit, halves, np.int64).tolist()
    high, low = found[1 : 1 + fit.dimension], found[1 + fit.dimension :]
    return Centre(found[0], [(h << 32) + k for h, k in zip(high, low)])


def product(fit: FitList, centre: Centre, u: np.ndarray) -> np.ndarray:
    """V u for the columns of u: one pass over the fit list."""

    def part(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        return (c.T @ (c @ u)).ravel()

    return added(fit, part).reshape(u.shape) / centre.n


def trace_of(fit: FitList, centre: Centre) -> float:
    return float(added(fit, lambda x: np.array([np.square(centre.centred(x)).sum()]))[0]) / centre.n


def minres(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, small: float) -> np.ndarray:
    """Solve A t = b for every column, each with an A of its own, in step (Paige and Saunders).

    The Lanczos recurrence and the rotations that keep its matrix triangular are
    the usual ones; a column stops changing once its residual has shrunk to
    ``small`` of b or its Krylov space is used up.
    """
    x, direction, before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    norm = np.linalg.norm(b, axis=0)
    alive = norm > 0
    q, q_old, beta = b / np.where(alive, norm, 1.0), np.zeros_like(b), np.zeros_like(norm)
    residual = norm.copy()
    c_old, s_old, c, s = np.ones_like(norm), np.zeros_like(norm), np.ones_like(norm), np.zeros_like(norm)
    for _ in range(steps):
        if not alive.any():
            break
        p = times(q) - beta * q_old
        alpha = (q * p).sum(axis=0)
        p = p - alpha * q
        beta_next = np.linalg.norm(p, axis=0)
        # The new column of the triangular factor: two old rotations, then a new one.
        far, middle = s_old * beta, c_old * beta
        near, diagonal = c * middle + s * alpha, -s * middle + c * alpha
        length = np.hypot(diagonal, beta_next)
        usable_ = alive & (length > 0)
        safe = np.where(usable_, length, 1.0)
        c_old, s_old, c, s = c, s, diagonal / safe, beta_next / safe
        step = (q - near * direction - far * before) / safe
        x = np.where(usable_, x + c * residual * step, x)
        residual = -s * residual
        before, direction = direction, step
        alive = usable_ & (np.abs(residual) > small * norm) & (beta_next > EPS * (np.abs(alpha) + beta))
        q_old, q, beta = q, p / np.where(beta_next > 0, beta_next, 1.0), beta_next
    return x


def orthogonal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """New columns, made orthonormal and orthogonal to the bases; those that add nothing go."""
    out = np.zeros((len(new), 0))
    for v in new.T:
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v = v / length
        for _ in range(3):
            for basis in (*bases, out):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


@dataclass
class Pairs:
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, scale: float) -> Pairs:
    """The leading eigenpairs of the symmetric operator behind ``times``, whose norm is at most ``scale``.

    Residuals end at some roundings of ``scale``; a failure to get there raises.
    """
    wanted = min(wanted, dimension)
    passes = 0

    def counted(u: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(u)

    widest = min(dimension, max(4 * wanted, wanted + 32))
    tight, loose = EPS * scale, 4 * EPS * np.sqrt(dimension) * scale  # products round at about the former
    locked, values = np.zeros((dimension, 0)), []
    space = orthogonal(np.random.default_rng(SEED).standard_normal((dimension, min(dimension, wanted + SPARE))))
    image, waited = counted(space), 0
    for _ in range(MOST_ROUNDS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        open_pairs = min(wanted - len(values), space.shape[1])
        ritz, rimage = space @ turn, image @ turn
        residual = rimage - ritz * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual[:, :open_pairs], axis=0)
        waited = waited + 1 if size[0] <= loose else 0
        goal = loose if waited > POLISHED else tight
        ready = 0
        while ready < open_pairs and size[ready] <= goal:
            ready += 1
        if ready:
            waited = 0
            locked = np.column_stack([locked, ritz[:, :ready]])
            values += theta[:ready].tolist()
            if len(values) >= wanted:
                break
            space, image = ritz[:, ready:], rimage[:, ready:]
            theta, ritz, residual, size = theta[ready:], ritz[:, ready:], residual[:, ready:], size[ready:]
            rimage, open_pairs = rimage[:, ready:], wanted - len(values)
            if not space.shape[1]:
                break
        todo = np.flatnonzero(size > goal)
        shift, u = theta[todo], ritz[:, todo]

        def projected(v: np.ndarray) -> np.ndarray:
            v = v - locked @ (locked.T @ v)
            return v - u * (u * v).sum(axis=0)

        def corrected(v: np.ndarray) -> np.ndarray:
            v = projected(v)
            return projected(counted(v) - v * shift)

        t = minres(corrected, -projected(residual[:, todo]), INNER, 1e-4)
        if space.shape[1] + len(todo) > widest - locked.shape[1] and space.shape[1] > 2 * open_pairs + SPARE:
            keep = 2 * open_pairs + SPARE
            space, image = orthogonal(ritz[:, :keep], locked), None
        fresh = orthogonal(projected(t), locked, space)
        if not fresh.shape[1]:  # nothing left in that direction; a new one restarts the search
            fresh = orthogonal(np.random.default_rng(SEED + passes).standard_normal((dimension, SPARE)), locked, space)
        if not fresh.shape[1]:
            # The space is everything: pairs are exact but for the rounding of its products.
            space, image = orthogonal(ritz, locked), None
        space = np.column_stack([space, fresh])
        image = counted(space) if image is None else np.column_stack([image, counted(fresh)])
    else:
        raise ArithmeticError(f"residuals {size} of {scale}: not at double precision after {MOST_ROUNDS} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return Pairs(np.array(values)[order], locked[:, order], passes)


@dataclass
class Whitening:
    """What the rows need: centre, eigenvalues, eigenvectors, shares of the variance, and the check of the result."""

    dimension: int
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) @ self.vectors) / np.sqrt(self.values)


def whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fitted on the column ``embedding``; None where no component has any variance."""
    d = dimension_of(vectors)
    if not d:
        return None
    fit = fit_list(vectors, d)
    centre = centre_of(fit)
    trace = trace_of(fit, centre)
    if trace <= 0:
        return None
    # The rank is at most n - 1; a pair at the level of rounding is no component.
    wanted = min(components, d, centre.n - 1)
    pairs = jacobi_davidson(lambda u: product(fit, centre, u), d, wanted, trace)
    real = pairs.values > 16 * EPS * d * trace
    u = pairs.vectors[:, real]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    out = Whitening(d, centre, pairs.values[real], u, pairs.values[real] / trace, 0.0, pairs.passes)
    k = u.shape[1]
    mean = added(fit, lambda x: out.project(x).sum(axis=0)) / centre.n

    def outer(x: np.ndarray) -> np.ndarray:
        z = out.project(x) - mean
        return (z.T @ z).ravel()

    covariance = added(fit, outer).reshape(k, k) / centre.n
    out.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    fitted = whitening(rows, components)
    if fitted is None:
        n = F.lit(0).cast("bigint")
        nothing = rows.limit(0).select("vec_id", F.lit(0).alias("component"), n.alias("n"), n.alias("deviation"))
        return nothing.withColumns({c: F.lit(0.0) for c in ("whitened", "explained", "identity_error")})
    k = len(fitted.values)

    def whitened(batches):
        for batch in batches:
            keep, x = rows_of(batch.column(1), fitted.dimension)
            most = max(1, BLOCK_BYTES // (8 * fitted.dimension))
            ids = batch.column(0).filter(pa.array(keep))
            for i in range(0, len(x), most):
                part = x[i : i + most]
                each = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i : i + most].take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                        pa.array(fitted.centre.deviations(part), pa.int64()).take(pa.array(each)),
                        pa.array(fitted.project(part).ravel()),
                    ],
                    schema=WHITENED,
                )

    made = rows.mapInArrow(whitened, "vec_id bigint, component int, deviation bigint, whitened double")
    share = F.element_at(F.array(*[F.lit(float(v)) for v in fitted.explained]), F.col("component"))
    return made.withColumns(
        {"n": F.lit(fitted.centre.n).cast("bigint"), "explained": share, "identity_error": F.lit(fitted.identity_error)}
    )


@query("op12_whitening")
def op12_whitening(spark, sf):
    """Every usable embedding on the 16 leading components of the distinct vectors."""
    return whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
