"""Embedding whitening by incremental eigendecomposition (operator 12).

A spectrum (eigenvalues and eigenvectors of a centred scatter matrix) takes one vector more by a
rank-one update: the eigenvalues move to the roots of the secular equation, and directions that the
update does not reach, or that share an eigenvalue, are deflated.  Tasks build the spectra of their
vectors, spectra are combined by one rank-one update for each of the smaller one's directions and one
for the distance of the means, level by level on the executors, and the driver sees the last one only.
That spectrum is the start of a Rayleigh-Ritz step over all vectors: they are projected on it, the
small matrix of the projections is summed exactly centred, and its eigenvectors turn the directions.

A task's vectors come in blocks.  The triangular factor of a centred block has the same scatter as
the block in at most as many rows as there are dimensions, so those rows are the updates.  All that is
held or sent is bounded by the square of the dimensions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.session import cut_lineage
from claimgraph.sources.files import scratch_folder

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Vectors whose triangular factor gives the updates; with 1, every vector is an update of its own.
BLOCK_ROWS = 4096
#: Spectra that one task combines.
FAN_IN = 16
#: Eigenvalues below this share of the largest one are rounding.
LEAST_SHARE = 1e-13
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (d_j - x) for rising distinct ``d`` and nonzero ``z``, one above each ``d``.

    (origin, offset): a root is ``d[origin] + offset`` with the nearest pole as its origin, so that
    differences to poles keep their digits.  Each step fits one pole on either side of the root; a
    step that leaves the bracket is halved instead.
    """
    m = len(d)
    z2 = z * z
    gap = np.append(np.diff(d), z2.sum())
    at = np.arange(m)
    near = d[None, :] - d[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = 1 + (z2 / (near - gap[:, None] / 2)).sum(axis=1)
    origin = np.where((middle >= 0) | (at == m - 1), at, at + 1)
    poles = d[None, :] - d[origin][:, None]
    low = np.where(origin == at, 0.0, -gap / 2)
    high = np.where(origin == at, np.where(at == m - 1, gap * (1 + 64 * _EPS), gap / 2), 0.0)
    x = (low + high) / 2
    left = at[None, :] <= at[:, None]
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            away = poles - x[:, None]
            term = z2 / away
            f = 1 + term.sum(axis=1)
            size = 1 + np.abs(term).sum(axis=1)
            slope = term / away
            psi, phi = np.where(left, slope, 0).sum(axis=1), np.where(left, 0, slope).sum(axis=1)
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            done = (np.abs(f) <= 8 * _EPS * m * size) | (high - low <= _EPS * np.maximum(np.abs(low), np.abs(high)))
            if done.all():
                break
            here, there = away[at, at], away[at, np.minimum(at + 1, m - 1)]
            c = f - here * psi - there * phi
            a = (here + there) * f - here * there * (psi + phi)
            b = here * there * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = here[-1] * f[-1] / (f[-1] - here[-1] * psi[-1])
            new = x + step
            # Halving an interval that ends at a pole halves the digits, not the length.
            edge = np.where(low > 0, np.sqrt(np.abs(low * high)), np.where(high < 0, -np.sqrt(np.abs(low * high)), (low + high) / 2))
            inside = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, edge))
    return origin, x


def update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``vectors diag(values) vectors' + v v'``."""
    z = vectors.T @ v
    norm = np.sqrt(z @ z)
    if norm == 0:
        return values, vectors
    scale = max(abs(values[-1]), norm * norm)
    tolerance = 8 * _EPS * scale
    vectors = vectors.copy()
    # Equal eigenvalues: a reflection within their space leaves the update one direction of it.
    starts = np.flatnonzero(np.append(True, np.diff(values) > tolerance))
    for start, stop in zip(starts, np.append(starts[1:], len(values)), strict=True):
        part = z[start:stop]
        length = np.sqrt(part @ part)
        if stop - start > 1 and length > 0:
            mirror = part.copy()
            sign = 1.0 if mirror[-1] >= 0 else -1.0
            mirror[-1] += sign * length
            mirror /= np.sqrt(mirror @ mirror)
            vectors[:, start:stop] -= 2 * np.outer(vectors[:, start:stop] @ mirror, mirror)
            z[start:stop] = 0
            z[stop - 1] = -sign * length
    live = np.abs(z) * norm > tolerance
    if not live.any():
        return values, vectors
    d, z = values[live], z[live]
    origin, offset = secular_roots(d, z)
    away = (d[None, :] - d[origin][:, None]) - offset[:, None]  # pole j minus root i
    away = np.where(away == 0, _EPS * scale, away)
    # The update whose exact roots these are: eigenvectors from it are orthogonal whatever the error of the roots.
    m = len(d)
    apart = d[None, :] - d[:, None]
    # Interlacing: a root below j goes with the pole at its own place, one from j on with the pole above it.
    poles = np.where(np.tri(m, k=-1, dtype=bool), apart, np.column_stack([apart[:, 1:], np.ones(m)]))
    fitted = np.sign(z) * np.sqrt(np.abs(np.prod(-away.T / poles, axis=1)))
    turn = fitted[:, None] / away.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    out = values.copy()
    out[live] = d[origin] + offset
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(out, kind="stable")
    return out[order], vectors[:, order]


class Spectrum:
    """Number, mean and spectrum of the centred scatter of some vectors."""

    def __init__(self, dims: int) -> None:
        self.n, self.mean = 0, np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        if self.n:
            apart = (mean - self.mean) * np.sqrt(self.n / (self.n + n) * n)
            self.values, self.vectors = update(self.values, self.vectors, apart)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, block: np.ndarray) -> None:
        """Take the rows of ``block``."""
        mean = block.mean(axis=0)
        rows = block - mean
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        for row in rows if len(block) > 1 else ():
            self.values, self.vectors = update(self.values, self.vectors, row)
        self._shift(len(block), mean)

    def combine(self, other: Spectrum) -> None:
        """Take all that ``other`` has taken."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = update(self.values, self.vectors, np.sqrt(value) * vector)
        self._shift(other.n, other.mean)

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, data: bytes, dims: int) -> Spectrum:
        numbers, out = np.frombuffer(data, "<f8"), cls(dims)
        out.n, out.mean = int(numbers[0]), numbers[1:dims + 1].copy()
        out.values, out.vectors = numbers[dims + 1:2 * dims + 1].copy(), numbers[2 * dims + 1:].reshape(dims, dims).copy()
        return out


def quantised(table: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): vectors in whole numbers; a row goes if its vector is null or empty, or has an entry that is null, not finite
    or, scaled, beyond 62 bits."""
    def scaled(c: Column) -> Column:
        return F.lit(float(scale)) * c

    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < float(1 << 62)))
    return table.where(F.coalesce((F.size(v) > 0) & usable, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(scaled(c)) + F.lit(shift)).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def per_task(vectors: DataFrame, dims: int, start: Callable[[], object], take: Callable[[object, np.ndarray], None],
             pack: Callable[[object], bytes]) -> DataFrame:
    """(id, data): what every task makes of its vectors ``x``, in blocks of bounded size."""
    def run(batches):
        state = start()
        seen = False
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), BLOCK_ROWS):
                take(state, x[at:at + BLOCK_ROWS])
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"id": [TaskContext.get().partitionId()], "data": [pack(state)]})

    return vectors.select("x").mapInArrow(run, "id bigint, data binary")


def folded(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes:
    """All ``data`` of ``parts`` merged into one, ``FAN_IN`` at a time on the executors; the driver receives the last one."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        return pa.table({"id": pa.array([group["id"][0].as_py() // FAN_IN], pa.int64()),
                         "data": pa.array([merge(group["data"].to_pylist())], pa.binary())})

    parts = cut_lineage(parts)
    last = parts.agg(F.max("id")).first()[0]
    while last > 0:
        parts = parts.groupBy(F.floor(F.col("id") / FAN_IN).alias("place")).applyInArrow(run, "id bigint, data binary")
        last //= FAN_IN
    return bytes(parts.select(F.col("data")).first()[0]) if last == 0 else b""


def sums(parts: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p, "<f8") for p in parts], axis=0).astype("<f8").tobytes()


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``components`` has a unit eigenvector a column, by falling ``values``."""

    n: int
    totals: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts first, so that no digit of them is lost."""
        whole = np.array([t // self.n for t in self.totals], np.int64)
        return (x - whole).astype(float) - np.array([t % self.n / self.n for t in self.totals])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None if it passes 63 bits."""
        whole = np.array([t // self.n for t in self.totals], np.int64)
        rest = np.array([t % self.n for t in self.totals], np.int64)
        away = x - whole
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return (((away * self.n - rest) ** 2).sum(axis=1)).tolist()
        exact = ((away.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1)
        return [int(e) if e < 1 << 63 else None for e in exact]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading ``components`` of the distinct vectors ``x`` of ``vectors``, each counted once; None without a vector.

    Of vectors of several lengths those of the most frequent one count (ties: the longest).  Directions
    without variance are left out, so there may be fewer components, or none.
    """
    spark = vectors.sparkSession
    folder = scratch_folder(spark)
    vectors.select("x").distinct().write.parquet(folder)
    listed = spark.read.parquet(folder)
    lengths = listed.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    dims, n = lengths["d"], lengths["n"]
    listed = listed.where(F.size("x") == dims)
    totals = _totals(listed, dims)

    # A first guess of every eigenvector, from one pass of rank-one updates.
    def join(parts: list[bytes]) -> bytes:
        first, *others = [Spectrum.unpack(p, dims) for p in parts]
        for other in others:
            first.combine(other)
        return first.pack()

    origin = np.array([t // n for t in totals], np.int64)
    guess = Spectrum.unpack(folded(per_task(
        listed, dims, lambda: Spectrum(dims), lambda s, x: s.add((x - origin).astype(float)), Spectrum.pack), join), dims)
    basis = np.linalg.qr(guess.vectors[:, ::-1])[0]

    # Rayleigh-Ritz: the covariance of all vectors within that basis.
    model = Whitening(n, totals, basis, np.zeros(dims), 0.0, 0.0)
    ritz = _gram(listed, dims, model, basis) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    trace = float(np.trace(ritz))
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > LEAST_SHARE * trace][:components]
    chosen, values = basis @ turn[:, order], values[order]
    error = 0.0
    if len(order):
        whitened = _gram(listed, dims, model, chosen / np.sqrt(values)) / n
        error = float(np.abs(whitened - np.eye(len(order))).max())
    return Whitening(n, totals, chosen, values, trace, error)


def _totals(listed: DataFrame, dims: int) -> list[int]:
    """Exact sum of every dimension."""
    def run(batches):
        total = np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            # Halves of 32 bits add up without leaving 64 bits in a batch.
            total = total + ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"d": pa.array(range(dims), pa.int32()), "s": pa.array(map(str, total))})

    found = (listed.select("x").mapInArrow(run, "d int, s string")
             .groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    return [int(r["s"]) for r in sorted(found)]


def _gram(listed: DataFrame, dims: int, model: Whitening, directions: np.ndarray) -> np.ndarray:
    """Sum over all vectors of the outer products of their centred projections on ``directions``."""
    k = directions.shape[1]

    def take(total: np.ndarray, x: np.ndarray) -> None:
        y = model.centred(x) @ directions
        total += y.T @ y

    parts = per_task(listed, dims, lambda: np.zeros((k, k)), take, lambda total: total.astype("<f8").tobytes())
    return np.frombuffer(folded(parts, sums), "<f8").reshape(k, k)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): every vector of the fitted length, projected on the components over their standard deviations."""
    dims = len(model.totals)
    directions = model.components / np.sqrt(model.values)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            y = model.centred(x) @ directions
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], y.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(x), pa.int64()), lists],
                                             ["vec_id", "deviation", "whitened"])

    return (vectors.where(F.size("x") == dims).select("vec_id", "x")
            .mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>"))


def report(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component.

    Rows that ``quantised`` drops give none; repeated rows and ids repeat, a null id stays null, a
    vector counts once in the fit however often it occurs.  Vectors that are all equal have no
    component and an empty table has no row, so both give an empty result.  ``deviation`` is null if it
    passes 63 bits.  Other columns are not read.
    """
    vectors = quantised(table)
    model = fit(vectors, components)
    spark = table.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
                                         "explained double, identity_error double")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return (whiten(vectors, model)
            .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
