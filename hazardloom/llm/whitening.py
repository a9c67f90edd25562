"""Embedding whitening by mixed-precision refinement of eigenvectors.

Entries become integers, so that everything summed over rows is exact whatever the
partitioning: tasks centre the distinct vectors on the integers next to the mean, multiply
them in blocks that float64 holds exactly, and Spark adds the results.  The covariance is
decomposed in float32, and Ogita-Aishima iterations, matrix products in extended precision,
correct the eigenvectors; each squares the error.  Eigenvalues closer than the error bound form
a cluster, whose columns are turned by the eigenvectors of their own small matrix, shifted
by the cluster's centre, so that the next iteration tells them apart.

The driver holds matrices of the vectors' length and nothing that grows with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.session import write_and_read

SCALE = 256
COMPONENTS = 4
# Integers up to here are exact in float64.
EXACT = 2**53
LIMB_BITS = 32
MOST_STEPS = 30
Wide = np.longdouble


def as_integers(vector: Column) -> Column:
    """floor(256 * entry) of every entry; null for a vector that is null or holds a null, a non-finite entry or
    one beyond a 64-bit integer."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < float(2**63)))
    return F.when(usable, scaled)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _limbs(value: int):
    """(place, digit) of an integer to the base 2**32; all digits carry its sign, so they can be summed apart."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield place, sign * (rest & (2**LIMB_BITS - 1))
        rest, place = rest >> LIMB_BITS, place + 1


def _exact_totals(table: DataFrame, size: int, centre: list[int] | None) -> tuple[np.ndarray, int]:
    """Exact sums over all rows of ``x``, or of the products of ``x - centre``, as Python integers; and the row count."""

    def measure(batches):
        total, n = np.zeros((size, size) if centre else size, object), 0
        for batch in batches:
            x = _rows(batch.column(0), size)
            n += len(x)
            if centre:
                total += exact_products(x, centre)
            else:
                total += exact_sums(x)
        cells = [(i, p, d) for i, v in enumerate(total.ravel().tolist()) for p, d in _limbs(int(v))]
        names = ["cell", "place", "digit"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, c, strict=True)) for c in [*cells, (-1, 0, n)]], schema)

    schema = pa.schema([("cell", pa.int64()), ("place", pa.int32()), ("digit", pa.int64())])
    digits = table.select("x").mapInArrow(measure, "cell long, place int, digit long")
    # One row per cell of the matrix and place.
    found = digits.groupBy("cell", "place").agg(F.sum("digit").alias("digit")).collect()
    total, n = np.zeros((size, size) if centre else size, object), 0
    for cell, place, digit in found:
        if cell < 0:
            n = digit
        else:
            total.flat[cell] += int(digit) << (LIMB_BITS * place)
    return total, n


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    if len(x) and int(np.abs(x).max(initial=0)) < 2**63 // max(1, len(x)) and int(x.min()) > -(2**62):
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0) if len(x) else np.zeros(x.shape[1], object)


def exact_products(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """The sum of the outer products of the rows of ``x - centre`` as Python integers."""
    total = np.zeros((x.shape[1],) * 2, object)
    bound = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, centre), default=0) + 1
    block = EXACT // bound**2
    if block < 1:
        y = x.astype(object) - np.array(centre, object)
        return total + y.T.dot(y)
    y = (x - np.array(centre, np.int64)).astype(np.float64)
    for at in range(0, len(y), min(block, 2**16)):
        part = y[at : at + min(block, 2**16)]
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def widened(values: np.ndarray) -> np.ndarray:
    """Python integers in extended precision, scaled by a power of two to below 1; the power is returned too."""
    bits = max((abs(int(v)).bit_length() for v in values.flat), default=0)
    half = 2**30

    def one(v: int) -> np.longdouble:
        # Ninety leading bits in three pieces; the rest is below the precision.
        v, out = (int(v) << 90) >> bits, Wide(0)
        sign, v = (-1 if v < 0 else 1), abs(v)
        for piece in (v >> 60, (v >> 30) % half, v % half):
            out = out * half + Wide(piece)
        return Wide(sign) * np.ldexp(out, -90)

    return np.array([one(v) for v in values.flat], Wide).reshape(values.shape), bits


def _clusters(close: np.ndarray) -> list[np.ndarray]:
    """Groups of two and more indices that are linked by ``close`` pairs."""
    group = np.arange(len(close))
    while True:
        lower = np.where(close, group[None, :], len(close)).min(axis=1)
        lower = np.minimum(group, lower)
        if np.array_equal(lower, group):
            break
        group = lower[lower]
    return [np.flatnonzero(group == g) for g in np.unique(group) if (group == g).sum() > 1]


def _slices(matrix: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """Float64 matrices that add up to ``matrix``, each with ``bits`` leading bits of its rows' (columns') rest."""
    out, rest = [], matrix.copy()
    for _ in range(-(-66 // bits)):
        top = np.abs(rest).max(axis=axis, keepdims=True)
        unit = np.ldexp(Wide(1), np.frexp(np.where(top == 0, 1, top))[1] - bits)
        piece = np.rint(rest / unit) * unit
        out.append(piece.astype(np.float64))
        rest = rest - piece
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product in extended precision: float64 products of slices short enough to be exact, added up."""
    bits = (53 - max(1, a.shape[1]).bit_length()) // 2 - 1
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    total = np.zeros((a.shape[0], b.shape[1]), Wide)
    for order in range(len(left) - 1, -1, -1):  # the smallest first
        for i in range(order + 1):
            total += left[i] @ right[order - i]
    return total


def _symmetric(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2


def refine(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix in extended precision, corrected from approximate ones."""
    size, x = len(matrix), vectors.astype(Wide)
    one = np.eye(size, dtype=Wide)
    tiny = np.finfo(Wide).eps
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0))
    best, stalled = np.inf, 0
    for _ in range(MOST_STEPS):
        r = one - _symmetric(product(x.T, x))
        s = _symmetric(product(x.T, product(matrix, x)))
        values = np.diag(s) / (1 - np.diag(r))
        error = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + norm * np.linalg.norm(r.astype(np.float64)))
        # Past the precision the error only moves up and down.
        stalled = stalled + 1 if error > best / 2 else 0
        best = min(best, error)
        if error == 0 or stalled == 3:
            break
        gaps = values[None, :] - values[:, None]
        close = np.abs(gaps) <= error + size * tiny * norm
        step = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gaps))
        x = x + product(x, step)
        for group in _clusters(close):
            part = x[:, group]
            own = _symmetric(product(part.T, product(matrix, part))) - values[group].mean() * _symmetric(product(part.T, part))
            scale = np.abs(own).max()
            if scale > size * tiny * norm:
                x[:, group] = product(part, np.linalg.eigh((own / scale).astype(np.float64))[1].astype(Wide))
    r = one - _symmetric(product(x.T, x))
    return np.diag(product(x.T, product(matrix, x))) / (1 - np.diag(r)), x + product(x, r / 2)


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling, and unit eigenvectors as columns, each with its largest entry positive."""
    start = np.linalg.eigh(covariance.astype(np.float32))[1]
    values, vectors = refine(covariance, start)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors.astype(np.float64)).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1, 1)


@dataclass
class Whitening:
    """A fitted whitening: exact sums of the fit list, and the leading eigenpairs of its covariance."""

    n: int
    sums: list[int]
    eigenvalues: list[float | None]  # None: no spread in that direction
    vectors: np.ndarray  # a column per component
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> list[int]:
        return nearest_means(self.sums, self.n)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer rows; NaN where a component has no spread."""
        centre = self.centre
        rest = [(s - self.n * c) / self.n for s, c in zip(self.sums, centre, strict=True)]
        deviation = _less(x, centre) - np.array(rest)
        scale = np.array([np.nan if e is None else e**-0.5 for e in self.eigenvalues])
        return (deviation @ self.vectors) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)**2 over the dimensions; None beyond a 64-bit integer."""
        centre, n = self.centre, self.n
        rest = np.array([s - n * c for s, c in zip(self.sums, centre, strict=True)], object)
        bound = int(np.abs(_less(x, centre)).max(initial=0)) + 1
        if self.size * ((bound + 1) * n) ** 2 < 2**62:
            y = (x - np.array(centre, np.int64)) * n - rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = (x.astype(object) - np.array(centre, object)) * n - rest
        return [d if d < 2**63 else None for d in (y * y).sum(axis=1).tolist()]


def nearest_means(sums: list[int], n: int) -> list[int]:
    return [(2 * s + n) // (2 * n) for s in sums]


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """``x - centre`` as float64; exact unless the difference needs more than 53 bits."""
    if max(map(abs, centre), default=0) < 2**62 and int(np.abs(x).max(initial=0)) < 2**62 and int(x.min(initial=0)) > -(2**62):
        return (x - np.array(centre, np.int64)).astype(np.float64)
    return (x.astype(object) - np.array(centre, object)).astype(np.float64)


def common_length(rows: DataFrame) -> int:
    """The length most rows of ``x`` have, the greater of equals; 0 for an empty table."""
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    first = lengths.first()
    return first["size"] if first else 0


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """A whitening fitted on the distinct vectors of ``x``, all of one length; None without vectors or entries."""
    table = write_and_read(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit-list")
    size = common_length(table)
    if size == 0:
        return None
    table = table.where(F.size("x") == size)
    sums, n = _exact_totals(table, size, None)
    sums = [int(s) for s in sums]
    centre = nearest_means(sums, n)
    products, _ = _exact_totals(table, size, centre)
    rest = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)
    # n**2 times the covariance, still in integers.
    spread = products * n - np.outer(rest, rest)
    covariance, bits = widened(spread)
    values, vectors = eigenvectors(covariance)
    trace = sum(int(spread[i, i]) for i in range(size))
    floor = size * np.finfo(Wide).eps * 16 * values.max(initial=0)
    eigenvalues = [float(np.ldexp(v / n / n, bits)) if v > floor else None for v in values[:components]]
    explained = [None if trace == 0 else max(0.0, float(v / widened_trace(trace, bits))) for v in values[:components]]
    model = Whitening(n, sums, eigenvalues, vectors[:, :components].astype(np.float64), explained)
    model.identity_error = _identity_error(table, model)
    return model


def widened_trace(trace: int, bits: int) -> np.longdouble:
    """The trace on the scale of the widened matrix."""
    value, own = widened(np.array([trace], object))
    return np.ldexp(value[0], own - bits)


def _identity_error(table: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity, over components with spread."""
    used = [i for i, e in enumerate(model.eigenvalues) if e is not None]
    if not used:
        return None

    def measure(batches):
        total = np.zeros((len(used) + 1,) * 2)
        for batch in batches:
            w = model.project(_rows(batch.column(0), model.size))[:, used]
            w = np.column_stack([np.ones(len(w)), w])
            total += w.T @ w
        cells = [pa.array(range(total.size), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(cells, names=["cell", "value"])

    parts = table.select("x").mapInArrow(measure, "cell int, value double")
    found = parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()  # a row per pair of components
    total = np.zeros((len(used) + 1,) * 2)
    for cell, value in found:
        total.flat[cell] = value
    mean = total[0, 1:] / model.n
    covariance = total[1:, 1:] / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(used))).max())


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """The whitened leading components of every usable row, one output row per component.

    Columns: the id, ``component`` (from 1), ``n`` (vectors of the fit list), ``deviation`` (exact, null
    beyond a 64-bit integer), ``whitened``, ``explained`` and ``identity_error``.  Dropped are rows whose
    vector is null, has a null or non-finite entry or one beyond a 64-bit integer, and rows
    whose vector hasn't the length that most distinct vectors have.  Repeated rows and ids are each returned;
    they count once in the fit list if their vectors are equal.  A component without spread (one distinct
    vector, or more components than independent dimensions) has a null ``whitened``.  Shorter vectors give
    fewer components; without usable vectors the result is empty.
    """
    rows = vectors.select(F.col(f"`{id_col}`"), as_integers(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    model = fit(rows, components)
    kind = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}"
    columns = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"{kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.limit(0).select(id_col, *[F.lit(None).alias(c) for c in columns]).to(_schema_of(rows, schema))
    shown = len(model.eigenvalues)

    def apply(batches):
        for batch in batches:
            x = _rows(batch.column(1), model.size)
            if not len(x):
                continue
            values, at = model.project(x), np.repeat(np.arange(len(x)), shown)
            values = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, shown + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(at), model.n), pa.int64()),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(at)),
                    values,
                    pa.array(model.explained * len(x), pa.float64()),
                    pa.array([model.identity_error] * len(at), pa.float64()),
                ],
                names=[id_col, *columns],
            )

    return rows.where(F.size("x") == model.size).mapInArrow(apply, schema)


def _schema_of(rows: DataFrame, schema: str):
    return rows.sparkSession.createDataFrame([], schema).schema
