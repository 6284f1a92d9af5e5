"""Embedding whitening with an exact bit-sliced scatter matrix.

Entries become integers. In a block of rows each dimension, shifted by its
smallest value there, is cut into bit planes, and each plane is packed across
the rows into 64-bit words. The cross-product of two dimensions is the sum,
over their planes a and b, of 2^(a + b) times the number of rows that have both
bits: an AND and a popcount. Blocks are added as integers, and the scatter
matrix is centred as integers before anything is rounded.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 4096  # rows whose planes are packed at once
_WIDE = pa.decimal128(38, 0)


def _entries(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) of the usable vectors of a batch, in blocks."""
    lists = batch.column(column)
    for at in range(0, len(lists), size):
        part = lists.slice(at, size)
        flat = part.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
        lengths = part.value_lengths().fill_null(-1).to_numpy()
        real = np.maximum(lengths, 0)
        row = np.repeat(np.arange(len(part)), real)
        bad = np.zeros(len(part), bool)
        bad[row[~np.isfinite(values)]] = True
        use = (lengths >= 0) & ~bad
        if not use.any():
            continue
        width = np.unique(lengths[use])
        if len(width) > 1:
            raise ValueError(f"vectors of {width.min()} and of {width.max()} entries")
        scaled = np.floor(values[use[row]].reshape(-1, width[0]) * SCALE)
        if scaled.size and np.abs(scaled).max() >= 2.0**62:
            raise ValueError("an entry does not fit a 64-bit integer")
        yield at + np.flatnonzero(use), scaled.astype(np.int64) + SHIFT


def plane_products(y: np.ndarray) -> np.ndarray:
    """The exact cross-products, as Python integers, of the columns of a
    non-negative matrix of rows by dimensions."""
    bits = [max(1, int(v).bit_length()) for v in y.max(axis=0)]
    owner = np.repeat(np.arange(y.shape[1]), bits)
    level = np.concatenate([np.arange(b) for b in bits])
    pad = -len(y) % 64
    flags = np.empty((len(owner), len(y) + pad), np.uint8)
    flags[:, len(y):] = 0
    for p, (d, b) in enumerate(zip(owner, level)):
        flags[p, : len(y)] = (y[:, d] >> b) & 1
    planes = np.packbits(flags, axis=1).view(np.uint64)
    begin = np.searchsorted(owner, np.arange(y.shape[1]))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for p in range(len(owner)):
        d = owner[p]
        both = np.bitwise_count(planes[p] & planes[begin[d]:]).sum(axis=1, dtype=np.int64)
        weight = level[begin[d]:] + level[p]
        if weight.max() < 62 - len(y).bit_length() - max(bits).bit_length():
            total[d, d:] += np.add.reduceat(both << weight, begin[d:] - begin[d])
        else:
            total[d, d:] += np.add.reduceat(both.astype(object) * (1 << weight.astype(object)), begin[d:] - begin[d])
    lower = np.tril_indices(y.shape[1], -1)
    total[lower] = total.T[lower]
    return total


def _scatter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this task's rows: their number (i = j = -1), the sums (j = -1) and the
    cross-products (i <= j) of the entries less ``SHIFT``."""
    n, sums, cross, width = 0, None, None, None
    for batch in batches:
        for _, x in _entries(batch, "vector"):
            if width not in (None, x.shape[1]):
                raise ValueError(f"vectors of {width} and of {x.shape[1]} entries")
            width, low = x.shape[1], x.min(axis=0)
            y = x - low
            part = plane_products(y) if width else np.zeros((0, 0), object)
            least = (low - SHIFT).astype(object)  # x - SHIFT = y + least
            s = np.array([sum(map(int, c)) for c in y.T], object) if y.max(initial=0) > 1 << 40 else y.sum(axis=0).astype(object)
            part = part + np.outer(least, s) + np.outer(s, least) + len(x) * np.outer(least, least)
            s = s + len(x) * least
            n, sums, cross = n + len(x), s if sums is None else sums + s, part if cross is None else cross + part
    if n:
        i, j = np.triu_indices(width)
        rows = [(-1, -1, n), *((d, -1, v) for d, v in enumerate(sums)), *zip(i.tolist(), j.tolist(), cross[i, j])]
        at, to, value = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(to, pa.int32()),
                                          pa.array([decimal.Decimal(int(v)) for v in value], _WIDE)], names=["i", "j", "v"])


class Whitening:
    """n, exact integer sums ``s`` of the entries, ``centre`` = s / n, the
    covariance ``cov``, its ``trace``, and of the first components the
    eigenvalues ``e`` and the vectors ``axes`` (columns)."""

    def __init__(self, n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int):
        d = len(sums)
        self.n, self.s = n, [v + n * SHIFT for v in sums]
        self.cov = np.empty((d, d))
        for (i, j), g in cross.items():  # n^2 times the covariance is an integer; one rounding
            self.cov[i, j] = self.cov[j, i] = (n * g - sums[i] * sums[j]) / (n * n)
        e, axes = np.linalg.eigh(self.cov) if d else (np.zeros(0), np.zeros((0, 0)))
        first = np.argsort(-e, kind="stable")[:components]
        self.e, axes = e[first], axes[:, first]
        big = np.abs(axes).argmax(axis=0) if d else np.zeros(0, int)
        self.axes = axes * np.where(axes[big, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        self.trace = float(np.trace(self.cov))
        # an eigenvalue that rounding cannot tell from zero has no whitened scale
        self.usable = self.e > d * np.finfo(float).eps * max(self.e.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - s as exact integers: 64-bit if they fit, else Python's."""
        big = max([abs(self.n * int(v) - s) for c, s in zip(x.T, self.s) for v in (c.min(), c.max())], default=0)
        if big * big * max(1, len(self.s)) < 1 << 62:
            return x * self.n - np.array(self.s, np.int64)
        return x.astype(object) * self.n - np.array(self.s, object)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Deviation (exact) of each row and its whitened components; those
        without a scale are NaN."""
        dev = self.centred(x)
        total = (dev * dev).sum(axis=1) if dev.shape[1] else np.zeros(len(x), np.int64)
        if dev.dtype == object and any(v >= 1 << 63 for v in total):
            raise OverflowError("a deviation does not fit a 64-bit integer")
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (dev / self.n).astype(np.float64) @ self.axes / np.sqrt(np.where(self.usable, self.e, np.nan))
        return total.astype(np.int64), out


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on every vector without null or non-finite entries; entry c counts
    as floor(64 * c) + 1,000,000. One scan; each task adds one row per pair of
    dimensions, these are summed as decimals, and one matrix (bounded by the
    dimension) comes to the driver. Vectors of different lengths raise. None if
    there is no vector."""
    parts = vectors.select(F.col(column).alias("vector")).mapInArrow(_scatter_rows, "i int, j int, v decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # 1 + d + d * (d + 1) / 2 rows
    values = {(r["i"], r["j"]): int(r["v"]) for r in rows}
    if not values:
        return None
    n = values.pop((-1, -1))
    sums = [values.pop((d, -1)) for d in range(sum(j == -1 for _, j in values))]
    return Whitening(n, sums, values, components)


def _moments(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.e)
    sums, cross = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        for _, x in _entries(batch, "vector"):
            w = model.apply(x)[1]
            sums += w.sum(axis=0)
            cross += w.T @ w
    i, j = np.triu_indices(k)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(k), i]), pa.int32()),
                                      pa.array(np.concatenate([np.full(k, -1), j]), pa.int32()),
                                      pa.array(np.concatenate([sums, cross[i, j]]))], names=["i", "j", "v"])


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the
    identity, over the components with a scale, measured on all rows."""
    rows = vectors.select(F.col(column).alias("vector")).mapInArrow(partial(_moments, model=model), "i int, j int, v double")
    rows = rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # bounded by the components
    value = {(r["i"], r["j"]): r["v"] / model.n for r in rows}
    use = [d for d in range(len(model.e)) if model.usable[d]]
    errors = [abs(value[i, j] - value[i, -1] * value[j, -1] - (i == j)) for i in use for j in use if i <= j]
    return max(errors, default=None)


def _whitened_rows(batches: Iterator[pa.RecordBatch], model: Whitening, error: float | None) -> Iterator[pa.RecordBatch]:
    k = len(model.e)
    for batch in batches:
        for rows, x in _entries(batch, "vector"):
            deviation, w = model.apply(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(rows, k)))
            flat, m = w.ravel(), len(rows) * k
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(m, model.n, np.int64)),
                 pa.array(np.repeat(deviation, k)), pa.array(flat, mask=np.isnan(flat)),
                 pa.array(np.tile(model.e / model.trace if model.trace else np.full(k, np.nan), len(rows)), from_pandas=True),
                 pa.array([error] * m, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened principal components of the usable vectors, a row per vector
    and component: vec_id, component (from 1, by falling eigenvalue), n,
    deviation (exact sum of (n * x - S)^2), whitened, explained (share of the
    trace), identity_error.

    Vectors that are null or hold a null, NaN or infinite entry are dropped. A
    component's largest loading is positive. Where the eigenvalue is zero (a
    constant or dependent dimension) whitened is null and the component does
    not count in identity_error; if nothing varies, explained is null too.
    Repeated rows and null ids are kept; an empty table, or vectors of no
    entries, give no rows; vectors of different lengths raise; other columns
    are ignored.
    """
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("vector"))
    kind = src.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(src, "vector", components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(src, model, "vector")
    return src.mapInArrow(partial(_whitened_rows, model=model, error=error), schema)
