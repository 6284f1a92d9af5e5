"""k-means whose result depends on the rows alone: seeds by squared-distance
draws keyed on the rows, Lloyd steps as one aggregate each.

Features lie on a grid (integers), so the sums of a step are exact and the
same under any partitioning; a draw is decided by a hash of the row's key, not
by the order of rows. All fits of a series (several numbers of clusters) share
the seeds and advance together, one scan a step.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = 2_147_483_647
BLOCK = 1 << 14  # rows of a block
_WIDE = pa.list_(pa.decimal128(38, 0))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each integer key and draw: a quadratic step
    between two linear ones, modulo a prime, in 64-bit integers."""
    h = (keys % PRIME * 48_271 + draw * 69_621) % PRIME
    h = (h * h + 11) % PRIME
    return ((h * 16_807 + draw) % PRIME + 1) / (PRIME + 1.0)


def square_distances(x: np.ndarray, centre: Sequence[float]) -> np.ndarray:
    """Squared distances, the dimensions added in order."""
    total = None
    for d, c in enumerate(centre):
        off = x[:, d] - c
        off *= off
        total = off if total is None else np.add(total, off, out=total)
    return total


def _pack(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, x0, x1, ...) as blocks: their keys and points as bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            cols = [c.to_numpy() for c in batch.slice(i, BLOCK).columns]
            yield pa.RecordBatch.from_arrays([pa.array([cols[0].tobytes()]), pa.array([np.stack(cols[1:]).tobytes()])], names=["keys", "x"])


def blocks(rows: DataFrame, key: str, points: Sequence[str]) -> DataFrame:
    """The integer columns of ``rows`` dealt evenly to the shuffle partitions
    and packed, so that a step reads a few long values a task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, *points).repartition(parts, F.xxhash64(key, *points))
    return dealt.mapInArrow(partial(_pack, d=len(points)), "keys binary, x binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for keys, x in zip(batch.column("keys"), batch.column("x")):
            k = np.frombuffer(keys.as_buffer(), np.int64)
            yield k, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, len(k)).T


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of this task, their exact sums and sums of squares."""
    n, total, square = 0, 0, 0
    for keys, x in _blocks(batches):
        high, low = x >> 20, x & 0xFFFFF
        h2, hl, l2 = ((a * b).sum(axis=0).astype(object) for a, b in ((high, high), (high, low), (low, low)))
        n, total = n + len(keys), total + x.sum(axis=0).astype(object)
        square = square + (h2 << 40) + (hl << 21) + l2
    if n:
        wide = [pa.array([[decimal.Decimal(int(v)) for v in c]], _WIDE) for c in (total, square)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *wide], names=["n", "s", "q"])


def spread(rows: DataFrame, d: int) -> tuple[int, list[int], list[int]]:
    """Number of rows, exact sums and sums of squares of blocks."""
    parts = rows.mapInArrow(_spread, "n long, s array<decimal(38,0)>, q array<decimal(38,0)>")
    r = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in "sq" for i in range(d)]).first()
    return r["n"] or 0, [int(r[f"s{i}"] or 0) for i in range(d)], [int(r[f"q{i}"] or 0) for i in range(d)]


def _race(batches: Iterator[pa.RecordBatch], seeds: list[list[float]], draw: int) -> Iterator[pa.RecordBatch]:
    """This task's row with the smallest -ln(u) / (squared distance to the
    nearest seed): over all rows, a draw in proportion to that distance."""
    best = None
    for keys, x in _blocks(batches):
        time = -np.log(uniform(keys, draw))
        if seeds:
            far = np.min([square_distances(x, s) for s in seeds], axis=0)
            with np.errstate(divide="ignore"):
                time = np.where(far > 0, time / far, np.inf)
        for i in np.flatnonzero(time == time.min(initial=np.inf)).tolist():
            row = (float(time[i]), int(keys[i]), x[i].tolist())
            if np.isfinite(row[0]) and (best is None or row < best):
                best = row
    if best:
        yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.int64()), pa.array([best[2]], pa.list_(pa.int64()))],
                                         names=["time", "key", "x"])


def draw_seeds(rows: DataFrame, k: int, seed: int) -> list[list[float]]:
    """Up to ``k`` seeds of the rows of blocks; fewer if fewer rows differ. The
    first seeds of a larger ``k`` are those of a smaller one."""
    seeds: list[list[float]] = []
    for m in range(k):
        first = rows.mapInArrow(partial(_race, seeds=seeds, draw=seed + m), "time double, key long, x array<long>") \
            .agg(F.min(F.struct("time", "key", "x")).alias("best")).first()["best"]
        if first is None:
            break
        seeds.append([float(v) for v in first["x"]])
    return seeds


def nearest(x: np.ndarray, centres: Sequence[Sequence[float]]) -> np.ndarray:
    """Number of the nearest centre, the first of equally near ones."""
    return np.argmin([square_distances(x, c) for c in centres], axis=0)


def _step(batches: Iterator[pa.RecordBatch], fits: list[list[list[float]]]) -> Iterator[pa.RecordBatch]:
    """One row: per centre of every fit its rows of this task and their sums."""
    counts, sums = [np.zeros(len(c), np.int64) for c in fits], [np.zeros((len(c), len(c[0])), np.int64) for c in fits]
    for _, x in _blocks(batches):
        points = x.astype(np.float64)
        small = np.abs(x).max(initial=0) < (1 << 53) // BLOCK  # a block's sums are exact in doubles
        for n, total, centres in zip(counts, sums, fits):
            label, k = nearest(points, centres), len(centres)
            if small:
                total += np.stack([np.bincount(label, points[:, i], k) for i in range(x.shape[1])], axis=1).astype(np.int64)
            else:
                np.add.at(total, label, x)
            n += np.bincount(label, minlength=k)
    flat = np.concatenate([np.column_stack([n, total]).ravel() for n, total in zip(counts, sums)])
    yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()])], names=["sums"])


def label_sums(rows: DataFrame, fits: dict[int, list[list[float]]]) -> dict[int, list[tuple[int, list[int]]]]:
    """Per fit and centre the number of its rows and their exact sums: one scan
    in one stage. A task gives one short row, and blocks lie in a stated number
    of partitions, so what reaches the driver is bounded by partitions and
    centres, not by rows."""
    parts = rows.mapInArrow(partial(_step, fits=list(fits.values())), "sums binary").toArrow()
    flat = np.stack([np.frombuffer(v.as_buffer(), np.int64) for v in parts.column("sums")])
    high, low = (flat >> 32).sum(axis=0).tolist(), (flat & 0xFFFFFFFF).sum(axis=0).tolist()
    total, out, at = [(h << 32) + v for h, v in zip(high, low)], {}, 0
    for f, centres in fits.items():
        width = len(centres[0]) + 1
        cells = [total[at + j * width:at + (j + 1) * width] for j in range(len(centres))]
        out[f] = [(c[0], c[1:]) for c in cells]
        at += width * len(centres)
    return out


def lloyd(rows: DataFrame, starts: dict[int, list[list[float]]], tolerance: float, max_iter: int) -> dict[int, list[list[float]]]:
    """The centres of each fit after steps that stop when the squared shifts
    of its centres add up to at most ``tolerance``, or after ``max_iter``. All
    fits that still move share a scan. A centre without rows stays."""
    done: dict = {}
    moving = dict(starts)
    for _ in range(max_iter):
        got = label_sums(rows, moving)
        for f, centres in list(moving.items()):
            new = [[float(s) / n for s in sums] if n else c for c, (n, sums) in zip(centres, got[f])]
            shift = sum((a - b) * (a - b) for c, e in zip(centres, new) for a, b in zip(c, e))
            moving[f] = new
            if shift <= tolerance:
                done[f] = moving.pop(f)
        if not moving:
            break
    return {**done, **moving}
