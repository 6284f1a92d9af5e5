"""Clustering: standardise, elbow, k-means labels, two principal components,
cluster summary and rule-based cluster descriptions.

Fits are own Spark aggregates over features on a grid (``lloyd``; an exact
moment matrix), so that they do not depend on partitioning; only model
metadata (k centres, 2 loading vectors, 8 costs) reaches the driver. Scores
and labels are plain column expressions afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestats.functions.columns import classify_expr, round_half_even
from zonestats.operators.lloyd import blocks, draw_seeds, label_sums, lloyd, spread

# The rule texts and thresholds of the cluster description,
# in the order the rules are tried (first match wins).
RULE_HIGH_USE = "🔴 Alto consumo / Baja eficiencia"
RULE_LOW_POWER = "🟢 Baja potencia / Alta eficiencia"
RULE_REACTIVE = "🟡 Alta energía reactiva"
RULE_VERY_LOW_PF = "⚠️ Muy baja eficiencia"
RULE_MIXED = "⚪ Comportamiento mixto"
DEFAULT_THRESHOLDS = {
    "active_high": 50000.0,   # active energy above this ...
    "pf_low": 0.85,           # ... and power factor below this: high use / low efficiency
    "power_low": 60.0,        # maximum power below this ...
    "pf_high": 0.95,          # ... and power factor at least this: low power / high efficiency
    "reactive_high": 15000.0,  # reactive energy above this
    "pf_very_low": 0.8,       # power factor below this
}


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "",
                scales: Mapping[str, int] | None = None) -> DataFrame:
    """z = (x - mean) / population std, with a zero std replaced by 1
    (scikit-learn ``StandardScaler``). All means and stds come from one
    aggregate, attached as a single struct-valued scalar subquery (one
    extra pass over the input, no join, no window).
    ``scales`` marks fixed-point columns whose mean is an exact sum."""
    from zonestats.operators.stats import mean_expr
    scales = scales or {}
    stats = df.agg(*[mean_expr(c, scales.get(c)).alias(f"m_{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    st = stats.select(F.struct(*stats.columns).alias("st")).scalar()
    out = df
    for i, c in enumerate(cols):
        sd = st.getField(f"s_{i}")
        sd = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        out = out.withColumn(c + suffix, (F.col(c) - st.getField(f"m_{i}")) / sd)
    return out


def cluster_input(df: DataFrame, cols: Sequence[str],
                  scales: Mapping[str, int] | None = None) -> DataFrame:
    """The reference's clustering input: the rows with complete features,
    standardised. The rows are checkpointed once (shared folder); the
    means/stds and the z-scores are then computed from the checkpoint, so
    the sources are read once however many fits follow."""
    return standardize(_training_input(df, cols), cols, scales=scales)


def _training_input(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The complete feature rows for an iterative fit, written once as a
    reliable checkpoint (the shared ``spark.checkpoint.dir``): the lineage to
    the source joins is cut, and a lost executor's rows are read again, not
    recomputed."""
    from zonestats.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.dropna(subset=list(cols)).persist(StorageLevel.MEMORY_AND_DISK)
    try:  # cached first, so writing the checkpoint does not compute the sources twice
        return rows.checkpoint(eager=True)
    finally:
        rows.unpersist()


# k-means settings of the reference (scikit-learn defaults): up to 300
# Lloyd iterations, relative tolerance 1e-4, seed 42.
KMEANS_MAX_ITER = 300
KMEANS_TOL = 1e-4
GRID = 1_000_000  # grid points of one standard deviation: features count to 6 decimals


def on_grid(c: str) -> Column:
    """A feature as a whole number of grid points."""
    return F.rint(F.col(c) * F.lit(float(GRID))).cast("long")


@contextmanager
def _grid_blocks(df: DataFrame, cols: Sequence[str], key: str | None):
    """Blocks of the complete rows, kept in memory or on disk for the steps."""
    names = [f"_x{i}" for i in range(len(cols))]
    points = df.dropna(subset=list(cols)).select(*([F.col(key).cast("long").alias("_key")] if key else []),
                                                 *[on_grid(c).alias(x) for c, x in zip(cols, names)])
    rows = points if key else points.withColumn("_key", F.xxhash64(*names))
    packed = blocks(rows, "_key", names).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield packed
    finally:
        packed.unpersist()


class Moments:
    """Exact moments of grid points: ``n``, the sums ``s`` and the sums of
    products ``p[i][j]`` as Python integers."""

    def __init__(self, rows: DataFrame, d: int):
        x = [F.col("x")[i].cast("decimal(19,0)") for i in range(d)]
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)],
                     *[F.sum((x[i] * x[j]).cast("decimal(38,0)")).alias(f"p{i}_{j}") for i, j in pairs]).first()
        self.n, self.s = r["n"], [int(r[f"s{i}"] or 0) for i in range(d)]
        self.p = [[int(r[f"p{min(i, j)}_{max(i, j)}"] or 0) for j in range(d)] for i in range(d)]

    def covariance(self) -> list[list[float]]:
        """In grid points, divisor n; one rounding."""
        n, d = self.n, len(self.s)
        return [[(n * self.p[i][j] - self.s[i] * self.s[j]) / (n * n) for j in range(d)] for i in range(d)]


def _tolerance(n: int, total: Sequence[int], square: Sequence[int]) -> float:
    """Squared shift at which steps stop, from the mean variance."""
    return KMEANS_TOL * sum((n * q - s * s) / (n * n) for s, q in zip(total, square)) / len(total)


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 10), seed: int = 42,
          max_iter: int = KMEANS_MAX_ITER, key: str | None = None) -> DataFrame:
    """k-means inertia (within-cluster sum of squares) for each k, on the
    given (already standardised) columns, read to 6 decimals.

    All fits share their seeds (those of a smaller k come first) and advance
    together: one scan a step, until each has come to rest. The result is the
    same under any partitioning and file layout. ``key``: an integer column
    that names a row (draws); without it a row counts by its features. With
    fewer distinct rows than k a fit has as many centres as there are rows; no
    rows give no row.
    """
    with _grid_blocks(df, cols, key) as rows:
        n, total, square = spread(rows, len(cols))
        costs = []
        if n:
            seeds = draw_seeds(rows, max(ks), seed)
            fits = lloyd(rows, {int(k): seeds[:k] for k in ks}, _tolerance(n, total, square), max_iter)
            for k, sums in label_sums(rows, fits).items():
                cost = float(sum(square))
                for centre, (m, s) in zip(fits[k], sums):
                    cost += sum(m * c * c - 2.0 * c * v for c, v in zip(centre, s))
                costs.append((k, cost / GRID**2))
    return df.sparkSession.createDataFrame(sorted(costs), "k int, inertia double")


def kmeans_labels(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42, out: str = "cluster",
                  max_iter: int = KMEANS_MAX_ITER, key: str | None = None) -> DataFrame:
    """The rows with complete features, with a k-means cluster number: the
    nearest of the final centres, numbered in lexicographic order of the
    centres. Features count to 6 decimals; the labels are the same under any
    partitioning and file layout. ``key`` as in ``elbow``."""
    data = df.dropna(subset=list(cols))
    with _grid_blocks(df, cols, key) as rows:
        n, total, square = spread(rows, len(cols))
        if not n:
            return data.withColumn(out, F.lit(None).cast("int"))
        centres = lloyd(rows, {k: draw_seeds(rows, k, seed)}, _tolerance(n, total, square), max_iter)[k]
    centres = sorted(centres)
    points = [on_grid(c).cast("double") for c in cols]
    distances = []
    for c in centres:
        total = None
        for x, v in zip(points, c):
            part = (x - F.lit(v)) * (x - F.lit(v))
            total = part if total is None else total + part
        distances.append(total)
    least = F.least(*distances) if len(distances) > 1 else distances[0]
    return data.withColumn(out, F.array_position(F.array(*distances), least).cast("int") - F.lit(1))


def principal_axes(cov: list[list[float]], sweeps: int = 60) -> tuple[list[float], list[list[float]]]:
    """Eigenvalues, falling, and unit eigenvectors of a small symmetric matrix
    by cyclic rotations; each vector's largest entry is positive."""
    d = len(cov)
    a, v = [list(map(float, r)) for r in cov], [[float(i == j) for j in range(d)] for i in range(d)]
    for _ in range(sweeps):
        off = sum(a[i][j] ** 2 for i in range(d) for j in range(d) if i != j)
        if off <= 1e-32 * sum(a[i][i] ** 2 for i in range(d)):
            break
        for p in range(d - 1):
            for q in range(p + 1, d):
                if a[p][q] == 0.0:
                    continue
                angle = 0.5 * math.atan2(2.0 * a[p][q], a[q][q] - a[p][p])
                c, s = math.cos(angle), math.sin(angle)
                for m in (a, v):  # columns p and q
                    for r in m:
                        r[p], r[q] = c * r[p] - s * r[q], s * r[p] + c * r[q]
                a[p], a[q] = ([c * x - s * y for x, y in zip(a[p], a[q])], [s * x + c * y for x, y in zip(a[p], a[q])])
    order = sorted(range(d), key=lambda i: -a[i][i])
    axes = []
    for i in order:
        axis = [v[r][i] for r in range(d)]
        big = max(range(d), key=lambda r: abs(axis[r]))
        axes.append([x if axis[big] >= 0 else -x for x in axis])
    return [a[i][i] for i in order], axes


def pca2(df: DataFrame, cols: Sequence[str], names: Sequence[str] = ("PC1", "PC2")) -> DataFrame:
    """The rows with complete (standardised) features, with their scores on
    the first two principal components. Features count to 6 decimals; their
    moments are exact and come from one aggregate, so the scores are the same
    under any partitioning; each component's largest absolute loading is
    positive; the scores are column arithmetic on the rows."""
    data = df.dropna(subset=list(cols))
    points = [on_grid(c) for c in cols]
    m = Moments(data.select(F.array(*points).alias("x")), len(cols))
    axes = principal_axes(m.covariance())[1] if m.n else [[0.0] * len(cols)] * len(names)
    for name, axis in zip(names, axes):
        score: Column | None = None
        for x, s, w in zip(points, m.s, axis):
            part = (x - F.lit(s / max(m.n, 1))) * F.lit(w)
            score = part if score is None else score + part
        data = data.withColumn(name, score / F.lit(float(GRID)))
    return data


def cluster_summary(df: DataFrame, label: str, cols: Sequence[str], decimals: int = 2,
                    scales: Mapping[str, int] | None = None) -> DataFrame:
    """Mean of each column per cluster, rounded half-to-even. ``scales``
    marks fixed-point columns whose sums are done exactly (integer units)."""
    from zonestats.operators.stats import mean_expr
    scales = scales or {}
    return df.groupBy(label).agg(*[
        round_half_even(mean_expr(c, scales.get(c)), decimals).alias(c) for c in cols])


def description_rules(active: str, reactive: str, power: str, pf: str,
                      thresholds: Mapping[str, float] | None = None) -> list[tuple[Column, str]]:
    t = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    a, r, p, f = F.col(active), F.col(reactive), F.col(power), F.col(pf)
    return [
        ((a > t["active_high"]) & (f < t["pf_low"]), RULE_HIGH_USE),
        ((p < t["power_low"]) & (f >= t["pf_high"]), RULE_LOW_POWER),
        (r > t["reactive_high"], RULE_REACTIVE),
        (f < t["pf_very_low"], RULE_VERY_LOW_PF),
    ]


def classify(df: DataFrame, active: str, reactive: str, power: str, pf: str,
             out: str = "description", thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Ordered rule description of each (summary) row, first match wins."""
    rules = description_rules(active, reactive, power, pf, thresholds)
    return df.withColumn(out, classify_expr(rules, RULE_MIXED))


def label_members(members: DataFrame, summary: DataFrame, label: str, desc: str = "description") -> DataFrame:
    """Attach each member row's cluster description: a left join to the
    summary with one row per label (of a repeated label the smallest text)."""
    s = summary.groupBy(label).agg(F.min(desc).alias(desc))
    return members.join(s, label, "left")
