"""MinHash near-duplicates with min-max hashing.

Every permutation is evaluated once and gives two signature values, the
minimum and the maximum of the permuted set; both match with a probability
equal to the Jaccard similarity, so half the hash evaluations give the same
number of unbiased rows. Bands of ``rows`` values are bucket keys. Documents
of one bucket are compared on their full sets, in blocks, inside tasks; tasks
emit the links that connect a bucket, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestats.llm import textkernel as tk
from zonestats.llm.common import saved
from zonestats.llm.components import connected_components

BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6
BLOCK = 512  # documents compared with one another at once
FILTER_BITS = 1 << 26  # 8 MB: the bitmap of candidate ids
_CHUNK = 4096  # shingles hashed, or matrix columns filled, at once


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = tk.stream(2 * n, 11)
    return (s[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[n:] >> np.uint64(32)).astype(np.uint32)


def min_max(values: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a non-empty set under each permutation of 32-bit words."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = high = None
    for i in range(0, len(x), _CHUNK):
        h = mul[:, None] * x[None, i:i + _CHUNK]
        h += add[:, None]
        lo, hi = h.min(axis=1), h.max(axis=1)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return np.concatenate([low, high])


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    if not len(values):
        return 0, 0
    with np.errstate(over="ignore"):
        a = tk.mix(values + np.uint64(0x9E3779B97F4A7C15)).sum()
        b = tk.mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum()
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int, carry: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    mul, add = _permutations((bands * rows + 1) // 2)
    weight = (tk.stream(rows, 13) | np.uint64(1))[:, None]
    salt = tk.stream(bands, 17)
    for batch in batches:
        for i, j, data, offs in tk.slices(batch, "text"):
            n, one, two, keys, sizes = [], [], [], [], []
            for s in tk.shingles(tk.Words(data, offs), k):
                n.append(len(s))
                a, b = set_key(s)
                one.append(a)
                two.append(b)
                if len(s):
                    sig = min_max(s, mul, add)[: bands * rows].reshape(rows, bands).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        keys.append(tk.mix((sig * weight).sum(axis=0, dtype=np.uint64) + salt).view(np.int64))
                sizes.append(bands if len(s) else 0)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 *(batch.column(c).slice(i, j - i) for c in carry)],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", *carry])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in tk.slices(batch, "text"):
            one, two, sets = [], [], []
            for s in tk.shingles(tk.Words(data, offs), k):
                if len(s):
                    a, b = set_key(s)
                    one.append(a)
                    two.append(b)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                              pa.array(sets, pa.binary())], names=["k1", "k2", "shingles"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted distinct arrays."""
    if len(left) == 1 and len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    both = left + right if left is not right else left
    ids, inverse, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1
    width = int(rank[-1]) + 1 if len(rank) else 0
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    shared = counts[inverse] > 1
    row, col = row[shared], rank[inverse[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, width, _CHUNK):
        a, b = np.searchsorted(col, [c, c + _CHUNK])
        m = np.zeros((len(both), min(_CHUNK, width - c)), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        total += m[: len(left)] @ (m if left is right else m[len(left):]).T
    return np.rint(total).astype(np.int64)


def _forest(nodes: list[int], comps: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """The links of ``pairs`` (indices) that connect parts not connected yet."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(comps[i]), find(comps[j])
        if a != b:
            parent[a] = b
            out.append((nodes[i], nodes[j]))
    return out


def _compare(group: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between the ``probe`` rows and all rows of one block pair."""
    seen: dict[int, tuple] = {}
    for row in group:
        seen[row[0]] = row if row[0] not in seen or row[3] else seen[row[0]]
    rows = sorted(seen.values(), key=lambda r: r[0])
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    nodes, comps = [r[0] for r in rows], [r[1] for r in rows]
    probes = [i for i, r in enumerate(rows) if r[3]]
    if not probes or len(rows) < 2:
        return []
    left = sets if len(probes) == len(rows) else [sets[i] for i in probes]
    common = overlaps(left, sets)
    size = np.array([len(s) for s in sets])
    union = size[probes][:, None] + size[None, :] - common
    at = np.argwhere(100 * common >= percent * union)
    at[:, 0] = np.array(probes)[at[:, 0]]
    return _forest(nodes, comps, at[at[:, 0] != at[:, 1]])


def _link_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block pair: (key, p, q, node, comp, shingles, probe)."""
    current, group, out = None, [], []

    def flush() -> pa.RecordBatch:
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("key", "p", "q", "node", "comp", "shingles", "probe")]
        for key, p, q, node, comp, s, probe in zip(*cols):
            if (key, p, q) != current:
                out += _compare(group, percent) if len(group) > 1 else []
                current, group = (key, p, q), []
            group.append((node, comp, s, probe))
        if len(out) > 10_000:
            yield flush()
            out = []
    out += _compare(group, percent) if len(group) > 1 else []
    yield flush()


def _maybe_in(docs: DataFrame, chosen: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The documents whose hashed id is set in a bitmap of the chosen ids, so
    that the join that follows shuffles few other texts. The bitmap is built
    by a grouped aggregate and has at most ``bits`` bits, whatever the input."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))

    part = 8 * 4096  # bits of one row of the bitmap
    maps = chosen.select(place("want").alias("at")).groupBy((F.col("at") / part).cast("long").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("at") % part).alias("map"))
    at = F.col("at") % part
    byte = F.conv(F.hex(F.substring("map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("at", place("doc_id")).withColumn("bucket", (F.col("at") / part).cast("long")) \
        .join(F.broadcast(maps), "bucket")
    return found.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members``: key, p, q, node, comp, probe."""
    rows = members.join(sets, "node")
    parts = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    return parts.select("key", "p", "q", "node", "comp", "shingles", "probe") \
        .mapInArrow(partial(_link_blocks, percent=percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Near-duplicate components of documents.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z lowered; a document's
    set is its distinct shingles of ``words`` words, or its whole sequence if
    shorter. Documents are linked when 100 * intersection >= ``percent`` *
    union on the full sets. Returns one row per input row: doc_id, n_shingles,
    component_id (smallest id reachable), kept (doc_id = component_id). With
    ``carry`` also those columns of the input and ``component``, a number that
    names the row's component even where ids are null or repeat.

    1. One scan writes set size, a 128-bit set key and the band keys.
    2. Equal sets become one node, so copies cost one row.
    3. Buckets of two or more nodes are kept. Each node is first compared with
       the bucket leader it meets in most bands; confirmed links contract.
    4. In buckets that still hold several components, every document outside
       the bucket's first component is compared with every other document, in
       block pairs of ``block`` documents: each link across components is
       found, however large the bucket, and a bucket's pairs are never rows.
    5. Components are iterated joins; nothing is collected to the driver.

    Null, empty or white texts have an empty set and are linked with nothing.
    A null id never becomes a component's id if another id is there; its row
    is kept only if its component has no id. Repeated rows share a component,
    and each row that carries the component's id is kept. An empty table gives
    an empty result; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tagged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    own = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in tagged.schema[2:])
    marks = tagged.mapInArrow(partial(_signatures, k=words, bands=bands, rows=rows, carry=carry),
                              "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>" + own)
    marks = saved(marks.withColumn("rid", F.monotonically_increasing_id()), "minmax-marks")
    classes = saved(marks.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("rid").alias("node")), "minmax-classes")

    keyed = (marks.select("rid", "bands").join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
             .select(F.col("rid").alias("node"), F.explode("bands").alias("key")))
    shared = saved(keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
                   .filter("lead < last").drop("last"), "minmax-buckets")
    members = saved(keyed.join(shared, "key"), "minmax-members")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))

    # full sets of the nodes that share a bucket, from their texts
    nodes = saved(members.select("node").distinct().join(marks.select(F.col("rid").alias("node"), "doc_id", "k1", "k2"),
                                                         "node"), "minmax-nodes")
    chosen = nodes.select(F.col("doc_id").alias("want")).distinct()
    # written, because the semi join would otherwise be pushed below the bitmap and shuffle every text
    texts = saved(_maybe_in(src, chosen), "minmax-texts").join(chosen, F.col("doc_id").eqNullSafe(F.col("want")), "left_semi").select("text")
    sets = texts.mapInArrow(partial(_sets, k=words), "k1 long, k2 long, shingles binary")
    sets = saved(sets.join(nodes.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "shingles"), "minmax-sets")

    # first pass: each node against the leader that it meets most often
    met = members.filter("node <> lead").groupBy("node", "lead").count()
    best = met.groupBy("node").agg(F.max_by("lead", F.struct(F.col("count"), -F.col("lead"))).alias("lead"))
    pair = best.select(F.col("lead").alias("key"), F.pmod(F.xxhash64("node"), F.lit(1 << 20)).alias("spread"), "node")
    # a leader's followers are dealt into chunks, and the leader joins each chunk
    per = saved(pair.groupBy("key").agg(F.ceil(F.count("*") / block).alias("chunks")), "minmax-leads")
    dealt = pair.join(per, "key").select("key", (F.col("spread") % F.col("chunks")).alias("p"), "node")
    leads = per.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("p"),
                       F.col("key").alias("node"))
    first = dealt.unionByName(leads).select("key", "p", F.lit(0).cast("long").alias("q"), "node",
                                            F.col("node").alias("comp"), F.lit(True).alias("probe"))
    near = saved(_links(first, sets, percent), "minmax-links")
    roots = connected_components(near)

    # second pass: buckets that still hold more than one component
    placed = saved(members.select("key", "node").join(roots, "node", "left")
                   .select("key", "node", F.coalesce("root", "node").alias("comp")), "minmax-placed")
    open_ = saved(placed.groupBy("key").agg(F.min("comp").alias("main"), F.max("comp").alias("other"))
                  .filter("main < other").select("key", "main").join(sizes, "key"), "minmax-open")
    rest = placed.join(open_, "key").withColumn("minor", F.col("comp") > F.col("main")) \
        .withColumn("blocks", F.ceil(F.col("size") / block)) \
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    minors = saved(rest.filter("minor").groupBy("key", "own").count().select("key", F.col("own").alias("p")), "minmax-minors")
    # block pair (p, q): the minors of block p against all documents of block q
    probe = rest.filter("minor").select("key", F.col("own").alias("p"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("q"), "node", "comp", F.lit(True).alias("probe"))
    other = rest.select("key", F.col("own").alias("q"), "node", "comp").join(minors, "key") \
        .select("key", "p", "q", "node", "comp", F.lit(False).alias("probe"))
    late = saved(_links(probe.unionByName(other), sets, percent), "minmax-links")
    roots = connected_components(near.unionByName(late))

    # members of every component, and its smallest id
    rows_ = (marks.select("doc_id", "n_shingles", "k1", "k2", "rid", *carry)
             .join(classes, ["k1", "k2"], "left").join(roots, "node", "left")
             .select("doc_id", "n_shingles", *carry, F.coalesce("root", "node", "rid").alias("root")))
    rows_ = saved(rows_, "minmax-rows")
    low = saved(rows_.groupBy("root").agg(F.min("doc_id").alias("component_id")), "minmax-ids")
    return rows_.join(low, "root").select("doc_id", "n_shingles", "component_id",
                                          F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                                          *carry, *([F.col("root").alias("component")] if carry else []))
