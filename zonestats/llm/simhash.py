"""SimHash near-duplicates, found through the Golay code.

The binary Golay code is perfect: each word of 23 bits lies within distance 3
of exactly one of its 4,096 codewords. A fingerprint is cut into three
segments of 22, 21 and 21 bits. The nearby codewords of a segment are those
that the segment decodes to with at most one bit turned: one codeword if the
segment is within distance 2 of it, else up to six. Two segments that differ
in at most two bits share one of them, because the word half-way between them
is within one bit of both.

Pigeonhole: of two differing bits at least one of the three segments has none.
A key is such a clean segment together with one nearby codeword of the next
segment, so the fingerprints of a pair share a key, and a key has 33 or 34 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestats.llm.byte_bpe import text_runs
from zonestats.llm.common import join_by_weight, saved
from zonestats.llm.components import connected_components

SEED = 42
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
ERRORS = 2
BUCKET = 2048  # fingerprints of a key that are compared in one task
_CHUNK = 1 << 16  # shingles counted at once
_U = np.uint64


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """The error pattern of up to three bits that has each syndrome."""
    bit = [1 << i for i in range(23)]
    patterns = [0, *bit]
    patterns += [a | b for i, a in enumerate(bit) for b in bit[:i]]
    patterns += [a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j]]
    patterns = np.array(patterns, np.int64)
    table = np.full(2048, -1, np.int64)
    table[syndromes(patterns)] = patterns
    return table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the one codeword within distance 3 of each word."""
    return (words ^ _errors()[syndromes(words)]) >> 11


def nearby(words: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of the codewords that a segment of ``bits`` bits decodes to with
    at most one of them turned; a row per word, repeats included."""
    turned = np.concatenate([[0], 1 << np.arange(bits)])
    return codeword_index(words[:, None] ^ turned[None, :])


def search_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of the fingerprints (unsigned 64-bit)."""
    cut = [((prints >> _U(at)) & _U((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    where, keys = [], []
    for s, clean in enumerate(cut):
        t = (s + 1) % len(cut)
        near = np.sort(nearby(cut[t], SEGMENTS[t][1]), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(first)
        where.append(row)
        keys.append((np.int64(s) << 40) | (clean[row] << 12) | near[row, col])
    return np.concatenate(where), np.concatenate(keys)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    total = np.zeros((8, 8), np.int64)  # byte, bit
    cuts = np.arange(0, len(hashes), 255)  # 255 one-bit lanes of a byte do not overflow
    for k in range(8):
        lanes = np.add.reduceat((hashes >> _U(k)) & _U(0x0101010101010101), cuts)
        total[:, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total.reshape(64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is set if more than half of the shingles' hashes have it."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = begin + size
    k = min(words, len(parts))
    begin, end = begin[: len(parts) - k + 1], end[k - 1:]
    of, n, counts = xxhash.xxh64_intdigest, len(begin), np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        spans = zip(begin[i:i + _CHUNK].tolist(), end[i:i + _CHUNK].tolist())
        counts += _bit_counts(np.array([of(joined[a:b], SEED) for a, b in spans], np.uint64))
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def _print_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_runs(batch):
            prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(prints)],
                                             names=["doc_id", "print"])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy()
        for i in range(0, len(prints), _CHUNK // 8):
            part = prints[i:i + _CHUNK // 8]
            where, keys = search_keys(part.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[where])], names=["key", "print"])


def links_within(prints: np.ndarray, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Links that connect all of the distinct ``prints`` (signed) that differ
    in at most ``errors`` bits, directly or by others among them."""
    prints = np.sort(prints)
    raw, comp, out = prints.view(_U), np.arange(len(prints)), []
    for i in range(len(prints) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(raw[i + 1:] ^ raw[i]) <= errors)
        for j in near[comp[near] != comp[i]].tolist():
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((int(prints[i]), int(prints[j])))
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, print) sorted by key, at most ``BUCKET`` of a key."""
    held_key = held = np.zeros(0, np.int64)

    def links(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(key)) + 1
        found = [p for group in np.split(prints, cuts) for p in links_within(group, errors)]
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy()])
        prints = np.concatenate([held, batch.column("print").to_numpy()])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
        if last:
            yield links(key[:last], prints[:last])
        held_key, held = key[last:], prints[last:]
    if len(held):
        yield links(held_key, held)


def _turned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint under itself and under itself with one bit turned."""
    turned = np.concatenate([[0], _U(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        prints = batch.column("print").to_numpy()
        for i in range(0, len(prints), 1024):
            part = prints[i:i + 1024]
            keys = (part.view(_U)[:, None] ^ turned).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part, 65))], names=["key", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per input row: doc_id, print (the 64-bit fingerprint, signed).
    A null, empty or white text has fingerprint zero. One scan, no shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(partial(_print_rows, words=words), "doc_id long, print long")


def print_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``prints`` (distinct, a
    written table) that differ in at most two bits.

    Keys that two fingerprints share are compared in SQL. Keys of more, up to
    ``bucket``, are compared in tasks, which emit links that connect, never all
    pairs. The members of still larger keys are put under themselves and their
    64 neighbours at one bit instead: two that differ in at most two bits meet
    there, such a group has at most 65 members, and any two of it are linked,
    so a star of links connects it. No group of any stage grows with the input.
    """
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= ERRORS
    keyed = prints.select("print").mapInArrow(_key_rows, "key long, print long")
    keyed = saved(keyed, "simhash-keys")
    sizes = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
                  .filter("n > 1"), "simhash-buckets")
    twos = sizes.filter("n = 2").filter(near).select("a", "b")
    more = saved(keyed.join(sizes.filter("n > 2").select("key", "n").hint("merge"), "key"), "simhash-members")
    few = more.filter(F.col("n") <= bucket).select("key", "print").repartition("key").sortWithinPartitions("key")
    some = few.mapInArrow(partial(_bucket_links, errors=ERRORS), "a long, b long")
    many = more.filter(F.col("n") > bucket).select("print").distinct().mapInArrow(_turned_rows, "key long, print long")
    star = many.groupBy("key").agg(F.collect_set("print").alias("all")).filter(F.size("all") > 1) \
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")  # at most 65 in "all"
    return saved(twos.unionByName(some).unionByName(star).distinct(), "simhash-links")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       bucket: int = BUCKET) -> DataFrame:
    """Components of documents whose fingerprints differ in at most two bits.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z lowered; shingles of
    ``words`` words, repeats included, joined by one space; with fewer words
    the whole sequence; without words the fingerprint is zero, linked like any
    other. Returns one row per input row: doc_id, fingerprint (16 hex digits),
    component_id (the smallest id reachable, itself included).

    A fingerprint is one node however many documents have it. Null ids take
    part; a component without any id has a null component_id. Repeated rows
    share a component; an empty table gives no rows; other columns are ignored.
    """
    rows = saved(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    nodes = saved(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = connected_components(print_links(nodes, bucket))
    placed = nodes.join(roots.withColumnRenamed("node", "print").hint("merge"), "print", "left") \
        .select("print", "low", F.coalesce("root", "print").alias("root"))
    placed = saved(placed, "simhash-placed")
    ids = saved(placed.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-ids")
    of = saved(join_by_weight(placed, ids, "root").select("print", "component_id"), "simhash-components")
    return join_by_weight(rows, of, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
