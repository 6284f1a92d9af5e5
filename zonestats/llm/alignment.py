"""Alignment of two tokenizers over a corpus, with inverted pair bitmaps.

Both tokenizers cut a text into tokens of known bytes. Tokens whose bytes
overlap are linked. For every pair of ids the documents that link it are kept
as compressed bitmaps, one per binary digit of the number of links (the
multiplicity planes): the union of the planes counts documents, their weighted
popcounts count links. The bitmaps then serve as postings that carry each
pair's score back to its documents.

Texts are cut into segments (white space and the word after it), each tokenised
once by both (``segments``).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestats.llm.byte_bpe import _TO_BYTE, cut_pieces, text_runs
from zonestats.llm.common import join_by_weight, saved
from zonestats.llm.segments import HELD_BYTES, PieceTable, SegmentTable, can_cut, encode_segments, spread

BLOCK = 1 << 16  # documents of a bitmap
DENSE = 4096  # a bitmap of this many documents or more is stored as bits, a smaller one as a sorted list
FLUSH = 2_000_000  # postings that a task holds before it writes them
MERGE_DOCS = 1 << 20  # set bits of the bitmaps that are merged at once


class Aligned:
    """Alignment of a run of texts, as arrays: per text the tokens of each
    tokenizer, groups and links (``n_a``, ``n_b``, ``n_groups``, ``n_links``)
    and the groups written out (``shown``); per distinct pair of ids in a text
    ``doc``, ``pair`` (first id * 2^32 + second) and ``times``."""

    def __init__(self, pair: Pair, x: np.ndarray, n_a: np.ndarray, y: np.ndarray, n_b: np.ndarray):
        docs = len(n_a)
        self.n_a, self.n_b = n_a, n_b
        doc_a, doc_b = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
        end_a, end_b = np.cumsum(pair.a_sizes[x]), np.cumsum(pair.b_sizes[y])
        # the token of the other side at each token's last byte
        b_at, a_at = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        both_a, both_b = end_b[b_at] == end_a, end_a[a_at] == end_b
        self.n_groups = np.bincount(doc_a[both_a], minlength=docs)
        # each place where a token of either side ends is one link
        link_doc = np.concatenate([doc_a, doc_b[~both_b]])
        link_a, link_b = np.concatenate([x, x[a_at[~both_b]]]), np.concatenate([y[b_at], y[~both_b]])
        self.n_links = np.bincount(link_doc, minlength=docs)
        width = np.int64(len(pair.b_sizes))
        span = width * len(pair.a_sizes)
        keys, self.times = np.unique(link_doc * span + link_a * width + link_b, return_counts=True)
        self.doc = keys // span
        self.pair = (keys % span // width << 32) | keys % width
        # tokens in the order in which they are written: of each group the first side's, then the second's
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        last_a, last_b = np.flatnonzero(both_a) + 1, np.flatnonzero(both_b) + 1
        words = np.empty(len(x) + len(y), object)
        words[np.arange(len(x)) + np.append(0, last_b)[group_a]] = np.where(both_a, pair.a_last[x], pair.a_more[x])
        words[np.arange(len(y)) + last_a[group_b]] = np.where(both_b, pair.b_last[y], pair.b_more[y])
        words, cuts = words.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.shown = [b"".join(words[a:b])[:-1] for a, b in zip(cuts, cuts[1:])]


class Pair:
    """The two tokenizers and, per id, the bytes of a token."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        vocab = self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            a_bytes[i] = bytes(_TO_BYTE[c] for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (a_bytes, b_bytes))
        self.bytes = [np.frombuffer(b"".join(t), np.uint8) for t in (a_bytes, b_bytes)]
        self.a_more, self.a_last, self.b_more, self.b_last = (
            np.array([b"%d%s" % (i, sign) for i in range(len(t))], object)
            for t, sign in ((a_bytes, b","), (a_bytes, b"|"), (b_bytes, b","), (b_bytes, b";")))
        self.space = self.b.piece_to_id("\u2581")
        self.pieces = PieceTable(self.a.model, self.a_sizes, cut_pieces, lambda t: self.a.encode(t, add_special_tokens=False).ids)
        self.table = SegmentTable(self._learn, pools=3, limit=2 * HELD_BYTES)

    def _spelt(self, side: int, ids: np.ndarray) -> np.ndarray:
        sizes = (self.a_sizes, self.b_sizes)[side]
        return self.bytes[side][spread((np.cumsum(sizes) - sizes)[ids], sizes[ids])]

    def _learn(self, raw: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of segments by both tokenizers, and a mark for each segment whose
        tokens do not have its bytes. The second tokenizer adds a space, which
        stands for a segment's first space or is taken off again."""
        ends = np.cumsum(lengths)
        text = raw.tobytes()
        parts = [text[a:b].decode() for a, b in zip((ends - lengths).tolist(), ends.tolist())]
        second = []
        for part, ids in zip(parts, self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)):
            if part == " ":
                ids = [self.space]
            elif part[0] != " ":
                ids = ids[1:] if ids[:1] == [self.space] else []
            second.append(ids)
        counts = np.array(list(map(len, second)), np.int64)
        ids = np.array(list(chain.from_iterable(second)), np.int64)
        owner = np.repeat(np.arange(len(parts)), counts)
        bad = np.bincount(owner, self.b_sizes[ids], len(parts)).astype(np.int64) != lengths
        keep = ~bad[owner]
        ids, counts = ids[keep], np.where(bad, 0, counts)
        wrong = self._spelt(1, ids) != raw[np.repeat(~bad, lengths)]
        bad[np.repeat(np.arange(len(parts)), np.where(bad, 0, lengths))[wrong]] = True
        keep = ~bad[np.repeat(np.arange(len(parts)), counts)]
        return [encode_segments(self.pieces.encode, self.a_sizes, raw, lengths), (ids[keep], np.where(bad, 0, counts)),
                (np.ones(int(bad.sum()), np.int64), bad.astype(np.int64))]

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        y = np.array(self.b.encode(text), np.int64)
        raw = (" " + text).encode()
        return (x, y) if self._spelt(0, x).tobytes() == raw == self._spelt(1, y).tobytes() else (x[:0], y[:0])

    def align(self, texts: list[str]) -> Aligned:
        """Align each whole text, with a space before it. Empty texts, and texts
        that do not come back from their tokens, have none."""
        cut = [bool(t) and can_cut(t) for t in texts]
        (a, n_a), (b, n_b), (_, bad) = self.table.encode([(" " + t).encode() if c else b"" for t, c in zip(texts, cut)])
        whole = [i for i, t in enumerate(texts) if t and (not cut[i] or bad[i])]
        x, y = np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1])
        for i in whole:
            x[i], y[i] = self._whole(texts[i])
        counts = [np.array(list(map(len, side)), np.int64) for side in (x, y)]
        return Aligned(self, np.concatenate(x).astype(np.int64), counts[0], np.concatenate(y).astype(np.int64), counts[1])


@lru_cache(maxsize=1)
def _pair(first: str, second: str) -> Pair:
    return Pair(first, second)


def pack(docs: np.ndarray) -> bytes:
    """A sorted list of document numbers below ``BLOCK`` as a compressed bitmap."""
    if len(docs) < DENSE:
        return docs.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[docs] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < 2 * DENSE:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")).astype(np.uint16)


def unpack_all(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, document) of every set bit of a column."""
    sizes = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False).astype(np.int64)
    dense = np.flatnonzero(sizes >= 2 * DENSE)
    if not len(dense):
        offs = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset:bitmaps.offset + len(bitmaps) + 1]
        docs = np.frombuffer(bitmaps.buffers()[2], np.uint8)[offs[0]:offs[-1]].view("<u2") if len(sizes) and offs[-1] > offs[0] \
            else np.zeros(0, "<u2")
        return np.repeat(np.arange(len(sizes)), sizes // 2), docs
    lists = [unpack(b) for b in bitmaps.to_pylist()]
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)


def pack_all(group: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(first position of each group, its bitmap); rows sorted by group, document."""
    if not len(group):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, len(group)))
    low = np.ascontiguousarray(docs.astype("<u2"))
    if sizes.max() < DENSE:
        offs = np.append(first, len(group)).astype(np.int32) * 2
        return first, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offs), pa.py_buffer(low)])
    return first, pa.array([pack(low[a:a + n]) for a, n in zip(first.tolist(), sizes.tolist())], pa.binary())


_POSTING = pa.schema([("pair", pa.int64()), ("block", pa.int64()), ("plane", pa.int32()), ("docs", pa.binary())])
_DOCUMENT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                       ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_ROW = pa.schema([*_DOCUMENT, *_POSTING])
_ROW_DDL = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pair long, block long, plane int, docs binary")


def _with_nulls(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class Postings:
    """Links of one block's documents, written as bitmaps of each pair and plane."""

    def __init__(self):
        self.block, self.held, self.n = -1, [], 0

    def add(self, low: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        """Rows of documents that come after all before."""
        self.held.append((low.astype(np.uint16), pairs, times.astype(np.int32)))
        self.n += len(pairs)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            doc, pair, times = (np.concatenate(c) for c in zip(*self.held))
            order = np.argsort(pair, kind="stable")  # documents stay in order
            doc, pair, times = doc[order], pair[order], times[order]
            for plane in range(int(times.max()).bit_length()):
                has = (times >> plane & 1).astype(bool)
                if has.any():
                    first, bitmaps = pack_all(pair[has], doc[has])
                    k = len(first)
                    yield _with_nulls(_ROW, {"pair": pa.array(pair[has][first]), "block": pa.array(np.full(k, self.block, np.int64)),
                                             "plane": pa.array(np.full(k, plane, np.int32)), "docs": bitmaps})
        self.held, self.n = [], 0


def _align_rows(batches: Iterator[pa.RecordBatch], first: str, second: str, flush: int) -> Iterator[pa.RecordBatch]:
    pair, postings = _pair(first, second), Postings()
    for batch in batches:
        for at, texts in text_runs(batch):
            part = batch.slice(at, len(texts))
            got = pair.align(texts)
            rid = part.column("rid").to_numpy()[got.doc]
            for block in np.unique(rid // BLOCK).tolist():
                if block != postings.block or postings.n > flush:
                    yield from postings.flush()
                    postings.block = block
                own = rid // BLOCK == block
                postings.add(rid[own] % BLOCK, got.pair[own], got.times[own])
            yield _with_nulls(_ROW, {
                "rid": part.column("rid"), "doc_id": part.column("doc_id"), "n_a": pa.array(got.n_a), "n_b": pa.array(got.n_b),
                "n_groups": pa.array(got.n_groups), "n_links": pa.array(got.n_links),
                "groups_sha256": pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in got.shown])})
    yield from postings.flush()


def _chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys``, dealt anew so that no group is cut: about
    ``MERGE_DOCS`` documents at a time, or one group that has more."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        cols = [rows.column(k).to_numpy() for k in keys]
        new = np.zeros(rows.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        length = pc.binary_length(rows.column("docs")).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.cumsum(np.where(length >= 2 * DENSE, BLOCK, length // 2))
        begin = 0
        for cut, after in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.num_rows]):
            if after == rows.num_rows or size[after - 1] - (size[begin - 1] if begin else 0) > MERGE_DOCS:
                yield rows.slice(begin, cut - begin)
                begin = cut
        held = rows.slice(begin)
    if held is not None:
        yield held


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of one pair, block and plane become one (OR); ``n`` is its
    popcount, ``n_docs`` (on a pair and block's first row) that of the OR of
    all planes."""
    for rows in _chunks(batches, ("pair", "block")):
        pair, block, plane = (rows.column(c).to_numpy() for c in ("pair", "block", "plane"))
        at, docs = unpack_all(rows.column("docs"))
        change = np.concatenate([[True], (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])])
        group = np.cumsum(change) - 1
        # one number per (group, plane, document); np.unique is the OR
        bits = np.unique((group[at].astype(np.uint64) << np.uint64(22)) | (plane[at].astype(np.uint64) << np.uint64(16)) | docs.astype(np.uint64))
        first, bitmaps = pack_all(bits >> np.uint64(16), bits & np.uint64(0xFFFF))
        of = (bits[first] >> np.uint64(22)).astype(np.int64)
        any_plane = np.unique(((bits >> np.uint64(22)) << np.uint64(16)) | (bits & np.uint64(0xFFFF)))
        n_docs = np.bincount((any_plane >> np.uint64(16)).astype(np.int64), minlength=int(group[-1]) + 1)
        lead = np.concatenate([[True], of[1:] != of[:-1]])
        where = np.flatnonzero(change)[of]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair[where]), pa.array(block[where]), pa.array((bits[first] >> np.uint64(16) & np.uint64(63)).astype(np.int32)), bitmaps,
             pa.array(np.diff(np.append(first, len(bits))).astype(np.int64)), pa.array(np.where(lead, n_docs[of], 0).astype(np.int64))],
            names=["pair", "block", "plane", "docs", "n", "n_docs"])


def _score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by block, with their pair's score: what each document gets."""
    current, count, best = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

    def put() -> pa.RecordBatch:
        at = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(at + current * BLOCK), pa.array(best[at]), pa.array(count[at])],
                                          names=["rid", "n_best", "count_sum"])

    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            if block[a] != current:
                if current is not None:
                    yield put()
                current, count, best = int(block[a]), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            for i in range(a, b, 1024):
                part = batch.slice(i, min(1024, b - i))
                at, docs = unpack_all(part.column("docs"))
                times = np.int64(1) << part.column("plane").to_numpy().astype(np.int64)
                np.add.at(count, docs, (times * part.column("n_links").to_numpy())[at])
                np.add.at(best, docs, (times * part.column("is_best").to_numpy(zero_copy_only=False))[at])
    if current is not None:
        yield put()


class Alignment:
    """Written results: ``documents`` (rid, doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256), ``postings`` (pair, block, plane, docs, n, n_docs) and
    ``pairs`` (pair, a_id, b_id, n_docs, n_links, is_best)."""

    def __init__(self, documents: DataFrame, postings: DataFrame, pairs: DataFrame):
        self.documents, self.postings, self.pairs = documents, postings, pairs

    def scores(self) -> DataFrame:
        """Per document: doc_id, the counts, n_best (links whose pair has the
        largest count of its second id), count_sum (over links)."""
        scored = join_by_weight(self.postings.select("pair", "block", "plane", "docs"), self.pairs.select("pair", "n_links", "is_best"), "pair")
        dealt = scored.repartition("block").sortWithinPartitions("block")
        got = saved(dealt.select("block", "plane", "docs", "n_links", "is_best")
                    .mapInArrow(_score_rows, "rid long, n_best long, count_sum long"), "align-scores")
        none = F.lit(0).cast("long")
        return self.documents.join(got.hint("merge"), "rid", "left").select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
            F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def align_tokenizers(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text",
                     flush: int = FLUSH) -> Alignment:
    """Align a byte-level BPE file (``first``, on a space and the text) with a
    sentencepiece model (``second``, which adds that space itself), without
    special tokens, on every whole text.

    Groups are cut where tokens of both end at the same byte. Every pair of
    tokens with a common byte is a link. Texts that are null or empty, or whose
    tokens do not have the bytes of the space and the text (the second model
    changes some), have no tokens: their counts are 0 and their digest is ''.

    Documents are numbered by partition in blocks of 65,536; a bitmap never
    spans a block, so a pair that every document has is many small rows. A
    task writes its postings whenever it holds ``flush`` of them; the parts of
    a bitmap are merged by (pair, block). Null and repeated ids are rows like
    any other; an empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.monotonically_increasing_id().alias("rid"))
    both = saved(src.mapInArrow(partial(_align_rows, first=first, second=second, flush=flush), _ROW_DDL), "align-rows")
    documents = both.filter("pair IS NULL").select(*_DOCUMENT.names)
    parts = both.filter("pair IS NOT NULL").select(*_POSTING.names)
    merged = parts.repartition("pair", "block").sortWithinPartitions("pair", "block", "plane").mapInArrow(
        _merge_rows, "pair long, block long, plane int, docs binary, n long, n_docs long")
    postings = saved(merged, "align-postings")
    weight = F.col("n") * F.expr("shiftleft(1L, plane)")
    counts = saved(postings.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum(weight).alias("n_links"))
                   .withColumns({"a_id": F.shiftright("pair", 32), "b_id": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))}), "align-counts")
    top = counts.groupBy("b_id").agg(F.max("n_links").alias("top"))
    pairs = saved(counts.join(top, "b_id").select("pair", "a_id", "b_id", "n_docs", "n_links",
                                                  (F.col("n_links") == F.col("top")).alias("is_best")), "align-pairs")
    return Alignment(documents, postings, pairs)
