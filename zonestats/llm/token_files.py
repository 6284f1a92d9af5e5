"""Token ids in Arrow files of equal-length sequences.

A shard file is an Arrow stream with the file format's footer: every record
batch has a FixedSizeList of ids and one of mask bits, so any sequence of any
batch is a view of the mapped file. Documents are packed end to end in id
order; the mask is false only on the padding of a shard's last sequence.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonestats.llm.byte_bpe import cut_pieces, local_uri, text_runs
from zonestats.llm.common import saved, shuffle_partitions
from zonestats.llm.segments import PieceTable, SegmentTable, can_cut, encode_segments

LENGTH = 2048  # ids of a sequence
BATCH = 64  # sequences of a record batch


class SegmentEncoder:
    """Ids of texts as the tokenizers library gives them for a tokenizer file,
    without added special tokens. Where the file splits texts by the byte-level
    pattern, each distinct segment is encoded once; other files, texts that
    hold an added token's string and texts that cannot be cut go whole."""

    def __init__(self, path: str, pattern: str, end_id: int, kind: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(path)
        self.end, self.whole = np.array([end_id], kind), pattern != PATTERN or self.own.normalizer is not None
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        vocab = self.own.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(t) for t in vocab]  # one character a byte
        pieces = PieceTable(self.own.model, self.sizes, cut_pieces, lambda t: self.own.encode(t, add_special_tokens=False).ids)
        self.kind, self.table = kind, SegmentTable(lambda raw, lengths: [encode_segments(pieces.encode, self.sizes, raw, lengths)])

    def _cuts(self, text: str) -> bool:
        return not self.whole and not any(t in text for t in self.added) and can_cut(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each text's followed by the end id, and how many
        each text has with it."""
        cuts = [self._cuts(t) for t in texts]
        ids, counts = self.table.encode([t.encode() if c else b"" for t, c in zip(texts, cuts)])[0]
        ids, at, out = ids.astype(self.kind), 0, []
        for text, cut, n in zip(texts, cuts, counts.tolist()):
            out += [ids[at:at + n] if cut else np.array(self.own.encode(text, add_special_tokens=False).ids, self.kind), self.end]
            at += n
        return np.concatenate(out), np.array([len(own) + 1 for own in out[::2]])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, end_id: int, kind: str) -> SegmentEncoder:
    return SegmentEncoder(path, pattern, end_id, kind)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(local_uri(uri))


class ShardWriter:
    """Writes one shard under a name of its own and moves it into place, so a
    repeated task attempt replaces equal content by equal content."""

    def __init__(self, folder: str, shard: int, length: int, batch: int, kind: pa.DataType):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = f"{base}/shard-{shard:06d}.arrow"
        self.temp = f"{base}/.{uuid.uuid4().hex}.tmp"
        self.length, self.rows, self.kind = length, length * batch, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.rows:
            flat = np.concatenate(self.held)
            full = len(flat) - len(flat) % self.rows
            for i in range(0, full, self.rows):
                self._put(flat[i:i + self.rows], self.rows)
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _put(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind.to_pandas_dtype())
        if len(flat):
            pad = -len(flat) % self.length
            self._put(np.concatenate([flat, np.zeros(pad, flat.dtype)]), len(flat))
        self.out.close()
        self.sink.close()
        self.fs.move(self.temp, self.final)


class ShardReader:
    """Random access to a shard: ids by position, sequences and masks by number."""

    def __init__(self, folder: str, shard: int):
        fs, base = _open(folder)
        name = f"{base}/shard-{shard:06d}.arrow"
        source = pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of a sequence, both views of the file."""
        batch = self.file.get_batch(i // self.per_batch)
        at = (i % self.per_batch) * self.length
        return tuple(batch.column(c).values.slice(at, self.length) for c in (0, 1))

    def ids(self, start: int, n: int):
        """Views that make up ids ``start``..``start + n``."""
        width = self.per_batch * self.length
        while n > 0:
            at = start % width
            view = self.file.get_batch(start // width).column(0).values.to_numpy()[at:at + n]
            yield view
            start, n = start + len(view), n - len(view)


def _write_rows(batches, path, pattern, folder, end_id, length, batch_rows, kind):
    enc, writer, shard = _encoder(path, pattern, end_id, kind), None, TaskContext.get().partitionId()
    for batch in batches:
        for first, texts in text_runs(batch):
            writer = writer or ShardWriter(folder, shard, length, batch_rows, pa.from_numpy_dtype(kind))
            ids, sizes = enc.encode(texts)
            starts = writer.n + np.cumsum(sizes) - sizes
            writer.add(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([shard] * len(texts), pa.int32()),
                                              pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                                             names=["doc_id", "shard", "at", "n_tokens"])
    if writer:
        writer.close()


def write_tokens(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = 0, shards: int | None = None,
                 length: int = LENGTH, batch: int = BATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts as the tokenizers library does with the file
    ``path`` (``pattern``: how it splits texts; strings of its added tokens
    count as those tokens), end each with ``end_id`` and write shards into
    ``folder`` (shared by all executors). Returns the index, one row per input
    row: doc_id, shard, at (position in the shard), n_tokens, start (ids of
    all documents before it).

    Shards are ranges of (id, hash of the text), each one task's rows in that
    order, so many rows of one id, or without any, are split as well. Null ids
    come last; rows that repeat an id follow one another by the text's hash,
    then the text; a null or empty text has only its end id; an empty table
    writes nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    n = shards or shuffle_partitions(spark)
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    placed = src.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    with open(path, encoding="utf-8") as f:
        kind = "<u2" if _vocabulary(f) <= 1 << 16 else "<u4"
    index = placed.mapInArrow(partial(_write_rows, path=path, pattern=pattern, folder=folder, end_id=end_id, length=length,
                                      batch_rows=batch, kind=kind), "doc_id long, shard int, at long, n_tokens long")
    index = saved(index, "token-index")
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("size"))  # one row per shard
    before = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"))
    return index.join(F.broadcast(before), "shard").select("doc_id", "shard", "at", "n_tokens",
                                                            (F.col("before") + F.col("at")).alias("start"))


def _vocabulary(f) -> int:
    import json

    spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1


def _read_rows(batches, folder: str):
    reader, shard = None, None
    for batch in batches:
        crcs = []
        for s, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "n_tokens"))):
            if s != shard:
                reader, shard = ShardReader(folder, s), s
            crc = 0
            for view in reader.ids(at, n):
                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")),
                                          pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_checksums(index: DataFrame, folder: str) -> DataFrame:
    """Read every document back from the shards: doc_id, start, n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    return index.select("doc_id", "shard", "at", "n_tokens", "start").mapInArrow(
        partial(_read_rows, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
