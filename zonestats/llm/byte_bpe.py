"""Byte-level BPE over Arrow batches with the tokenizers library."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 300_000  # pieces of one generation of a worker's memo; two are kept
#: The byte-level pattern for Python's ``re``, for texts of ``plain`` characters.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_PIECES = regex.compile(PATTERN).findall
_ODD = frozenset("\x1c\x1d\x1e\x1f")  # white in Python, not in the pattern
_BATCH_BYTES = 1 << 20


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable bytes themselves,
    the others in order from code point 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_CHARS = byte_chars()
_TO_CHARS = {b: c for b, c in enumerate(_CHARS)}
_TO_BYTE = {c: b for b, c in enumerate(_CHARS)}


def plain(text: str) -> bool:
    """Whether ``_PLAIN`` splits a text as the pattern does: beyond ASCII it
    has only letters assigned in every library's Unicode version."""
    if text.isascii():
        return _ODD.isdisjoint(text)
    chars = set(text)
    return _ODD.isdisjoint(chars) and all(c.isalpha() and c < "\u0250" for c in chars if c > "\x7f")


def unsettled(text: str) -> bool:
    """Whether a text has characters whose class the libraries' Unicode
    versions need not share (unassigned up to 15.0)."""
    return any(c > "\u02ff" and (unicodedata.category(c) == "Cn" or "\U0002ebf0" <= c <= "\U0002ee5d") for c in set(text))


def cut_pieces(text: str) -> list[str] | None:
    """The pieces of ``PATTERN``, or None for a text that is ``unsettled``."""
    if plain(text):
        return _PLAIN(text)
    return None if unsettled(text) else _PIECES(text)


class Memo(dict):
    """Two generations of what a worker has learnt: when the young one is
    full it becomes the old one, and what is still in use moves on."""

    def __init__(self, size: int = MEMO):
        self.size, self.old = size, {}

    def missing(self, keys) -> set:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        new = set(keys).difference(self)
        known = new.intersection(self.old)
        self.update((k, self.old[k]) for k in known)
        return new - known


class PieceEncoder:
    """Ids of texts. Pieces of ``pattern`` are mapped to byte characters and
    encoded by a tokenizers model, each distinct piece once; ``whole`` encodes
    the rare texts that are ``unsettled``."""

    def __init__(self, model, pattern: str, whole):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.pieces, self.whole = Tokenizer(model), regex.compile(pattern).findall, whole
        self.quick = _PLAIN if pattern == PATTERN else None
        self.memo = Memo()

    def _cut(self, text: str) -> list[str] | None:
        if self.quick and plain(text):
            return self.quick(text)
        return None if unsettled(text) else self.pieces(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        new = list(self.memo.missing(chain.from_iterable(c for c in cut if c)))
        mapped = [p.encode().decode("latin-1").translate(_TO_CHARS) for p in new]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(mapped, add_special_tokens=False)):
            self.memo[p] = np.array(e.ids, "<u4").tobytes()
        get = self.memo.__getitem__
        return [np.array(self.whole(t), "<u4").tobytes() if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


def rank_model(ranks: dict[bytes, int]):
    """A tokenizers BPE model that merges as a rank file says: every pair whose
    bytes joined are a token merges with that token's rank."""
    from tokenizers.models import BPE

    name = {t: t.decode("latin-1").translate(_TO_CHARS) for t in ranks}
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((name[token[:i]], name[token[i:]]))
    return BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class RankCodec:
    """Encoder and decoder of a rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        exact = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encoder = PieceEncoder(rank_model(ranks), pattern, exact.encode_ordinary)
        # the model's characters, back to bytes
        chars = {r: t.decode("latin-1").translate(_TO_CHARS) for t, r in ranks.items()}
        self.token_bytes = [bytes(_TO_BYTE[c] for c in chars.get(i, "")) for i in range(max(chars) + 1)]
        self.token_length = np.array([len(b) for b in self.token_bytes], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoder.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a sequence; a character split over tokens is whole again
        once its tokens are joined."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 character of each token; the tokens of a split
        character all cover that character."""
        ends = np.cumsum(self.token_length[np.frombuffer(ids, "<u4")])
        if not len(ends):
            return ends, ends
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        begins = np.concatenate([[0], ends[:-1]])
        return char[begins], char[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


def text_runs(batch: pa.RecordBatch, limit: int = _BATCH_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``limit`` characters and at
    most ``rows`` rows; null is empty."""
    column, run, size, first = batch.column("text"), [], 0, 0
    for i, value in enumerate(column):
        t = value.as_py() or ""
        if run and (size + len(t) > limit or len(run) == rows):
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def _encode_rows(batches, path: str, pattern: str, offsets: bool):
    c = codec(path, pattern)
    for batch in batches:
        for first, texts in text_runs(batch):
            ids = c.encode(texts)
            cols = [batch.column("doc_id").slice(first, len(texts)), pa.array(ids, pa.binary())]
            names = ["doc_id", "ids"]
            if offsets:
                spans = [c.offsets(i, t.encode()) for i, t in zip(ids, texts)]
                cols += [pa.array([s[k].tolist() for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """Encode whole texts without special tokens.

    Returns one row per input row: doc_id, ids (binary, little-endian unsigned
    32-bit) and, with ``offsets``, starts and ends (character positions of
    each token). Null counts as empty and has no ids; repeated rows encode
    alike; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary" + (", starts array<int>, ends array<int>" if offsets else "")
    return src.mapInArrow(partial(_encode_rows, path=path, pattern=pattern, offsets=offsets), schema)


def _decode_rows(batches, path: str, pattern: str):
    c = codec(path, pattern)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            raw = [c.decode(v or b"") for v in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary()),
                                              pa.array([r.decode("utf-8", "replace") for r in raw])],
                                             names=["doc_id", "bytes", "text"])


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Decode rows of ``encode`` (doc_id, ids): doc_id, bytes, text. Ids that
    end inside a character give their exact bytes; the text shows U+FFFD there."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode_rows, path=path, pattern=pattern),
                                                     f"doc_id {kind}, bytes binary, text string")


def _round_trip_rows(batches, path: str, pattern: str):
    c = codec(path, pattern)
    for batch in batches:
        for first, texts in text_runs(batch):
            ids = c.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(texts)), pa.array([len(i) // 4 for i in ids], pa.int64()),
                 pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                 pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ``encode`` and of ``decode`` of its ids, in one pass: doc_id,
    n_tokens, ids_sha256, decoded_sha256. Cases as in ``encode``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_round_trip_rows, path=path, pattern=pattern),
                          f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def local_uri(path: str) -> str:
    """``file:/x`` as the ``file:///x`` that Arrow's file systems take."""
    return re.sub(r"^file:/(?!/)", "file:///", path)
