"""Token files and segment tables against the libraries' own calls."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from zonestats.llm import token_files
from zonestats.llm.segments import SegmentTable, segment_starts
from zonestats.session import scratch_dir

PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, shard string, at int, tie int, start string"
POOL = ["a", "b", "the", " ", "  ", "\n", "\r", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'ve", "0", "12", "é", "ß", "日本",
        ".", "!!", "_", "<|endoftext|>", "<|end", "\U0001F600", "͸", "²", "x" * 30]


OWN = Tokenizer.from_file(PATH)


def library(text):
    return OWN.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_library():
    r = random.Random(4)
    plain = Tokenizer.from_file(PATH)
    enc = token_files.SegmentEncoder(PATH, P.PATTERN, 0, "<u2")
    for size in (1, 40, 400):
        texts = ["".join(r.choice(POOL) for _ in range(r.randint(0, 30))) for _ in range(size)]
        ids, counts = enc.encode(texts)
        want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_table_that_is_emptied_agrees():
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(50)) for _ in range(200)]
    large, small = token_files.SegmentEncoder(PATH, P.PATTERN, 0, "<u2"), token_files.SegmentEncoder(PATH, P.PATTERN, 0, "<u2")
    small.table.limit = 1000
    want = large.encode(texts)[0].tolist()
    assert [i for k in range(0, 200, 10) for i in small.encode(texts[k:k + 10])[0].tolist()] == want
    assert len(small.table.number) < len(large.table.number)


def test_segments_begin_at_white_space_only():
    text = b"one  two\n\nthree;\r\nfour \r five\x1csix"
    starts = segment_starts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    cuts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    assert cuts == [b"one", b"  two", b"\n\nthree;\r\nfour", b" \r five\x1csix"]


def test_hash_collisions_are_noticed():
    table = SegmentTable(lambda raw, lengths: [(np.zeros(len(lengths), np.int32), np.ones(len(lengths), np.int64))])
    table.encode([b"one two"])
    table.check[:] += np.uint64(1)
    with pytest.raises(RuntimeError, match="hash"):
        table.encode([b"one two"])


def test_token_files_with_special_strings_and_hot_ids(spark):
    texts = ["x a<|endoftext|>b y", "<|endoftext|>", "", None, "tail <|endoftext", "plain words\n\nhere"]
    rows = [(i % 7, texts[i % 6], "s", 1, 2, "t") for i in range(60)] + [(None, f"null id {i}", "s", 1, 2, "t") for i in range(400)]
    rows += [(3, f"same id {i}", "s", 1, 2, "t") for i in range(400)]
    folder = scratch_dir(spark, f"t-{uuid.uuid4().hex}")
    index = token_files.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), folder, PATH, P.PATTERN, shards=8, length=16, batch=2)
    got = sorted(token_files.read_checksums(index, folder).collect(), key=lambda r: r["start"])
    want = {(i, t): [*library(t or ""), 0] for i, t, *_ in rows}
    left = sorted(((i is None, i or 0, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for (i, t), w in
                   [((i, t), want[i, t]) for i, t, *_ in rows]))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == left
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [(r["doc_id"] is None, r["doc_id"] or 0) for r in got]
    assert ids == sorted(ids)
    sizes = [r[1] for r in index.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 250  # the 400 rows of one id, and those without, are split


def test_many_shards_can_be_planned(spark):
    folder = scratch_dir(spark, f"t-{uuid.uuid4().hex}")
    rows = [(i, f"text {i}", "s", 1, 2, "t") for i in range(300)]
    index = token_files.write_tokens(spark.createDataFrame(rows, SCHEMA), folder, PATH, P.PATTERN, shards=1000)
    assert index.count() == 300
