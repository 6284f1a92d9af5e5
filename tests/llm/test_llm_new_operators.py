"""Golay-code SimHash, bit-sliced whitening and tokenizer alignment against
plain versions, with nulls, empty, long, tied and repeated rows, clashing
column names, empty tables and hot groups."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from zonestats.llm import alignment, queries, simhash, whitening
from zonestats.llm.common import join_by_weight, saved

from conftest import SF_SMALL

rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


# --- SimHash ---------------------------------------------------------------

def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """The smallest number reachable over pairs of at most two differing bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    index = simhash.codeword_index(words)
    assert (np.bincount(index, minlength=4096) == 2048).all()  # spheres of 1 + 23 + 253 + 1771 words
    zero = words[index == 0]
    assert np.bitwise_count(zero).max() == 3


def test_near_segments_share_a_codeword():
    r = np.random.default_rng(1)
    for at, bits in simhash.SEGMENTS:
        words = r.integers(0, 1 << bits, 300)
        near = [set(x) for x in simhash.nearby(words, bits).tolist()]
        assert max(map(len, near)) <= 6
        for i, j in itertools.combinations_with_replacement(range(bits), 2):
            turned = words ^ (1 << i) ^ (1 << j)
            for a, b in zip(near, simhash.nearby(turned, bits).tolist()):
                assert a & set(b)


def test_fingerprint_is_the_plain_one():
    texts = [None, "", " \n", "One", "one two", "one  TWO\tthree", "Éa b c", prose(5000), "a b c " * 999] + [prose(n) for n in range(3, 40)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def test_spark_hash_of_a_shingle_is_the_same(spark):
    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def flipped(base, bits):
    return base ^ sum(1 << b for b in bits)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links_of_fingerprints(spark, bucket):
    """Clusters of many near fingerprints, in large buckets too, and chains."""
    base = [rnd.getrandbits(64) for _ in range(60)]
    prints = set(base) | {0, (1 << 64) - 1, 1, 3}
    for b in base[:20]:
        prints |= {flipped(b, rnd.sample(range(64), k)) for k in (1, 2, 2, 3, 3, 4)}
    prints |= {flipped(base[20], c) for c in itertools.combinations(range(43, 64), 3)}  # one clean segment, 1,330 fingerprints
    chain = base[21]
    for k in range(8):
        chain = flipped(chain, rnd.sample(range(64), 2))
        prints.add(chain)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = saved(spark.createDataFrame([(p,) for p in signed], "print long").repartition(5), "test-prints")
    links = simhash.print_links(nodes, bucket).collect()
    where = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert ((a ^ b) % (1 << 64)).bit_count() <= 2
        x, y = sorted((find(where[a]), find(where[b])))
        root[y] = x
    assert [find(i) for i in range(len(prints))] == plain_components(prints)


SCHEMA = "doc_id long, text string, print long, root string, component_id int, key string"


def test_simhash_rows(spark):
    base = prose(400)
    words = base.split(" ")
    texts = [None, "", "  ", "x", base, base, base.upper(), base.replace(" ", "\n"), prose(20_000)]
    for i in range(12):
        w = list(words)
        w[33 * i] = "changed"
        texts.append(" ".join(w))
    texts += [prose(30) for _ in range(30)]
    rows = [(i, t, 1, "r", 2, "k") for i, t in enumerate(texts)]
    rows += [rows[6], (None, base, 1, "r", 2, "k"), (None, "nobody else has this", 1, "r", 2, "k"), (-5, "", 1, "r", 2, "k")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in simhash.simhash_duplicates(docs).collect()]
    prints = [plain_print(r[1]) for r in rows]
    comp = plain_components(prints)
    low = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None), default=None) for c in comp}
    want = [(r[0], f"{p:016x}", low[c]) for r, p, c in zip(rows, prints, comp)]
    assert collections.Counter(got) == collections.Counter(want)
    assert len({c for c in comp[9:21]} & {comp[4]}) == 1  # some near copies are caught
    assert simhash.simhash_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_simhash_query(spark, duck):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op11_simhash_golay"](spark, SF_SMALL).collect()}
    rows = sorted(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    prints = [plain_print(t) for _, t in rows]
    assert got == {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, plain_components(prints))}


def test_join_by_weight_keeps_every_row(spark):
    rows = saved(spark.createDataFrame([(i, 7 if i % 3 else i % 50) for i in range(3000)] + [(-1, None), (-2, 999)], "i long, k long"), "test-rows")
    table = spark.createDataFrame([(k, str(k)) for k in range(60)], "k long, v string")
    got = {r["i"]: r["v"] for r in join_by_weight(rows, table, "k", 20).collect()}
    want = {i: str(7 if i % 3 else i % 50) for i in range(3000)} | {-1: None, -2: None}
    assert got == want


# --- whitening -------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, component string, n int, vector int"


def vectors(m=300, d=7, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(m, d)) @ r.normal(size=(d, d))
    x[:, 0] *= 50
    return [(i, [float(np.float32(v)) for v in row], 1, "c", 2, 3) for i, row in enumerate(x)]


def plain_whiten(rows, components=32):
    ok = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in ok], object)
    n, s = len(x), x.sum(axis=0)
    dev = x * n - s
    centred = (dev / n).astype(float)
    cov = (centred.T @ centred) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return ok, n, (dev * dev).sum(axis=1), centred @ v / np.sqrt(e), e / np.trace(cov)


def check_whiten(got, rows):
    ok, n, deviation, white, explained = plain_whiten(rows)
    k = white.shape[1]
    assert len(got) == len(ok) * k
    by = collections.defaultdict(dict)
    for r in got:
        by[r["vec_id"]].setdefault(r["component"], []).append(r)
    sign = None
    for i, row in enumerate(ok):
        found = by[row[0]]
        assert sorted(found) == list(range(1, k + 1))
        w = np.array([found[c][0]["whitened"] for c in range(1, k + 1)])
        sign = np.sign(w * white[i]) if sign is None else sign
        np.testing.assert_allclose(w * sign, white[i], rtol=1e-7, atol=1e-8)
        assert {(r["n"], r["deviation"]) for c in found.values() for r in c} == {(n, deviation[i])}
        np.testing.assert_allclose([found[c][0]["explained"] for c in range(1, k + 1)], explained, rtol=1e-9)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_plane_products_are_exact():
    r = np.random.default_rng(0)
    for high, m in ((1, 5), (100, 200), (1 << 20, 130), (1 << 45, 70), (1 << 62, 3)):
        y = r.integers(0, high, (m, 6))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.plane_products(y) == want).all()


def test_whitening(spark):
    rows = vectors()
    bad = [(-1, None, 1, "c", 2, 3), (-2, [1.0] * 6 + [None], 1, "c", 2, 3), (-3, [float("nan")] + [1.0] * 6, 1, "c", 2, 3),
           (-4, [float("inf")] + [1.0] * 6, 1, "c", 2, 3), (-5, [None], 1, "c", 2, 3)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows + bad + [rows[3]], VECTORS).repartition(parts)
        check_whiten(whitening.whiten(df).collect(), rows + [rows[3]])
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame(bad, VECTORS)).collect() == []


def test_whitening_of_dimensions_without_spread(spark):
    rows = [(i, [1.0, float(i % 7), 2.0 * (i % 7), float(i * i % 11)], 1, "c", 2, 3) for i in range(100)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    empty = {r["component"] for r in got if r["whitened"] is None}
    assert empty == {3, 4} and max(r["identity_error"] for r in got) < 1e-9
    same = whitening.whiten(spark.createDataFrame([rows[0]] * 5, VECTORS)).collect()
    assert len(same) == 20 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(None, None, 0, None)}


def test_whitening_refuses_what_it_cannot_do(spark):
    with pytest.raises(Exception, match="entries"):
        whitening.whiten(spark.createDataFrame(vectors(d=3) + vectors(d=4), VECTORS).coalesce(1)).collect()
    with pytest.raises(Exception, match="64-bit"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0], 1, "c", 2, 3)], VECTORS)).collect()


def test_whitening_query(spark, duck):
    rows = [(i, e) for i, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    check_whiten(queries.QUERIES["op12_whitening"](spark, SF_SMALL).collect(), rows)


# --- alignment -------------------------------------------------------------

class Plain:
    """Whole texts through both libraries, all token pairs compared."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        from zonestats.llm.byte_bpe import byte_chars

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.char = {c: b for b, c in enumerate(byte_chars())}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw_a = [bytes(self.char[c] for c in self.a.id_to_token(i)) for i in a]
        raw_b = []
        for i in b:
            p = self.b.id_to_piece(i)
            raw_b.append(bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
        whole = (" " + text).encode()
        return (a, b, raw_a, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else None

    def rows(self, docs):
        out, count = [], collections.Counter()
        for i, text in docs:
            got = self.tokens(text) if text else None
            if got is None:
                out.append((i, 0, 0, 0, [], ""))
                continue
            a, b, raw_a, raw_b = got
            ends_a, ends_b = list(itertools.accumulate(map(len, raw_a))), list(itertools.accumulate(map(len, raw_b)))
            links, j0 = [], 0
            for x, ea, ra in zip(a, ends_a, raw_a):
                for j in range(j0, len(b)):
                    if ends_b[j] - len(raw_b[j]) >= ea:
                        break
                    if ends_b[j] > ea - len(ra):
                        links.append((x, b[j]))
                    else:
                        j0 = j + 1
            cuts = sorted(set(ends_a) & set(ends_b))
            groups, low = [], 0
            for cut in cuts:
                groups.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= cut) + "|"
                              + ",".join(str(x) for x, e in zip(b, ends_b) if low < e <= cut))
                low = cut
            count.update(links)
            out.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        best = collections.defaultdict(int)
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        return count, [(i, na, nb, g, len(l), sum(count[p] == best[p[1]] for p in l), sum(count[p] for p in l), s) for i, na, nb, g, l, s in out]


TEXTS = [None, "", " ", "  ", "x", "trail ", " lead", "\n", "\nword\n\nnext  two", "a\tb　c d", "one;\r\ntwo);\r\n\r\nthree \r", "\rx",
         "a\x1cb c\x1f d", "<s>hi</s><0x41> <|endoftext|>x <unk>", "has ▁ inside", "ﬁne Ｆull ①", "日本語のテキスト x 漢字", "é é ß",
         "\U0001F600 \U0001F468‍\U0001F469", "123 4567,89", "don't we'll I'M", "x" * 3000, "tab\t\ttab", "\x00 nul", "͸ unassigned \U0002ebf0",
         "y" * 50 + " " * 40 + "z", " line ", "\x85next"]
DOC = "doc_id long, text string, rid int, pair int, block string, n_links int, n_best int"


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "b", 3, 4) for i, t in rows], DOC)


@pytest.mark.parametrize("flush", [alignment.FLUSH, 5])
def test_alignment(spark, flush):
    rows = list(enumerate(TEXTS + [prose(n) + ".\n" + prose(9) for n in range(1, 60, 4)] + [prose(8000)]))
    rows += [rows[-3], rows[-3], (None, rows[-4][1])]
    got = alignment.align_tokenizers(as_docs(spark, rows).repartition(4), A, B, flush=flush)
    count, want = Plain().rows(rows)
    assert collections.Counter(tuple(r) for r in got.scores().collect()) == collections.Counter(want)
    pairs = {(r["a_id"], r["b_id"]): r["n_links"] for r in got.pairs.collect()}
    assert pairs == dict(count)


def test_alignment_document_counts(spark):
    rows = [(i, t) for i, t in enumerate(["a cat", "a cat a cat a cat a cat", "a dog", None])]
    got = alignment.align_tokenizers(as_docs(spark, rows).coalesce(1), A, B, flush=1)
    plain = Plain()
    docs = collections.Counter()
    for _, t in rows:
        docs.update(set(plain.rows([(0, t)])[0]))
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in got.pairs.collect()} == dict(docs)


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = alignment.align_tokenizers(as_docs(spark, rows), A, B).scores().collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_bitmaps():
    r = np.random.default_rng(2)
    for n in (0, 1, 4095, 4096, 60_000, 65_536):
        docs = np.sort(r.choice(1 << 16, n, replace=False)).astype(np.uint16)
        assert (alignment.unpack(alignment.pack(docs)) == docs).all()


def test_dense_bitmaps_merge(spark):
    """A pair that nearly every document has, written in many parts."""
    rows = [(i, "the the" if i % 3 else "the") for i in range(9000)]
    got = alignment.align_tokenizers(as_docs(spark, rows).coalesce(1), A, B, flush=700)
    count, want = Plain().rows(rows)
    assert sorted(tuple(r) for r in got.scores().collect()) == sorted(want)
    assert got.postings.agg(F.max("n")).first()[0] >= 6000
    assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["n_links"]) for r in got.pairs.collect()} == {k: (9000, v) for k, v in count.items()}


def test_alignment_query(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = queries.QUERIES["op13_token_alignment"](spark, SF_SMALL).collect()
    assert sorted(tuple(r) for r in got) == sorted(Plain().rows(rows)[1])
