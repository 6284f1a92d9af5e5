"""Scores and groups of the operators that SQL cannot express, recomputed one
value at a time."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from zonestats.llm import lang_id, near_dup, quality, toxicity
from zonestats.llm import textkernel as tk

rnd = random.Random(8)
VOCAB = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


# --- quality ---------------------------------------------------------------

def test_quality_score(spark):
    rows = [(i, prose(rnd.randint(0, 90)) + rnd.choice(["", ". Und é #x", "\n\n!! ok"])) for i in range(60)] + [(90, None), (91, ""), (None, prose(60))]
    trusted = {3, 5, 8, 13, 90}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(4, 0), (None, 1)], "doc_id long, quality int")

    def buckets(text):
        tokens = re.findall(r"[0-9A-Za-z_\x80-\U0010FFFF]+|[!-/:-@\[-^`{-~]+", (text or "").lower())
        one = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
        two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, tokens[1:])]
        signed = [h - (1 << 64) if h >> 63 else h for h in one + two]
        return [h % quality.BUCKETS for h in signed]

    grams = [buckets(t) for _, t in rows]
    raw = collections.Counter(itertools.chain.from_iterable(grams))
    target = collections.Counter(itertools.chain.from_iterable(g for (i, _), g in zip(rows, grams) if i in trusted))
    share = sum(target.values()) / sum(raw.values())
    weight = {b: round(math.log((target[b] + 1) / (raw[b] * share + 1)), 6) for b in raw}
    want = collections.Counter((i, round(sum(weight[b] for b in g) / len(g), 9) if g else 0.0) for (i, _), g in zip(rows, grams))
    weights = quality.bucket_weights(docs, quality.trusted_ids(labels))
    got = quality.quality(docs, weights).select("doc_id", "score").collect()
    assert collections.Counter((r[0], round(r[1], 9)) for r in got) == want


# --- language --------------------------------------------------------------

def plain_grams(text):
    out, words = collections.Counter(), []
    for b in text.lower().encode():
        c = chr(b)
        words.append(bytes([b]) if b >= 128 or c.isalpha() else b" ")
    joined = b" " + b" ".join(b"".join(words).split()) + b" "
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            h = 0
            for b in joined[i:i + n]:
                h = (h * 257 + b + n) % (1 << 32)
            out[(h * 2654435761 % (1 << 32) >> 16) % lang_id.DIM] += 1
    return out


def test_language_by_plain_vectors(spark):
    tongues = {"aa": "abcdeé", "bb": "abxyzwß", "cc": "klmnoр"}
    rows = [(i, lang, " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(1, 60))))
            for i, (lang, a) in enumerate(itertools.chain.from_iterable(itertools.repeat(t, 40) for t in tongues.items()))]
    rows += [(900, "aa", None), (901, "bb", ""), (902, None, "abc 12"), (903, "cc", "123 ..."), (904, None, prose(30_000))]
    docs = spark.createDataFrame([(i, t, g) for i, g, t in rows], "doc_id long, text string, lang string").repartition(3)
    model = lang_id.fit(docs, F.col("doc_id") % 4 == 2)
    train = [t or "" for i, g, t in rows if g is not None and i % 4 != 2]
    seen = collections.Counter(itertools.chain.from_iterable(set(plain_grams(t)) for t in train))
    idf = [math.log((1 + len(train)) / (1 + seen[b])) + 1 for b in range(lang_id.DIM)]
    np.testing.assert_allclose(model["idf"], idf, rtol=1e-6)
    got = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    right = 0
    for i, lang, text in rows:
        v = {b: math.log1p(n) * idf[b] for b, n in plain_grams(text or "").items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x / size * float(c[b]) for b, x in v.items()) for c in model["centroids"]]
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["nearest"], got[i]["score"]) == ("und", 0.0)
            continue
        best = max(near)
        assert got[i]["score"] == pytest.approx(best, abs=1e-5)
        assert got[i]["nearest"] in {g for g, n in zip(model["langs"], near) if n > best - 1e-5}
        right += got[i]["nearest"] == lang
    assert right >= 115


def test_many_short_texts_are_counted_in_runs(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('abc ', id) AS text", "'aa' AS lang").coalesce(1)
    model = lang_id.fit(docs, F.lit(False))
    assert {r["nearest"] for r in lang_id.identify(docs, model).collect()} == {"aa"}
    assert lang_id.identify(docs, lang_id.fit(docs.limit(0), F.lit(False))).select("nearest").distinct().collect()[0][0] == "und"


# --- near duplicates at both widths -----------------------------------------

@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_at_width(spark, width):
    base = prose(100)
    texts = [None, "", "one two", "one two", "one two three four", base, base + " more", base.upper()]
    for i in range(25):
        w = base.split(" ")
        for j in rnd.sample(range(100), rnd.randint(1, 6)):
            w[j] = "changed"
        texts.append(" ".join(w))
    texts += [prose(40) for _ in range(10)]
    rows = list(enumerate(texts))
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root] if root[b] < root[a] else [root[a] if r == root[b] else r for r in root]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=width).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(rows))}


# --- toxicity --------------------------------------------------------------

def plain_marginals(score, trans):
    """Forward and backward messages, word by word."""
    fore, back = [], [None] * len(score)
    for k, s in enumerate(score):
        v = [1.0, math.exp(s)] if k == 0 else [sum(fore[-1][i] * math.exp(trans[i][j]) for i in (0, 1)) * (math.exp(s) if j else 1.0) for j in (0, 1)]
        fore.append([x / sum(v) for x in v])
    nxt = [1.0, 1.0]
    for k in range(len(score) - 1, -1, -1):
        back[k] = nxt
        v = [sum(math.exp(trans[i][j]) * (math.exp(score[k]) if j else 1.0) * nxt[j] for j in (0, 1)) for i in (0, 1)]
        nxt = [x / sum(v) for x in v]
    out = []
    for f, b in zip(fore, back):
        w = [x * y for x, y in zip(f, b)]
        out.append(w[1] / sum(w))
    return out


def toxic_rows():
    rows = []
    for i in range(300):
        w = [rnd.choice(VOCAB) for _ in range(40)]
        if i % 3 == 0:
            w[rnd.randrange(40)] = rnd.choice(["zorgle", "blastid"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    d = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    return toxicity.fit(d, d, F.lit(False))


def test_document_score_word_by_word(spark, toxic_model, monkeypatch):
    texts = [prose(30), prose(600) + " zorgle " + prose(900), prose(1700), "zorgle", "", None, "zorgle blastid " * 20]
    got = {r["doc_id"]: r["score"] for r in toxicity.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), toxic_model).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[0-9A-Za-z]+", text or "")
        if not words:
            assert got[i] == 0.0
            continue
        raw = (text or "").encode()
        w = tk.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), white=tk.MARKS)
        f = toxicity.features(w)
        score = [sum(float(toxic_model["weights"][t][f[t][k]]) for t in range(4)) + toxic_model["bias"] for k in range(len(words))]
        p = plain_marginals(score, toxic_model["trans"].tolist())
        windows = [p[k:k + toxicity.WINDOW] for k in range(0, len(p), toxicity.WINDOW)]
        worst = max(windows, key=sum)
        top = min(max(max(worst), 1e-6), 1 - 1e-6)
        b = toxic_model["doc"]
        logit = b[0] * math.log(top / (1 - top)) / 5 + b[1] * math.log1p(sum(worst)) + b[2] - math.log(len(windows))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_long_clean_texts_are_left_alone(spark, toxic_model):
    clean = [t for _, t, y in toxic_rows() if not y]
    texts = [" ".join(clean[(7 * i) % 100:][:k]) for k in (1, 20, 100) for i in range(5)]
    texts += [t + " zorgle blastid zorgle " + t for t in texts]
    got = {r["doc_id"]: r["score"] for r in toxicity.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), toxic_model).collect()}
    assert max(got[i] for i in range(15)) < 0.5 < min(got[i] for i in range(15, 30))


def test_sample_takes_texts_of_any_length(spark):
    texts = [None, "", "short", "x" * 40, "".join(f"{i:04d}" for i in range(100))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(toxicity.sample_text(F.col("doc_id"), F.col("text"), 8, 5)).collect()]
    assert got[:4] == texts[:4]
    pieces = got[4].split("\n")
    assert len(pieces) == 5 and pieces == sorted(pieces) and all(p in texts[4] and len(p) == 8 for p in pieces)
