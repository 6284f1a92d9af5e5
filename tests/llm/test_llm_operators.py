"""Operators of the training-data pipeline against plain versions on small
tables with nulls, empty, long, tied and repeated rows, extra columns with
clashing names, and on empty tables."""

import collections
import hashlib
import math
import random
import re
import textwrap
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from zonestats.llm import (byte_bpe, components, exact_dup, lang_id, license_scan, line_runs, mixing, near_dup, quality,
                           token_files, toxicity)
from zonestats.session import scratch_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, score int, size int"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
WHITE = " \t\n\x0b\x0c\r"


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def make_rows():
    base, line = prose(120), "This common line is found in a great many documents here."
    near = base.split(" ")
    texts = [None, "", "  \n\t ", "one", "one two three", base, base, base.upper(), base.replace(" ", "\t "), prose(3000)]
    for i in range(12):  # near copies of one text, and of nothing
        w = list(near)
        w[10 * i] = "changed"
        texts.append(" ".join(w))
    texts += [prose(60) + "\n" + (line if i % 2 else "  " + line.upper() + "\r") + "\n" + prose(20) for i in range(9)]
    texts += ["a b c " * 40, "é ß Ñ ##$ |\n|\n|", "日本語 \U0001F600 x", " leading", "trailing ", "x" * 5000]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], 0, "k", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, base, "en", "s0", 0, "k", 1, 2, 3)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (9, 1), (9, 1), (None, 1), (3, 0)], "doc_id long, quality int")
    weights = quality.bucket_weights(docs, quality.trusted_ids(labels))
    got = quality.quality(docs, weights).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, text, *_ in ROWS[:-2]:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = list(zip(w, w[1:], w[2:]))
        count = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = by_id[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed), i
        assert r["kept"] == (not failed and r["score"] >= quality.LEAST)
    assert quality.accepted(docs, weights).columns == docs.columns
    assert quality.accepted(docs, weights).count() == sum(r["kept"] for r in got)
    assert quality.quality(none, quality.bucket_weights(none, quality.trusted_ids(labels))).count() == 0


def test_quality_weights_follow_the_ratio(spark):
    rows = [(i, "good words only", 1) for i in range(30)] + [(100 + i, "$$$ ### junk", 0) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    weights = quality.bucket_weights(d, quality.trusted_ids(d), prior=1.0)
    got = {r["doc_id"]: r["score"] for r in quality.quality(d, weights).collect()}
    assert got[0] == pytest.approx(math.log((30 + 1) / (30 * 0.5 + 1)), abs=0.05) and got[100] < -1


def test_quality_scores_supplementary_characters(spark):
    rows = [(i, f"\U0001F600{chr(0x20000 + i)} \U0010FFFF " * 30, 0) for i in range(30)]
    rows += [(100 + i, "good words only " * 20, 1) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    weights = quality.bucket_weights(d, quality.trusted_ids(d))
    got = {r["doc_id"]: r for r in quality.quality(d, weights).collect()}
    assert got[0]["score"] < -1 and not got[0]["kept"] and got[0]["n_words"] == 60 and got[100]["score"] > 0


def test_exact_dedup(docs, none):
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        low = min(x for x in ids if x is not None)
        seen = False
        for x in ids:
            want[(x, low, len(ids), x == low and not seen, hashlib.sha256(t.encode()).hexdigest())] += 1
            seen = seen or x == low
    assert collections.Counter(tuple(r) for r in exact_dup.exact_duplicates(docs).collect()) == want
    # every hash collides: texts are still told apart by their bytes
    clash = exact_dup.exact_duplicates(docs, hash_fn=lambda c: F.length(c) % 2)
    assert collections.Counter(tuple(r) for r in clash.collect()) == want
    assert exact_dup.exact_duplicates(none).count() == 0


def test_line_runs(spark, docs, none):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    holders = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(-1 if i is None else i)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != (-1 if i is None else i))]
        want[(i, "\n".join(stay), len(lines), len(lines) - len(stay))] += 1
    got = line_runs.dedup_lines(docs, batches=5, fan_in=2)
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == want
    assert line_runs.dedup_lines(none).count() == 0


def test_near_duplicates(spark, docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [(i, shingles(t)) for i, t, *_ in ROWS]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    want = collections.Counter()
    for a, (i, x) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if find(b) == find(a) and sets[b][0] is not None]
        low = min(ids, default=None)
        want[(i, len(x), low, i == low)] += 1
    got = near_dup.near_duplicates(docs, block=4)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()) == want
    assert near_dup.near_duplicates(none).count() == 0


def test_min_max_signature_is_unbiased():
    a = near_dup.tk.stream(900, 3)
    x, y = a[:700], a[200:]  # Jaccard 5 / 9
    mul, add = near_dup._permutations(2000)
    same = near_dup.min_max(x, mul, add) == near_dup.min_max(y, mul, add)
    assert abs(same[:2000].mean() - 5 / 9) < 0.04 and abs(same[2000:].mean() - 5 / 9) < 0.04


def test_overlaps_are_exact():
    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 40).astype(np.uint64)) for i in range(9)]
    got = near_dup.overlaps(sets[:4], sets)
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets[:4]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (203, 201)]
    got = components.connected_components(spark.createDataFrame(chain, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {**{i: 0 for i in range(41)}, 200: 200, 201: 200, 203: 200}


def test_mixing(spark, docs, none):
    got = mixing.mix(docs, chunk=4, fan_in=2).collect()
    assert len(got) == len(ROWS)
    sizes = collections.Counter()
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * sizes[s]}
        target.update({s: 2.0 * sizes[s] for s in over} if over else {s: left * weight[s] / sum(weight[x] for x in free) for s in free})
        free = free - over if over else set()
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    for s in order:
        biggest = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - target[s]) <= biggest
    again = mixing.mix(docs.repartition(2), chunk=4, fan_in=2).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0


def test_transfer_keeps_words_and_expectation():
    for pi, si, pj, sj in ((0.3, 7, 0.8, 5), (0.6, 100, 0.4, 3), (0.5, 2, 0.5, 2)):
        outcomes = [mixing.transfer(pi, si, pj, sj, u / 1000 + 5e-4) for u in range(1000)]
        for a, b in outcomes:
            assert a * si + b * sj == pytest.approx(pi * si + pj * sj) and min(abs(a), abs(1 - a), abs(b), abs(1 - b)) < 1e-9
        assert np.mean([a for a, _ in outcomes]) == pytest.approx(pi, abs=2e-3)


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    folder = scratch_dir(spark, f"t-{uuid.uuid4().hex}")
    path = P.path("byte_bpe_50k.json")
    index = token_files.write_tokens(docs, folder, path, P.PATTERN, shards=3, length=64, batch=2)
    got = sorted(token_files.read_checksums(index, folder).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(path)
    start = 0
    for r, (i, text, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = token_files.ShardReader(folder, 0)
    ids, mask = reader.sequence(1)
    assert len(ids) == len(mask) == 64 and ids.to_numpy().base is not None and all(mask.to_pylist())
    other = scratch_dir(spark, f"t-{uuid.uuid4().hex}")
    assert token_files.write_tokens(none, other, path, P.PATTERN).count() == 0


def test_byte_bpe(docs, none):
    import tiktoken

    exact = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = {i: t or "" for i, t, *_ in ROWS}
    got = byte_bpe.encode(docs, RANKS, P.PATTERN, offsets=True)
    for r in got.collect():
        t = texts.get(r["doc_id"], ROWS[-1][1])
        ids = exact.encode_ordinary(t)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        raw, at = t.encode(), 0
        for k, i in enumerate(ids):  # each token's characters hold its bytes
            piece = exact.decode_single_token_bytes(i)
            assert piece in t[r["starts"][k]:r["ends"][k]].encode() and raw[at:at + len(piece)] == piece
            at += len(piece)
    back = byte_bpe.decode(got, RANKS, P.PATTERN).collect()
    assert all(r["text"] == texts.get(r["doc_id"], ROWS[-1][1]) for r in back)
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_byte_bpe_random_texts():
    import tiktoken

    exact = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    r = random.Random(2)
    pool = "aab  \n\t'sd0é ²\x1c!-=日͸\U0002ebf1\U0001F600"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [c * k for c in ("a", "-", " ", "ha", "\n") for k in range(1, 60)]
    c = byte_bpe.codec(RANKS, P.PATTERN)
    ids = c.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [exact.encode_ordinary(t) for t in texts]
    assert [c.decode(i).decode() for i in ids] == texts


def test_language_id(spark, none):
    words = {"aa": ["kami", "noro", "tiko", "sumi"], "bb": ["chwerz", "schtol", "brugg", "pflan"]}
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(words[g]) for _ in range(30)), g) for i, g in enumerate(["aa", "bb"] * 30)]
    d = spark.createDataFrame(rows + [(90, None, "aa"), (91, "12 34 !", "bb"), (92, "", None)], "doc_id long, text string, lang string")
    model = lang_id.fit(d, F.col("doc_id") % 4 == 2, sample=10, k=2)
    assert set(model["langs"]) == {"aa", "bb"}
    for x in lang_id.identify(d, model).collect():
        want = dict((i, g) for i, _, g in rows).get(x["doc_id"], "und")
        assert x["nearest"] == want and 0 <= x["score"] <= 1 and (x["score"] > 0.5) == (want != "und")
    assert lang_id.identify(none, model).count() == 0
    empty = lang_id.fit(none, F.lit(False))
    assert {x["nearest"] for x in lang_id.identify(d, empty).collect()} == {"und"}


def test_language_id_rejects_the_far(spark):
    rows = [(i, "kami noro tiko sumi " * 5, "aa") for i in range(8)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False))
    far = spark.createDataFrame([(1, "xqzw vvjx qqwz", None)], "doc_id long, text string, lang string")
    assert lang_id.identify(far, model).first()["lang"] == "und"


def brute_marginals(score, trans):
    n = len(score)
    total, toxic = 0.0, np.zeros(n)
    for code in range(2 ** n):
        y = [(code >> k) & 1 for k in range(n)]
        w = math.exp(sum(s for s, b in zip(score, y) if b) + sum(trans[a][b] for a, b in zip(y, y[1:])))
        total += w
        toxic += np.array(y) * w
    return toxic / total


def test_field_marginals_against_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "_BLOCK", 3)
    g = np.random.default_rng(1)
    first = np.array([0, 5, 5, 6, 14])
    score, trans = g.normal(size=14) * 2, g.normal(size=(2, 2))
    p, _, _ = toxicity.marginals(score, first, trans)
    want = np.concatenate([brute_marginals(score[a:b], trans) for a, b in zip(first[:-1], first[1:]) if b > a])
    assert np.allclose(p, want)


def test_toxicity(spark, none):
    r = random.Random(9)
    rows = []
    for i in range(240):
        w = [r.choice(VOCAB) for _ in range(40)]
        if i % 3 == 0:
            w[r.randrange(40)] = r.choice(["zorgle", "Blastid,"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    d = spark.createDataFrame(rows + [(900, None, None), (901, "", None), (902, "zorgle " * 3000, None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d, F.col("doc_id") % 5 == 0)
    got = {x["doc_id"]: x for x in toxicity.tag(d, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 5 == 0]
    assert sum((got[i]["score"] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    for i, text, y in rows:
        for s in got[i]["spans"] if y else []:
            assert text[s["start"]:s["end"]] in ("zorgle", "Blastid")
    assert got[900]["score"] == got[901]["score"] == 0 and got[902]["score"] > 0.5 and not got[900]["spans"]
    assert toxicity.tag(none, model).count() == 0
    assert {x["score"] for x in toxicity.tag(d, toxicity.train([], np.zeros(0, bool))).collect()} == {0.0}


def test_license_scan(spark, none):
    mit, apache = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["Apache-2.0"]
    texts = [None, "", "no notice here", "text\nReleased under the MIT License.\nmore", prose(50) + "\n" + mit + "\n" + prose(20),
             mit.replace("deal in the Software", "use the Software").replace(". ", ".\n"),
             prose(2000) + " " + apache + " " + prose(2000), "This work is licensed under the GNU General Public License, version 3.",
             "all rights reserved, a licence of our own"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for x in license_scan.scan_licenses(d).collect():
        got[x["doc_id"]].append((x["license"], x["missing"]))
    assert got[3] == [("MIT-notice", 0)] and got[4] == [("MIT", 0)] and got[5][0][0] == "MIT" and got[5][0][1] > 0
    assert ("Apache-2.0", 0) in got[6] and got[7] == [("GPL-3.0-notice", 0)] and not any(got[i] for i in (0, 1, 2, 8))
    assert license_scan.scan_licenses(none).count() == 0


def names(text, **options):
    return [f["license"] for f in license_scan.scan_text(text, **options)]


def test_license_scan_of_wrapped_texts():
    """Line breaks, comment marks and length of the text do not matter."""
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0", "MPL-2.0-notice"):
        text = license_scan.TEMPLATES[name]
        for width in (30, 60, 72, 200):
            for mark in ("", " * ", "# "):
                wrapped = ("\n" + mark).join(textwrap.wrap(text.replace(": ", ":\n\n"), width))
                for own in (wrapped, wrapped.replace("\n", "\n\n"), prose(300) + "\n" + wrapped + "\n" + prose(300)):
                    assert names(own) == [name], (name, width, mark)
    # a notice file of more than 16,000 characters: each licence, where it lies
    order = ["MIT", "BSD-2-Clause", "Apache-2.0", "MIT", "MPL-2.0-notice"] * 8
    parts = [f"Copyright {k} " + prose(10) + "\n" + "\n".join(textwrap.wrap(license_scan.TEMPLATES[n], 70)) for k, n in enumerate(order)]
    text = "\n\n".join(parts)
    found = license_scan.scan_text(text)
    assert len(text) > 16_000 and [f["license"] for f in found] == order
    for f, part in zip(found, parts):
        assert text[f["start"]:f["end"]] in part


def test_license_scan_templates_and_variants():
    """Every template is found as itself, whole and alone; versions and
    variants are never taken for one another."""
    for name, text in license_scan.TEMPLATES.items():
        got = names(prose(40) + "\n" + "\n// ".join(textwrap.wrap(text, 70)) + "\n" + prose(40))
        assert got == [name], (name, got)
    gnu = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
    assert names(gnu) == ["GPL-3.0-or-later-notice"]
    assert names(gnu.replace("either version 3", "either version 2")) == ["GPL-2.0-or-later-notice"]
    assert names(gnu.replace("GNU General", "GNU Affero General")) == ["AGPL-3.0-or-later-notice"]
    assert names(gnu.replace("GNU General", "GNU Lesser\n * General")) == ["LGPL-3.0-or-later-notice"]
    assert names(gnu.replace("version 3", "version 9")) == []
    assert names(gnu[:gnu.index(", or\n")]) == ["GPL-3.0-only-notice-a"]
    assert names("Licensed under the Academic License, Version 2.0.") == []
    bsd = license_scan.TEMPLATES["BSD-3-Clause"]
    assert names(bsd.replace("copyright holder", "University").replace(": ", ":\n1. ")) == ["BSD-3-Clause"]


def test_every_template_holds_a_cue(spark):
    """No template, wrapped in any way, is left out by the filter before the scan."""
    texts = [(n, "\n// ".join(textwrap.wrap(t, w))) for n, t in license_scan.TEMPLATES.items() for w in (12, 25, 70)]
    df = spark.createDataFrame(texts, "name string, text string")
    assert df.filter(~F.col("text").rlike(license_scan.CUE)).count() == 0


def test_license_scan_spdx_tags():
    tag = "SPDX-License-Identifier: "
    assert names("/* " + tag + "GPL-2.0-only WITH Linux-syscall-note */") == ["GPL-2.0-only WITH Linux-syscall-note-tag"]
    assert names("# " + tag + "(MIT OR Apache-2.0) AND BSD-3-Clause\nor more") == ["MIT-tag", "Apache-2.0-tag", "BSD-3-Clause-tag"]
    assert names("<!-- " + tag + "LicenseRef-own-1.0 -->\n" + tag + "EPL-2.0+") == ["LicenseRef-own-1.0-tag", "EPL-2.0+-tag"]
    assert names(tag) == []


def test_license_scan_reductions_choose(monkeypatch):
    """Only windows that reach the threshold are compared, the most saved first."""
    plain, compared = license_scan._span, []

    def span(t, *args):
        compared.append(t.name)
        return plain(t, *args)

    monkeypatch.setattr(license_scan, "_span", span)
    text = prose(200) + "\n" + license_scan.TEMPLATES["BSD-3-Clause"] + "\n" + prose(200)
    assert names(text) == ["BSD-3-Clause"] and compared[0] == "BSD-3-Clause"
    compared.clear()
    assert names(text, least=0.99) == [] and not compared
    # all the words of a template in another order: no comparison is needed
    words = license_scan.TEMPLATES["MIT"].split()
    assert names(" ".join(words[::-1]), least=0.5) == [] and "MIT" not in compared
