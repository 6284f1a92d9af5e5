"""The licence scan against a plain version: every template aligned with every
place of a text by dynamic programming, without windows or compression."""

import random
import textwrap

from zonestats.llm import license_scan
from zonestats.llm.license_scan import COVERED, TEMPLATES

PLAIN = {n: license_scan._tokens(t)[0] for n, t in TEMPLATES.items()}


def best_place(t: list[str], words: list[str]):
    """(words missing and extra, missing, first, end) of the cheapest place."""
    row = [(0, 0, i) for i in range(len(words) + 1)]
    for w in t:
        new = [(row[0][0] + 1, row[0][1] + 1, row[0][2])]
        for i, x in enumerate(words):
            cost, missing, start = min((row[i + 1][0] + 1, row[i + 1][1] + 1, row[i + 1][2]), (new[i][0] + 1, new[i][1], new[i][2]))
            new.append(min((cost, missing, start), row[i]) if w == x else (cost, missing, start))
        row = new
    end = min(range(len(row)), key=lambda i: (*row[i][:2], i))
    return *row[end], end


def fits(t: list[str], words: list[str]):
    cost, missing, first, end = best_place(t, words)
    if len(t) - missing < COVERED * len(t) or cost > (1 - COVERED) * 2 * len(t):
        return None
    here, short = words[first:end], len(t) <= license_scan.SHORT
    if [here[i] for i in license_scan._exact(here, short)] != [t[i] for i in license_scan._exact(t, short)]:
        return None
    if "later" not in t and "version" in t and "later" in words[end:end + 8]:
        return None
    return len(t) - cost, missing, first, end


def plain_scan(text: str) -> list[tuple[str, int]]:
    """(licence, words missing) in the order of the text, the largest fits first."""
    words, found = license_scan._tokens(text)[0], []
    while True:
        short = {n: t for n, t in PLAIN.items() if len(t) * COVERED <= len(words) and len(set(t) - set(words)) <= (1 - COVERED) * len(t)}
        hits = [(*hit, n) for n, t in short.items() if (hit := fits(t, words))]
        if not hits:
            return [(n, m) for _, n, m in sorted(found)]
        _, missing, first, end, name = max(hits, key=lambda h: h[0])
        found.append((first, name, missing))
        words[first:end] = [""] * (end - first)


def altered(rng: random.Random, text: str, share: float) -> str:
    """The text with that share of its words replaced, but for those that must agree."""
    words = text.split()
    keep = license_scan.EXACT | {"library", "gnu", "version", "v", "license", "copyright"}
    free = [i for i, w in enumerate(words) if not (set(license_scan._tokens(w)[0]) & keep or any(c.isdigit() for c in w))]
    for i in rng.sample(free, min(len(free), int(share * len(words)))):
        words[i] = f"zz{'abcdefgh'[rng.randrange(8)]}q"
    return " ".join(words)


def test_scan_agrees_with_plain_alignment(spark):
    rng = random.Random(5)
    small = sorted(n for n, t in PLAIN.items() if len(t) <= 130)

    def prose(n):
        return " ".join(rng.choice("river stone license walks under green copyright paper the of and to".split()) for _ in range(n))

    texts, planted = [], 0
    for k in range(18):
        parts = [prose(rng.randrange(30))]
        for name in rng.sample(small, 1 + k % 2):
            share = (0.0, 0.06, 0.45)[k % 3]
            planted += share < 0.1
            parts += [altered(rng, TEMPLATES[name], share), prose(rng.randrange(5, 30))]
        texts.append("\n".join(textwrap.wrap(" ".join(parts), 60)))
    texts += ["", prose(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {k: [] for k in range(len(texts))}
    for r in sorted(license_scan.scan_licenses(df).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]].append((r["license"], r["missing"]))
    want = {k: plain_scan(t) for k, t in enumerate(texts)}
    assert got == want
    assert sum(map(len, want.values())) >= planted > 10
