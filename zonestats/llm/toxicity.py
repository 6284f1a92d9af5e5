"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestats.llm import textkernel as tk
from zonestats.llm.common import saved, smallest_by_hash

BUCKETS = 1 << 18  # hashed features of each template
SAMPLE = 2500  # labelled documents of each class that the model is fitted on
PIECE, PIECES = 4096, 8  # characters and number of the pieces that stand for a longer text in the sample
WINDOW = 512  # words whose evidence is taken together
EVIDENCE = 30.0  # log-likelihood ratio (chi-square) from which a word is labelled toxic
_BLOCK = 64


def features(w: tk.Words, buckets: int = BUCKETS) -> np.ndarray:
    """Feature buckets of each word: itself, its first six bytes, the word
    before and the word after (0 at a document's edge)."""
    n = len(w.hash)
    if not n:
        return np.zeros((4, 0), np.int32)
    def fold(h):
        return (h >> np.uint64(40)).astype(np.int64) % (buckets - 1) + 1
    word, head = fold(w.hash), fold(w.hashes(np.minimum(w.length, 6)))
    before, after = np.roll(word, 1), np.roll(word, -1)
    starts = w.first[:-1][w.first[:-1] < w.first[1:]]
    before[starts] = 0
    ends = w.first[1:][w.first[:-1] < w.first[1:]] - 1
    after[ends] = 0
    return np.stack([word, head, before, after]).astype(np.int32)


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once.

    ``score``: log weight of the label ``toxic`` at each word; ``first``:
    bounds of the sequences; ``trans``: 2 x 2 log weights. Returns the
    marginal of ``toxic`` at each word, that of two in a row (ending at the
    word) and the messages' pairwise sums (4 expected transition counts).

    Sequences are cut into blocks; all blocks advance together, first as
    2 x 2 products that carry the state over each block, then block by block
    along the sequences, then inside the blocks again.
    """
    n = np.diff(first)
    per = -(-n // _BLOCK)
    nb = int(per.sum())
    if nb == 0:
        return np.zeros(0), np.zeros(0), np.zeros(4)
    begin = np.concatenate([[0], np.cumsum(per)])
    seq = np.repeat(np.arange(len(n)), per)
    place = np.arange(nb) - begin[seq]
    at = first[seq][:, None] + place[:, None] * _BLOCK + np.arange(_BLOCK)[None, :]
    real = at < first[seq + 1][:, None]
    e = np.exp(np.clip(np.where(real, score[np.minimum(at, len(score) - 1)], 0.0), -30, 30))
    a = np.exp(trans)
    opening = place == 0

    def step(k):  # the matrix of column k: rows from, columns to
        m = np.empty((nb, 2, 2))
        m[:, :, 0] = a[:, 0]
        m[:, :, 1] = a[:, 1] * e[:, k][:, None]
        if k == 0:  # nothing precedes a sequence's first word
            m[opening, :, 0] = 1.0
            m[opening, :, 1] = e[opening, 0][:, None]
        off = ~real[:, k]
        if off.any():
            m[off] = np.eye(2)
        return m

    total = step(0)
    for k in range(1, _BLOCK):
        total = total @ step(k)
        total /= total.max(axis=(1, 2), keepdims=True)
    left, right = np.empty((nb, 2)), np.ones((nb, 2))
    left[opening] = (1.0, 0.0)
    for j in range(1, int(per.max())):
        b = np.flatnonzero(place == j)
        v = np.einsum("ni,nij->nj", left[b - 1], total[b - 1])
        left[b] = v / v.sum(axis=1, keepdims=True)
    last = begin[1:][per > 0] - 1
    for j in range(int(per.max()) - 2, -1, -1):
        b = np.flatnonzero((place == j) & (j < per[seq] - 1))
        v = np.einsum("nij,nj->ni", total[b + 1], right[b + 1])
        right[b] = v / v.sum(axis=1, keepdims=True)
    right[last] = 1.0
    fore = np.empty((_BLOCK, nb, 2))
    v = left
    for k in range(_BLOCK):
        v = np.einsum("ni,nij->nj", v, step(k))
        v = v / v.sum(axis=1, keepdims=True)
        fore[k] = v
    p, both, moves = np.zeros((nb, _BLOCK)), np.zeros((nb, _BLOCK)), np.zeros(4)
    back = right
    for k in range(_BLOCK - 1, -1, -1):
        joint = fore[k] * back
        p[:, k] = joint[:, 1] / joint.sum(axis=1)
        m = step(k)
        pair = (fore[k - 1] if k else left)[:, :, None] * m * back[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        both[:, k] = pair[:, 1, 1]
        count = real[:, k] & ~(opening if k == 0 else np.zeros(nb, bool))
        moves += pair[count].sum(axis=0).ravel()
        back = np.einsum("nij,nj->ni", m, back)
        back = back / back.sum(axis=1, keepdims=True)
    return p[real], both[real], moves


def _scores(f: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return sum(weights[t][f[t]] for t in range(len(weights))).astype(np.float64) + bias


def _words(texts: list[str]) -> tk.Words:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return tk.Words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), white=tk.MARKS)


def _document_evidence(p: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's window with the most expected toxic words: the
    largest marginal's logit and the log of that number; and how many windows
    the document has. A long text is so judged by its worst passage."""
    n = np.diff(first)
    per = -(-n // window)
    begin = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(n)), per)
    top, total = np.zeros(len(n)), np.zeros(len(n))
    if len(doc):
        cuts = first[doc] + (np.arange(len(doc)) - begin[doc]) * window
        tops, sums = np.maximum.reduceat(p, cuts), np.add.reduceat(p, cuts)
        order = np.lexsort((tops, sums, doc))  # a document's worst window comes last
        some = np.flatnonzero(per > 0)
        worst = order[begin[1:][some] - 1]
        top[some], total[some] = tops[worst], sums[worst]
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)) / 5, np.log1p(total)], axis=1), np.maximum(per, 1)


def document_logits(p: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of each document. A text of m windows has m chances to look
    toxic without being so, so each window has an m-th of the prior odds."""
    x, windows = _document_evidence(p, first)
    return np.column_stack([x, np.ones(len(x))]) @ weights - np.log(windows)


def telling(words: np.ndarray, doc: np.ndarray, toxic: np.ndarray, evidence: float = EVIDENCE) -> np.ndarray:
    """Which words have a bucket that occurs in toxic documents more often
    than in others, by ``evidence`` or more."""
    pairs = np.unique(doc.astype(np.int64) * BUCKETS + words)
    bucket, is_toxic = pairs % BUCKETS, toxic[pairs // BUCKETS]
    t = np.bincount(bucket[is_toxic], minlength=BUCKETS).astype(float)
    o = np.bincount(bucket[~is_toxic], minlength=BUCKETS).astype(float)
    share = max(toxic.sum(), 1) / max(len(toxic), 1)
    both = t + o
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(t > 0, t * np.log(t / (both * share)), 0) + np.where(o > 0, o * np.log(o / (both * max(1 - share, 1e-9))), 0))
    odds = (t + 0.5) * (1 - share) / ((o + 0.5) * share)
    return ((g >= evidence) & (odds > 3))[words]


def train(texts: list[str], toxic: np.ndarray, rounds: int = 40, decay: float = 1e-3) -> dict:
    """Fit the field on labelled documents, then the document score. Without
    documents of both classes, or without a word, the model is not fitted.

    The labelled tokens are the words of toxic documents that are ``telling``
    as a whole or by their first bytes. The field is trained on windows
    of 64 words: every window with a labelled word, and a fourth of the rest,
    by full-batch Adam on the exact likelihood; neighbours are shrunk most.
    A fourth of the documents is kept from the field, and the document score
    is fitted on those, so that it sees marginals as they are on new texts."""
    zero = {"weights": np.zeros((4, BUCKETS), np.float32), "bias": -10.0, "trans": np.zeros((2, 2)), "doc": np.zeros(3), "fitted": False}
    if not toxic.any() or toxic.all():
        return zero
    w = _words(texts)
    if not len(w.hash):
        return zero
    f = features(w)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    y = (telling(f[0], doc, toxic) | telling(f[1], doc, toxic)) & toxic[doc]
    cut = np.unique(np.concatenate([np.arange(a, b, _BLOCK) for a, b in zip(w.first[:-1], w.first[1:])]).astype(np.int64))
    ends = np.append(cut[1:], len(y))
    hit = np.add.reduceat(y, cut) > 0
    fourth = np.arange(len(texts)) % 4 == 3
    if not hit[~fourth[doc[cut]]].any():
        return zero
    chosen = (hit | (np.arange(len(cut)) % 4 == 0)) & ~fourth[doc[cut]]
    take = np.concatenate([np.arange(a, b) for a, b in zip(cut[chosen], ends[chosen])])
    bounds = np.concatenate([[0], np.cumsum((ends - cut)[chosen])])
    fx, yx = f[:, take], y[take].astype(float)
    prev = np.roll(yx, 1)
    inner = np.ones(len(yx), bool)
    inner[bounds[:-1]] = False
    seen = np.array([((prev == i) & (yx == j) & inner).sum() for i in (0, 1) for j in (0, 1)], float)
    used = [np.unique(fx[t], return_inverse=True) for t in range(4)]
    theta = [np.zeros(len(u)) for u, _ in used] + [np.array([-4.0]), np.zeros(4)]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for r in range(1, rounds + 1):
        score = sum(theta[t][used[t][1]] for t in range(4)) + theta[4][0]
        p, _, moves = marginals(score, bounds, theta[5].reshape(2, 2))
        gap = yx - p
        grads = [np.bincount(used[t][1], gap, len(theta[t])) for t in range(4)] + [np.array([gap.sum()]), seen - moves]
        for i, g in enumerate(grads):
            g = g / 50 - decay * (50 if i in (2, 3) else 1) * theta[i]
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            theta[i] = theta[i] + 0.25 * (m1[i] / (1 - 0.9 ** r)) / (np.sqrt(m2[i] / (1 - 0.99 ** r)) + 1e-3)
    model = dict(zero, bias=float(theta[4][0]), trans=theta[5].reshape(2, 2), fitted=True, weights=zero["weights"].copy())
    for t in range(4):
        model["weights"][t][used[t][0]] = theta[t]
    p, _, _ = marginals(_scores(f, model["weights"], model["bias"]), w.first, model["trans"])
    x, windows = _document_evidence(p, w.first)
    x, prior = np.column_stack([x, np.ones(len(texts))]), -np.log(windows)
    if not toxic[fourth].any() or toxic[fourth].all():  # too few documents to set any aside
        fourth[:] = True
    x, toxic, prior, b = x[fourth], toxic[fourth], prior[fourth], np.zeros(3)
    for _ in range(25):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ b + prior, -30, 30)))
        b += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (toxic - q) - 0.1 * b)
    model["doc"] = b
    return model


def sample_text(key: Column, text: Column, piece: int = PIECE, pieces: int = PIECES) -> Column:
    """A text of up to ``piece`` * ``pieces`` characters itself; of a longer one
    the ``pieces`` pieces with the smallest hash of ``key`` and place, in order."""
    n = F.ceil(F.length(text) / piece).cast("int")
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(places), 1, pieces), lambda s: s["i"]))
    return F.when(n <= pieces, text).otherwise(F.array_join(F.transform(chosen, lambda i: text.substr(i * piece + 1, F.lit(piece))), "\n"))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE, piece: int = PIECE, pieces: int = PIECES) -> dict:
    """Fit on a bounded sample: of each class the ``sample`` labelled rows with
    the smallest hash of the id, not held out, whatever their length; a text of
    more than ``piece`` * ``pieces`` characters is represented by ``pieces`` of
    its pieces, drawn by hash. Labels without an id or a class, and documents
    without a text, take no part; repeated labels of an id count once, as toxic
    if any is; equal rows count once; other columns are ignored. Without both
    classes (or any label, or any text) the model is not fitted and scores 0."""
    known = labels.filter(~F.coalesce(held_out, F.lit(False)) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = smallest_by_hash(known, "toxic", sample).select("doc_id", "toxic")
    picked = saved(picked, "toxic-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(picked), "doc_id").filter(F.length("text") > 0) \
        .select("doc_id", "toxic", sample_text(F.col("doc_id"), F.col("text"), piece, pieces).alias("text")).toPandas()
    texts = texts.drop_duplicates().sort_values(["doc_id", "text"])
    model = train(texts["text"].tolist(), texts["toxic"].to_numpy().astype(bool))
    share = known.agg(F.avg("toxic")).first()[0]
    own = texts["toxic"].mean() if len(texts) else 0.5
    if model["fitted"] and 0 < share < 1:  # from the sample's share of toxic rows to that of all labelled rows
        model["doc"][2] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return model


def _score_rows(batches, model: dict, least: float):
    for batch in batches:
        for i, j, data, offs in tk.slices(batch, "text", 1 << 19):
            w = tk.Words(data, offs, white=tk.MARKS)
            p, _, _ = marginals(_scores(features(w), model["weights"], model["bias"]), w.first, model["trans"])
            score = 1 / (1 + np.exp(-np.clip(document_logits(p, w.first, model["doc"]), -30, 30))) if model["fitted"] else np.zeros(j - i)
            score[np.diff(w.first) == 0] = min(0.0, float(score.min(initial=0.0)))
            char = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, int)
            spans = [[] for _ in range(j - i)]
            bad = np.flatnonzero(p >= least)
            for t, d in zip(bad.tolist(), (np.searchsorted(w.first, bad, side="right") - 1).tolist()):
                zero = int(char[offs[d]]) - 1
                a, b = int(char[w.start[t]]) - 1 - zero, int(char[w.end[t] - 1]) - zero
                if spans[d] and spans[d][-1]["word"] == t - 1:
                    spans[d][-1].update(end=b, word=t)
                else:
                    spans[d].append({"start": a, "end": b, "word": t})
            out = [[{"start": s["start"], "end": s["end"]} for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(score, pa.float64()),
                 pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "score", "spans"])


def tag(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), spans (character offsets
    of runs of words whose marginal is ``least`` or more). Whole texts are
    scored; a null text, or one without a word, has score 0 and no span.
    Repeated rows score alike; an empty table gives no rows; other columns
    are ignored. A model without both classes scores 0."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_score_rows, model=model, least=least),
                          f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")
